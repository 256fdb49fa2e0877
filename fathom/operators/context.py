"""Ranked context: candidates from text, symbols, paths and the graph, scored, penalised and diversified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut_lineage
from . import graph, search

# Weights, factors and limits of the ranking.
WEIGHTS = {"fts": 0.4, "symbol": 0.3, "graph": 0.2, "path": 0.1}
PENALTY, DIVERSITY = 0.3, 0.9
MAX_SYMBOLS, MAX_LINES, MAX_SPANS, PREAMBLE = 12, 80, 3, 20


def _nine(c: Column) -> Column:
    return F.floor(c * 1e9 + 0.5) / 1e9


def path_signal(files: DataFrame, terms: list[str]) -> DataFrame:
    """(path, path_score, reason): terms that a path contains, two more where its stem is a term."""
    low = F.lower(F.col("path"))
    n = sum((low.contains(t).cast("int") for t in terms), F.lit(0))
    exact = S.stem(low).isin(*terms)
    s = files.select("path", n.alias("m"), exact.alias("x")).filter("m > 0 OR x")
    return s.select("path", (F.col("m") + F.when(F.col("x"), 2).otherwise(0)).cast("double").alias("path_score"), F.when(F.col("x"), "path-name-match").otherwise("path-match").alias("reason"))


def candidates(chunks: DataFrame, files: DataFrame, terms: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals, text evidence, symbol evidence): per file the greatest text and symbol score and the path score."""
    scored = search.scored_chunks(chunks, terms)
    # a thousand rows at most, read many times below: kept apart from the scan that made them
    both = cut_lineage(search.evidence(scored).unionByName(search.evidence(scored, symbols_only=True)).drop("content"))
    text, syms = both.filter("kind <> 'symbol'"), both.filter("kind = 'symbol'")
    zero = F.lit(0.0)
    a = text.select("path", F.col("score").alias("fts"), zero.alias("symbol"), zero.alias("path_score"), F.array(F.lit("fts")).alias("why"))
    spec = F.col("score") * (1 + S.specificity(F.col("heading"), terms))
    b = syms.select("path", zero.alias("fts"), spec.alias("symbol"), zero.alias("path_score"), F.when(F.length("heading") > 0, F.array(F.concat(F.lit("symbol:"), "heading"))).otherwise(F.array().cast("array<string>")).alias("why"))
    c = path_signal(files, terms).select("path", zero.alias("fts"), zero.alias("symbol"), "path_score", F.array("reason").alias("why"))
    rows = reduce(DataFrame.unionByName, [a, b, c])
    one = rows.groupBy("path").agg(F.max("fts").alias("fts"), F.max("symbol").alias("symbol"), F.max("path_score").alias("path_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("why")))).alias("reasons"))
    return cut_lineage(one), text, syms


def seeds(signals: DataFrame) -> DataFrame:
    """(path, strength): the text score over the greatest one, else .8 for a symbol, else .5."""
    top = F.broadcast(signals.agg(F.max("fts").alias("top")))  # one row
    own = F.when((F.col("top") > 0) & (F.col("fts") > 0), F.col("fts") / F.col("top")).when(F.col("symbol") > 0, 0.8).otherwise(0.5)
    return signals.crossJoin(top).select("path", own.alias("strength"))


def score(signals: DataFrame, steps: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Signals and graph gains as one weighted score; each component is divided by its greatest value.

    The greatest values are an aggregate of one row, joined to all candidates, of which those by paths and
    links grow with the data.
    """
    g = steps.groupBy("path").agg(F.sum("gain").alias("graph"), F.array_sort(F.collect_set("reason")).alias("links"))
    c = cut_lineage(signals.join(g, "path", "full_outer").fillna(0.0, ["fts", "symbol", "path_score", "graph"]))
    names = ("fts", "symbol", "graph", "path_score")
    top = F.broadcast(c.agg(*(F.max(n).alias(f"top_{n}") for n in names)))
    part = lambda name: F.when(F.col(f"top_{name}") > 0, F.col(name) / F.col(f"top_{name}")).otherwise(0.0)
    total = F.lit(weights["fts"]) * part("fts") + F.lit(weights["symbol"]) * part("symbol") + F.lit(weights["graph"]) * part("graph") + F.lit(weights["path"]) * part("path_score")
    bad = S.is_vendor(F.col("path"))
    none = F.array().cast("array<string>")
    reasons = F.concat(F.coalesce("reasons", none), F.coalesce("links", none), F.when(bad, F.array(F.lit("penalty:vendor-or-generated"))).otherwise(none))
    return c.crossJoin(top).withColumns({"score": _nine(total * F.when(bad, PENALTY).otherwise(1.0)), "reasons": S.compress_reasons(reasons)}).select("path", "fts", "symbol", "graph", "path_score", "score", "reasons")


def diversify(scored: DataFrame) -> DataFrame:
    """``adjusted``: the score times .9 for each better file of the same directory."""
    w = Window.partitionBy("dir").orderBy(F.desc("score"), "path")
    d = scored.withColumn("dir", S.dirname(F.col("path"))).withColumn("prior", F.row_number().over(w) - 1)
    return d.withColumn("adjusted", _nine(F.col("score") * F.pow(F.lit(DIVERSITY), F.col("prior")))).drop("dir", "prior")


def rank(chunks: DataFrame, files: DataFrame, edges: DataFrame, terms: list[str], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """All candidates of a query with their components, score, adjusted score and reasons."""
    signals, _, _ = candidates(chunks, files, terms)
    steps = graph.expand(seeds(signals), edges, files)
    return diversify(score(signals, steps, weights))


def outline_symbols(symbols: DataFrame, matched: DataFrame | None = None, cap: int | None = MAX_SYMBOLS) -> DataFrame:
    """Symbols of each file in source order, ``cap`` at most: matched ones first, then their containers.

    ``matched`` is (path, name).
    """
    s = symbols
    if matched is not None:
        m = matched.select("path", F.col("name")).distinct().withColumn("hit", F.lit(True))
        s = s.join(m, ["path", "name"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        inner = s.filter("hit").select("path", F.col("start_line").alias("s"), F.col("end_line").alias("e")).groupBy("path").agg(F.collect_set(F.struct("s", "e")).alias("in"))
        s = s.join(inner, "path", "left")
        holds = F.exists("in", lambda x: S.strictly_contains(F.col("start_line"), F.col("end_line"), x["s"], x["e"]))
        s = s.withColumn("role", F.when(F.col("hit"), 0).when(F.coalesce(holds, F.lit(False)), 1).otherwise(2)).drop("in", "hit")
    else:
        s = s.withColumn("role", F.lit(2))
    order = Window.partitionBy("path").orderBy("role", "start_line", "name", "symbol_id")
    s = s.withColumn("n", F.row_number().over(order))
    return (s if cap is None else s.filter(F.col("n") <= cap)).drop("n")


def select_spans(ranges: DataFrame, max_spans: int = MAX_SPANS, max_lines: int = MAX_LINES) -> DataFrame:
    """(path, start_line, end_line) chosen from (path, rank, start_line, end_line).

    Ranges are taken by rank, cut to ``max_lines`` lines, and skipped where they overlap one taken before;
    the result is in source order. One fold over each file's few ranges.
    """
    cut = F.least("end_line", F.col("start_line") + max_lines - 1)
    by = ranges.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("start_line").alias("s"), cut.alias("e")))).alias("r"))
    kind = "array<struct<s:int,e:int>>"
    take = lambda acc, x: F.when((F.size(acc) < max_spans) & ~F.exists(acc, lambda a: (a["s"] <= x["e"]) & (x["s"] <= a["e"])), F.concat(acc, F.array(F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"))))).otherwise(acc)
    chosen = F.array_sort(F.aggregate("r", F.array().cast(kind), take))
    return by.select("path", F.explode(chosen).alias("x")).select("path", F.col("x.s").alias("start_line"), F.col("x.e").alias("end_line"))


def drop_containers(hits: DataFrame) -> DataFrame:
    """Symbol hits without those that strictly contain another hit of the same file."""
    a, b = hits.alias("a"), hits.select("path", "start_line", "end_line").alias("b")
    cond = (F.col("a.path") == F.col("b.path")) & S.strictly_contains(F.col("a.start_line"), F.col("a.end_line"), F.col("b.start_line"), F.col("b.end_line"))
    return a.join(b, cond, "left_anti")


def split_reused(units: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to deliver, reused) units by whether their receipt was seen; malformed receipts count as unseen."""
    ok = seen.filter(S.is_receipt(F.col("receipt"))).select("receipt").distinct()
    return units.join(ok, "receipt", "left_anti"), units.join(ok, "receipt", "left_semi")
