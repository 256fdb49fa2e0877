"""Full-text search over chunks: BM25 scores, the best chunk of each file, and capped evidence.

Scores of a query need the number of chunks, their average length and each term's frequency over all
chunks. They are observed in the same pass over the texts that keeps the matching chunks, so every text is
read once, and what is shuffled afterwards is bounded by the matches. For many queries over one corpus
write ``postings`` once, sorted by term.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut_lineage, widen

PER_FILE, OVERALL = 8, 500
K1, B = 1.2, 0.75


def analyze(query: str, synonyms: dict[str, list[str]] | None = None, stop: bool = True) -> list[str]:
    """Terms of a query in order, each once: stop words dropped, synonyms put after their term."""
    import re

    def split(s: str) -> list[str]:
        return [t for t in re.split(r"[\W_]+", s.lower()) if t]

    out: list[str] = []
    for t in split(query):
        if not stop or t not in S.STOP_WORDS:
            out += [t, *(w for s in (synonyms or {}).get(t, ()) for w in split(s))]
    return list(dict.fromkeys(out))


def matches(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Chunks with ``dl`` (tokens) and ``tf`` (occurrences of each term). A null content has no tokens.

    One pass of a regular expression puts two blanks between tokens; after that tokens and terms are
    counted by the bytes that plain replacements take away.
    """
    spaced = F.trim(F.regexp_replace(S.fold(F.coalesce("content", F.lit(""))), rf"{S.NO_TOKEN}+", "  "))
    wide = chunks.withColumn("spaced", F.concat(F.lit(" "), spaced, F.lit(" ")))

    def taken(what: str) -> Column:
        return F.octet_length("spaced") - F.octet_length(F.replace(F.col("spaced"), F.lit(what), F.lit("")))

    dl = F.when(F.octet_length("spaced") <= 2, 0).otherwise(taken("  ") / 2 + 1).cast("int")
    tf = [(taken(f" {t} ") / (len(t.encode()) + 2)).cast("int") for t in terms]
    return wide.withColumns({"dl": dl, "tf": F.array(*tf)}).drop("spaced")


def bm25(tf: Column, dl: Column, n_docs: int, total: int, df: list[int]) -> Column:
    """Sum over the query's terms in their order; a term in most chunks still counts a little."""
    import math

    avg = total / n_docs if n_docs else 1.0
    parts = []
    for i, n in enumerate(df):
        idf = max(math.log((n_docs - n + 0.5) / (n + 0.5)), 1e-6)
        f = tf[i].cast("double")
        parts.append(F.lit(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * dl / F.lit(avg))))
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def scored_chunks(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Matching chunks, without their content, with their score; no terms, no rows.

    Repeated rows of a chunk_id count once; they are dropped after counting, so texts are not shuffled.
    """
    if not terms:
        return chunks.drop("content").withColumn("score", F.lit(0.0)).limit(0)

    m = matches(widen(chunks), terms).drop("content")
    if "chunk_id" in chunks.columns:
        m = m.dropDuplicates(["chunk_id"])
    # counted where the last stage of this job reads its partitions: each counts once, even if tasks are run again
    counts = Observation()
    seen = m.observe(counts, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"), *(F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))))
    hit = cut_lineage(seen.filter(F.exists("tf", lambda x: x > 0)))
    s = counts.get
    df = [s[f"df{i}"] or 0 for i in range(len(terms))]
    # equal scores stay equal on any engine: nine decimals
    score = F.floor(bm25(F.col("tf"), F.col("dl"), s["n"], s["total"] or 0, df) * 1e9 + 0.5) / 1e9
    return hit.withColumn("score", score).drop("tf", "dl")


def _rank(extra=()) -> list[Column]:
    return [F.desc("score"), *extra, F.asc("start_line"), F.asc("end_line"), F.asc("kind"), F.coalesce("heading", F.lit("")).asc()]


def search(chunks: DataFrame, terms: list[str], top: int = 10, symbols_only: bool = False) -> DataFrame:
    """The best chunk of each file, the ``top`` best of them: score desc, path, lines, kind, heading."""
    s = scored_chunks(chunks, terms)
    if symbols_only:
        s = s.filter("kind = 'symbol'")
    best = Window.partitionBy("path").orderBy(*_rank())
    one = s.withColumn("n", F.row_number().over(best)).filter("n = 1")
    return one.orderBy(*_rank([F.asc("path")])).limit(top).select("path", "kind", "start_line", "end_line", "heading", S.round4(F.col("score")).alias("score"))


def evidence(scored: DataFrame, symbols_only: bool = False, per_file: int = PER_FILE, overall: int = OVERALL) -> DataFrame:
    """At most ``per_file`` chunks of a file and ``overall`` in all, of one channel: symbols or the rest."""
    s = scored.filter("kind = 'symbol'" if symbols_only else "kind <> 'symbol'")
    best = Window.partitionBy("path").orderBy(*_rank())
    return s.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= per_file).drop("n").orderBy(*_rank([F.asc("path")])).limit(overall)


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl) of every chunk and term."""
    t = chunks.select("chunk_id", S.words(F.col("content")).alias("t"))
    return t.select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def source_slice(chunks: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """(line, text) of a file's lines in a range, from the content chunks that overlap it."""
    c = chunks.filter((F.col("path") == path) & (F.col("kind") != "symbol") & S.overlaps(F.col("start_line"), F.col("end_line"), F.lit(start), F.lit(end)))
    lines = c.select("start_line", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return lines.select((F.col("start_line") + F.col("i")).alias("line"), "text").filter(F.col("line").between(start, end)).groupBy("line").agg(F.max("text").alias("text"))


def source_slices(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, start_line, end_line, text) of many ranges at once: ``source_slice`` of each, its lines joined."""
    c = chunks.filter("kind <> 'symbol'").select("path", F.col("start_line").alias("first"), F.col("end_line").alias("last"), "content")
    some = c.join(F.broadcast(spans.select("path").distinct()), "path", "left_semi")  # as many as were asked for
    j = spans.join(some, "path").filter(S.overlaps(F.col("first"), F.col("last"), F.col("start_line"), F.col("end_line")))
    lines = j.select("path", "start_line", "end_line", "first", F.posexplode(F.split("content", "\n")).alias("i", "text")).withColumn("line", F.col("first") + F.col("i"))
    one = lines.filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).groupBy("path", "start_line", "end_line", "line").agg(F.max("text").alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return spans.join(one.groupBy("path", "start_line", "end_line").agg(text.alias("text")), ["path", "start_line", "end_line"], "left").select("path", "start_line", "end_line", F.coalesce("text", F.lit("")).alias("text"))


def chunk_text(chunks: DataFrame, path: str, start: int) -> DataFrame:
    """The content of the chunk at a line, code before symbols."""
    return chunks.filter((F.col("path") == path) & (F.col("start_line") == start)).orderBy(F.col("kind") == "symbol", "end_line", "chunk_id").limit(1).select("kind", "content")
