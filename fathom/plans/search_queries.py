"""Queries of full-text search, ranking and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import context, graph, packing, search
from ..session import cut_lineage
from ..sources.tables import SQL_CHUNKS, SQL_EDGES, SQL_FILES, SQL_SYMBOLS, chunks, edges, live_files, symbols, table
from .registry import query

QUERY = "please retry the courier session with a token"
TERMS = search.analyze(QUERY)
PLAIN_TERMS = search.analyze(QUERY, stop=False)


def _list(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def sql_scored(terms) -> str:
    """CTEs: toks (chunks with tokens), scored (chunk and score)."""
    fold = f"translate(lower(coalesce(content, '')), '{S.ACCENTED}', '{S.PLAIN}')"
    part = "+".join(
        f"(SELECT greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) FROM st) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / (SELECT total / n::DOUBLE FROM st)))" for i in range(len(terms))
    )
    return rf"""{SQL_CHUNKS},
toks AS (SELECT *, list_filter(string_split_regex({fold}, '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda t: t <> '') AS t FROM uch),
tfs AS (SELECT * EXCLUDE (t), len(t) AS dl, {', '.join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))} FROM toks),
st AS (SELECT count(*) AS n, sum(dl) AS total, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(terms)))} FROM tfs),
scored AS (SELECT chunk_id, repo, path, kind, start_line, end_line, heading, floor(({part}) * 1e9 + 0.5) / 1e9 AS score FROM tfs WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(terms)))})"""


_RANK = "score DESC, start_line, end_line, kind, coalesce(heading, '')"
_TOP = "score DESC, path, start_line, end_line, kind, coalesce(heading, '')"


def _sql_search(terms, top, where="true") -> str:
    return f"""WITH {sql_scored(terms)}, best AS (SELECT * FROM scored WHERE {where} QUALIFY row_number() OVER (PARTITION BY path ORDER BY {_RANK}) = 1)
SELECT path, kind, start_line, end_line, heading, floor(score * 1e4 + 0.5) / 1e4 AS score FROM best ORDER BY {_TOP.replace('score DESC', 'best.score DESC')} LIMIT {top}"""


@query(_sql_search(PLAIN_TERMS, 10))
def t5_search(spark, d):
    return search.search(table(spark, d, "chunks"), PLAIN_TERMS, 10)


@query(_sql_search(["merge", "forecast"], 10, "kind = 'symbol'"))
def t5_search_symbols(spark, d):
    return search.search(table(spark, d, "chunks"), ["merge", "forecast"], 10, symbols_only=True)


@query(f"SELECT unnest({_list(TERMS)}) AS term, unnest(range({len(TERMS)}))::INT AS place")
def t1_t2_query_terms(spark, d):
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, search.analyze(QUERY)))).alias("place", "term"))


@query(f"WITH {sql_scored(TERMS)} SELECT chunk_id, floor(score * 1e4 + 0.5) / 1e4 AS score FROM scored")
def t4_bm25(spark, d):
    return search.scored_chunks(table(spark, d, "chunks"), TERMS).select("chunk_id", S.round4(F.col("score")).alias("score"))


def _sql_evidence(where: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {_RANK}) AS n FROM scored WHERE {where}) WHERE n <= 8 ORDER BY {_TOP} LIMIT 500"


@query(f"WITH {sql_scored(TERMS)}, a AS ({_sql_evidence(chr(107) + 'ind <> ' + chr(39) + 'symbol' + chr(39))}), b AS ({_sql_evidence(chr(107) + 'ind = ' + chr(39) + 'symbol' + chr(39))}) SELECT 'text' AS channel, chunk_id FROM a UNION ALL SELECT 'symbol', chunk_id FROM b")
def t6_w2_evidence(spark, d):
    s = search.scored_chunks(table(spark, d, "chunks"), TERMS)
    a, b = search.evidence(s), search.evidence(s, symbols_only=True)
    return a.select(F.lit("text").alias("channel"), "chunk_id").unionByName(b.select(F.lit("symbol").alias("channel"), "chunk_id"))


@query(f"WITH {sql_scored(TERMS)} SELECT term, count(DISTINCT chunk_id) AS chunks, count(*) AS total FROM (SELECT chunk_id, unnest(t) AS term FROM toks) GROUP BY term")
def t3_postings(spark, d):
    p = search.postings(chunks(spark, d))
    return p.groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("total"))


_hp = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(heading, '[^A-Za-z0-9]+', ' ', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'))"
_SPEC = f"list_distinct(list_filter(string_split({_hp}, ' '), lambda x: x <> ''))"


def _sql_spec(terms) -> str:
    return f"coalesce(CASE WHEN len({_SPEC}) > 0 THEN len(list_filter({_SPEC}, lambda x: list_contains({_list(terms)}, x))) / len({_SPEC})::DOUBLE END, 0.0)"


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id, floor({_sql_spec(TERMS)} * 1e4 + 0.5) / 1e4 AS specificity FROM uch WHERE kind = 'symbol' AND heading IS NOT NULL")
def t7_specificity(spark, d):
    c = chunks(spark, d).filter("kind = 'symbol' AND heading IS NOT NULL")
    return c.select("chunk_id", S.round4(S.specificity(F.col("heading"), TERMS)).alias("specificity"))


def sql_ranked(terms) -> str:
    """CTEs up to ``ranked``: the whole ranking in SQL."""
    low = "lower(path)"
    m = " + ".join(f"contains({low}, '{t}')::INT" for t in terms)
    exact = rf"regexp_replace(regexp_extract({low}, '[^/]*$'), '\.[^.]*$', '') IN ({', '.join(repr(t) for t in terms)})"
    nine = lambda x: f"floor(({x}) * 1e9 + 0.5) / 1e9"
    part = lambda c: f"CASE WHEN max({c}) OVER () > 0 THEN {c} / max({c}) OVER () ELSE 0.0 END"
    vendor = f"(contains({low}, '.min.') OR contains({low}, '.generated.') OR contains({low}, '/vendor/') OR contains({low}, '/dist/') OR starts_with({low}, 'vendor/'))"
    return f"""{sql_scored(terms)}, {SQL_EDGES}, {SQL_FILES},
known AS (SELECT DISTINCT path FROM live),
a AS ({_sql_evidence("kind <> 'symbol'")}), b AS ({_sql_evidence("kind = 'symbol'")}),
p AS (SELECT path, ({m} + CASE WHEN {exact} THEN 2 ELSE 0 END)::DOUBLE AS path_score FROM live WHERE ({m}) > 0 OR {exact}),
sig AS (SELECT path, max(fts) AS fts, max(symbol) AS symbol, max(path_score) AS path_score FROM (
  SELECT path, score AS fts, 0.0::DOUBLE AS symbol, 0.0::DOUBLE AS path_score FROM a UNION ALL SELECT path, 0.0, score * (1 + {_sql_spec(terms)}), 0.0 FROM b UNION ALL SELECT path, 0.0, 0.0, path_score FROM p) GROUP BY path),
lk AS (SELECT DISTINCT src AS f, dst AS t, kind || ':out' AS how FROM ued WHERE dst IN (SELECT path FROM known) UNION ALL SELECT DISTINCT dst, src, kind || ':in' FROM ued WHERE src IN (SELECT path FROM known)),
s0 AS (SELECT path, CASE WHEN max(fts) OVER () > 0 AND fts > 0 THEN fts / max(fts) OVER () WHEN symbol > 0 THEN 0.8 ELSE 0.5 END AS strength FROM sig),
f0x AS (SELECT * FROM s0 WHERE path IN (SELECT path FROM known)),
h1 AS (SELECT t AS path, how, f, 1 AS hop, strength * 0.5 AS gain FROM f0x JOIN lk ON path = f),
f1x AS (SELECT path, max(gain) AS strength FROM h1 WHERE path NOT IN (SELECT path FROM f0x) GROUP BY path),
h2 AS (SELECT t AS path, how, f, 2 AS hop, strength * 0.5 AS gain FROM f1x JOIN lk ON path = f),
steps AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2),
g AS (SELECT path, sum(gain) AS graph FROM steps GROUP BY path),
allc AS (SELECT path, coalesce(fts, 0.0) AS fts, coalesce(symbol, 0.0) AS symbol, coalesce(graph, 0.0) AS graph, coalesce(path_score, 0.0) AS path_score FROM sig FULL JOIN g USING (path)),
sc AS (SELECT *, {nine(f"(0.4 * {part('fts')} + 0.3 * {part('symbol')} + 0.2 * {part('graph')} + 0.1 * {part('path_score')}) * CASE WHEN {vendor} THEN 0.3 ELSE 1.0 END")} AS score FROM allc),
ranked AS (SELECT *, {nine("score * 0.9 ** (row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, path) - 1)")} AS adjusted FROM sc)"""


def _paths(spark, d):
    """The live paths, derived once: an expansion looks them up after each of its rounds."""
    return cut_lineage(live_files(spark, d).select("path"))


def _ranked(spark, d):
    return context.rank(table(spark, d, "chunks"), _paths(spark, d), edges(spark, d), TERMS)


_r4 = lambda c: f"floor({c} * 1e4 + 0.5) / 1e4 AS {c}"


@query(f"WITH {sql_ranked(TERMS)} SELECT path, {', '.join(map(_r4, ['fts', 'symbol', 'graph', 'path_score', 'score', 'adjusted']))} FROM ranked")
def t8_w3_a6_ranked_candidates(spark, d):
    return _ranked(spark, d).select("path", *(S.round4(F.col(c)).alias(c) for c in ("fts", "symbol", "graph", "path_score", "score", "adjusted")))


@query(f"WITH {sql_ranked(TERMS)} SELECT path, {_r4('adjusted')} FROM ranked ORDER BY ranked.adjusted DESC, path LIMIT 8")
def q5_o2_context_top(spark, d):
    return _ranked(spark, d).orderBy(F.desc("adjusted"), "path").limit(8).select("path", S.round4(F.col("adjusted")).alias("adjusted"))


@query(f"WITH {sql_ranked(TERMS)} SELECT path, hop, f AS via, {_r4('gain')} FROM steps")
def g3_a12_expansion(spark, d):
    paths = _paths(spark, d)
    sig, _, _ = context.candidates(table(spark, d, "chunks"), paths, TERMS)
    steps = graph.expand(context.seeds(sig), edges(spark, d), paths)
    return steps.select("path", "hop", F.regexp_replace("reason", "^[a-z-]+:", "").alias("via"), S.round4(F.col("gain")).alias("gain"))


@query(f"WITH {sql_ranked(TERMS)} SELECT path, (fts > 0)::INT + (symbol > 0)::INT + (path_score > 0)::INT AS channels FROM sig")
def u5_a11_candidates(spark, d):
    sig, _, _ = context.candidates(table(spark, d, "chunks"), live_files(spark, d), TERMS)
    return sig.select("path", sum(((F.col(c) > 0).cast("int") for c in ("fts", "symbol", "path_score")), F.lit(0)).alias("channels"))


@query()
def a10_context_reasons(spark, d):
    return _ranked(spark, d).select("path", "reasons")


# -- packing

BUDGET, TOP = 3000, 8


def sql_items() -> str:
    return f"""{sql_ranked(TERMS)},
tok AS (SELECT path, greatest(coalesce(token_count, 0), 0)::BIGINT AS cost, content_hash FROM live),
items AS (SELECT path, cost, content_hash, row_number() OVER (ORDER BY adjusted DESC, path) AS pos FROM ranked JOIN tok USING (path) WHERE adjusted > 0)"""


def _items(spark, d):
    from pyspark.sql import Window

    f = live_files(spark, d).select("path", F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)).cast("long").alias("cost"), "content_hash")
    j = _ranked(spark, d).join(f, "path").filter("adjusted > 0")
    # one task numbers all candidates: a thousand by evidence, and any number by paths and links
    return j.select("path", "cost", "content_hash", F.row_number().over(Window.orderBy(F.desc("adjusted"), "path")).alias("pos"))


_PACK = f"""pack AS (SELECT 0::BIGINT AS pos, 0::BIGINT AS used, 0 AS taken, false AS chosen, ''::VARCHAR AS path, 0::BIGINT AS cost
  UNION ALL SELECT i.pos, p.used + CASE WHEN p.taken < {TOP} AND p.used + i.cost <= {BUDGET} THEN i.cost ELSE 0 END, p.taken + CASE WHEN p.taken < {TOP} AND p.used + i.cost <= {BUDGET} THEN 1 ELSE 0 END,
  p.taken < {TOP} AND p.used + i.cost <= {BUDGET}, i.path, i.cost FROM pack p JOIN items i ON i.pos = p.pos + 1)"""


@query(f"WITH RECURSIVE {sql_items()}, {_PACK} SELECT path, cost, pos AS place FROM pack WHERE chosen")
def a7_packed(spark, d):
    return packing.taken(_items(spark, d), BUDGET, TOP).select("path", "cost", F.col("pos").alias("place"))


@query(f"WITH RECURSIVE {sql_items()}, {_PACK} SELECT CASE WHEN chosen THEN 'selected' WHEN taken >= {TOP} THEN 'top' ELSE 'budget_tokens' END AS outcome, count(*) AS items, sum(cost)::BIGINT AS tokens FROM pack WHERE pos > 0 GROUP BY 1")
def a8_omissions(spark, d):
    return packing.omissions(packing.pack(_items(spark, d), BUDGET, TOP))


@query(f"WITH {SQL_FILES} SELECT path, first_value(path) OVER (PARTITION BY content_hash ORDER BY path) AS duplicate_of FROM live WHERE content_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY path) > 1")
def j11_duplicates(spark, d):
    return packing.duplicates(live_files(spark, d).select("path", "content_hash", F.col("path").alias("pos")))


# -- outline and spans


@query(f"WITH {SQL_SYMBOLS} SELECT path, name, start_line, symbol_id FROM usy QUALIFY row_number() OVER (PARTITION BY path ORDER BY start_line, name, symbol_id) <= 12")
def w5_outline(spark, d):
    return context.outline_symbols(symbols(spark, d)).select("path", "name", "start_line", "symbol_id")


_MATCHED = f"matched AS (SELECT DISTINCT path, name FROM usy WHERE contains(lower(name), 'merge'))"


@query(f"""WITH {SQL_SYMBOLS}, {_MATCHED}, hit AS (SELECT u.*, m.name IS NOT NULL AS hit FROM usy u LEFT JOIN matched m USING (path, name)),
roles AS (SELECT *, CASE WHEN hit THEN 0 WHEN EXISTS (SELECT 1 FROM hit i WHERE i.hit AND i.path = h.path AND h.start_line <= i.start_line AND h.end_line >= i.end_line AND (h.start_line < i.start_line OR h.end_line > i.end_line)) THEN 1 ELSE 2 END AS role FROM hit h)
SELECT path, name, symbol_id, role FROM roles QUALIFY row_number() OVER (PARTITION BY path ORDER BY role, start_line, name, symbol_id) <= 4""")
def w5_outline_matched(spark, d):
    s = symbols(spark, d)
    m = s.filter(F.lower("name").contains("merge")).select("path", "name")
    return context.outline_symbols(s, m, 4).select("path", "name", "symbol_id", "role")


_TEXT = "kind <> 'symbol'"


@query(f"""WITH RECURSIVE {sql_scored(TERMS)}, a AS ({_sql_evidence(_TEXT)}),
r AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY score DESC, start_line, end_line, chunk_id) AS n, start_line AS s, least(end_line, start_line + 79) AS e FROM (SELECT * EXCLUDE (n) FROM a)),
f AS (SELECT DISTINCT path, 0::BIGINT AS n, []::STRUCT(s INTEGER, e INTEGER)[] AS acc FROM r
  UNION ALL SELECT f.path, r.n, CASE WHEN len(acc) < 3 AND len(list_filter(acc, lambda x: x.s <= r.e AND r.s <= x.e)) = 0 THEN list_append(acc, {{'s': r.s::INTEGER, 'e': r.e::INTEGER}}) ELSE acc END FROM f JOIN r ON r.path = f.path AND r.n = f.n + 1),
fin AS (SELECT path, unnest(acc) AS x FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC) = 1)
SELECT path, x.s AS start_line, x.e AS end_line FROM fin""")
def w6_spans(spark, d):
    from pyspark.sql import Window

    text = search.evidence(search.scored_chunks(table(spark, d, "chunks"), TERMS))
    w = Window.partitionBy("path").orderBy(F.desc("score"), "start_line", "end_line", "chunk_id")
    return context.select_spans(text.select("path", F.row_number().over(w).alias("rank"), "start_line", "end_line"))


@query(f"""WITH {SQL_SYMBOLS} SELECT a.symbol_id FROM usy a WHERE kind <> 'property' AND NOT EXISTS (SELECT 1 FROM usy b WHERE b.kind <> 'property' AND a.path = b.path AND a.start_line <= b.start_line AND a.end_line >= b.end_line AND (a.start_line < b.start_line OR a.end_line > b.end_line))""")
def j15_innermost_symbols(spark, d):
    return context.drop_containers(symbols(spark, d).filter("kind <> 'property'")).select("symbol_id")


_target = "(SELECT min(path) FROM uch WHERE kind = 'block')"


@query(f"""WITH {SQL_CHUNKS}, c AS (SELECT start_line, string_split(content, chr(10)) AS l FROM uch WHERE path = {_target} AND kind <> 'symbol' AND start_line <= 40 AND end_line >= 10 AND content IS NOT NULL)
SELECT start_line + i - 1 AS line, max(l[i]) AS text FROM (SELECT start_line, l, unnest(range(1, len(l) + 1)) AS i FROM c) WHERE start_line + i - 1 BETWEEN 10 AND 40 GROUP BY 1""")
def j4_x5_source_slice(spark, d):
    c = chunks(spark, d)
    return search.source_slice(c, c.filter("kind = 'block'").agg(F.min("path")).first()[0], 10, 40).select(F.col("line").cast("long").alias("line"), "text")


@query(f"WITH {SQL_CHUNKS} SELECT kind, content FROM uch WHERE path = {_target} AND start_line = 21 ORDER BY kind = 'symbol', end_line, chunk_id LIMIT 1")
def s15_chunk_text(spark, d):
    c = chunks(spark, d)
    return search.chunk_text(c, c.filter("kind = 'block'").agg(F.min("path")).first()[0], 21)


@query(f"""WITH {SQL_FILES}, r AS (SELECT path, translate(rtrim(to_base64(unhex(sha256(strlen('r1') || ':' || 'r1' || strlen(path) || ':' || path || strlen(content_hash) || ':' || content_hash))), '='), '+/', '-_') AS receipt, 'b' AS side FROM before WHERE content_hash IS NOT NULL
UNION ALL SELECT path, translate(rtrim(to_base64(unhex(sha256(strlen('r1') || ':' || 'r1' || strlen(path) || ':' || path || strlen(content_hash) || ':' || content_hash))), '='), '+/', '-_'), 'l' FROM live WHERE content_hash IS NOT NULL)
SELECT path, receipt IN (SELECT receipt FROM r WHERE side = 'b') AS reused FROM r WHERE side = 'l'""")
def j10_reuse(spark, d):
    def units(back):
        f = live_files(spark, d, back).filter("content_hash IS NOT NULL")
        return f.select("path", S.receipt(S.canonical_hash(F.lit("r1"), F.col("path"), F.col("content_hash"))).alias("receipt"))

    fresh, reused = context.split_reused(units(0), units(1))
    return fresh.select("path", F.lit(False).alias("reused")).unionByName(reused.select("path", F.lit(True).alias("reused")))
