"""Queries of the link graph, the architecture, changes, memory and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import architecture, changes, context, graph, memory, usage
from ..sources.tables import SQL_EDGES, SQL_FILES, SQL_SYMBOLS, chunks, edges, live_files, symbols, table
from .registry import query
from .search_queries import TERMS, _ranked, sql_ranked

_GE = f"{SQL_EDGES}, {SQL_FILES}, known AS (SELECT DISTINCT path FROM live)"


# -- graph


@query(f"""WITH {_GE}
SELECT DISTINCT src AS path, 'imports' AS relation, dst AS neighbor, 'import-edge' AS reason FROM ued WHERE kind = 'import' AND dst IN (SELECT path FROM known)
UNION ALL SELECT DISTINCT dst, 'imported_by', src, 'reverse-import-edge' FROM ued WHERE kind = 'import' AND src IN (SELECT path FROM known)
UNION ALL SELECT DISTINCT src, 'tests', dst, 'test-link' FROM ued WHERE kind = 'test' AND dst IN (SELECT path FROM known)
UNION ALL SELECT DISTINCT dst, 'tested_by', src, 'test-link' FROM ued WHERE kind = 'test' AND src IN (SELECT path FROM known)""")
def g2_j2_related(spark, d):
    return graph.related(edges(spark, d), live_files(spark, d))


@query(f"WITH {_GE}, lk AS (SELECT DISTINCT src AS f, dst AS t, CASE kind WHEN 'import' THEN 'imported-by:' ELSE 'tested-by:' END AS how FROM ued WHERE dst IN (SELECT path FROM known) UNION ALL SELECT DISTINCT dst, src, CASE kind WHEN 'import' THEN 'imports:' ELSE 'test-of:' END FROM ued WHERE src IN (SELECT path FROM known)) SELECT t AS path, how || f AS reason FROM lk")
def g4_edge_reasons(spark, d):
    return graph.links(edges(spark, d), live_files(spark, d)).select(F.col("to").alias("path"), F.concat("how", "from").alias("reason"))


@query(f"WITH {SQL_EDGES} SELECT dst AS path, count(*) AS n FROM ued WHERE kind = 'import' GROUP BY dst ORDER BY n DESC, path LIMIT 10")
def a2_centrality(spark, d):
    return graph.centrality(edges(spark, d), 10)


@query("SELECT DISTINCT src, dst, kind FROM edges WHERE src <> dst")
def u4_deduped_edges(spark, d):
    return graph.dedupe(table(spark, d, "edges")).select("src", "dst", "kind")


@query(f"WITH {_GE} SELECT path, 'root' AS role FROM known WHERE path NOT IN (SELECT dst FROM ued WHERE kind = 'import') UNION ALL SELECT path, 'outgoing' FROM known WHERE path IN (SELECT src FROM ued WHERE kind = 'import')")
def u1_a16_roots(spark, d):
    f, e = live_files(spark, d), edges(spark, d)
    return graph.without_dependents(f, e).select("path", F.lit("root").alias("role")).unionByName(graph.with_outgoing(f, e).select("path", F.lit("outgoing").alias("role")))


@query(r"""WITH i AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '(?:import|export) [^;\n]*?from "(\.[^"]+)"', 1)) AS spec FROM documents WHERE regexp_matches(path, '\.(ts|tsx|js)$')),
r AS (SELECT path, list_reduce(list_prepend('', list_concat(list_filter(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), lambda s: s <> ''), string_split(spec, '/'))), lambda acc, s: CASE WHEN s = '.' OR s = '' THEN acc WHEN s = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN acc = '' THEN s ELSE acc || '/' || s END) AS base FROM i),
e AS (SELECT unnest(['.ts', '.tsx', '.d.ts', '.js', '.jsx', '.mts', '.cts', '.mjs', '.cjs']) AS ext, unnest(range(9)) AS k),
t AS (SELECT path, base, base || ext AS dst, k AS pos FROM r, e UNION ALL SELECT path, base, base, 9 FROM r UNION ALL SELECT path, base, base || '/index' || ext, 10 + k FROM r, e),
hit AS (SELECT path, base, min_by(dst, pos) AS dst FROM t WHERE dst IN (SELECT path FROM documents) GROUP BY path, base)
SELECT DISTINCT path AS src, dst, 'import' AS kind FROM hit WHERE path <> dst""")
def j6_script_edges(spark, d):
    docs = table(spark, d, "documents")
    return graph.script_edges(docs, docs.select("path"))


_PARTS = lambda c: f"list_filter(string_split(regexp_replace({c}, '/?[^/]*$', ''), '/'), lambda s: s <> '')"


@query(rf"""WITH {SQL_SYMBOLS}, types AS (SELECT DISTINCT repo, path, name FROM usy WHERE kind IN ('class', 'interface') AND path LIKE '%.cs'),
used AS (SELECT DISTINCT source AS repo, path, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM documents WHERE path LIKE '%.cs'),
j AS (SELECT u.path, u.name, t.path AS dst, {_PARTS('u.path')} AS a, {_PARTS('t.path')} AS b FROM used u JOIN types t ON u.name = t.name AND u.repo = t.repo WHERE NOT EXISTS (SELECT 1 FROM types o WHERE o.path = u.path AND o.name = u.name)),
n AS (SELECT path, name, dst, len(a) + len(b) - 2 * len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: list_slice(a, 1, i) = list_slice(b, 1, i))) AS far FROM j),
near AS (SELECT path, dst FROM n QUALIFY row_number() OVER (PARTITION BY path, name ORDER BY far, dst) = 1)
SELECT DISTINCT path AS src, dst, 'import' AS kind FROM near WHERE path <> dst""")
def j5_j3_w4_csharp_edges(spark, d):
    types = symbols(spark, d).filter("kind IN ('class', 'interface') AND path LIKE '%.cs'").select("repo", "path", "name")
    return graph.csharp_edges(table(spark, d, "documents").withColumn("repo", F.col("source")), types)


@query(rf"""WITH {_GE}, t AS (SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/?[^/]*$', '') AS folder FROM live WHERE kind = 'test'),
s AS (SELECT *, regexp_replace(name, '\.[^.]*$', '') AS stem, regexp_extract(name, '(\.[^.]*)$', 1) AS ext FROM t),
b AS (SELECT path, folder, ext, CASE WHEN lower(stem) LIKE '%.test' OR lower(stem) LIKE '%.spec' OR stem LIKE '%Tests' THEN left(stem, length(stem) - 5) WHEN stem LIKE '%Test' THEN left(stem, length(stem) - 4) END AS base FROM s),
c AS (SELECT path, folder || '/' || base || ext AS dst FROM b WHERE base IS NOT NULL UNION ALL SELECT path, regexp_replace(folder, '/__tests__$', '') || '/' || base || ext FROM b WHERE base IS NOT NULL AND folder LIKE '%/__tests__'),
i AS (SELECT src AS path, dst FROM ued WHERE kind = 'import' AND src IN (SELECT path FROM t) AND dst IN (SELECT path FROM live WHERE kind <> 'test'))
SELECT DISTINCT path AS src, dst, 'test' AS kind FROM (SELECT * FROM c WHERE dst IN (SELECT path FROM known) UNION ALL SELECT * FROM i) WHERE path <> dst""")
def j7_test_edges(spark, d):
    return graph.test_edges(live_files(spark, d), edges(spark, d))


# -- architecture


@query(f"WITH {SQL_FILES} SELECT coalesce(language, 'none') AS language, count(*) AS files, sum(line_count)::BIGINT AS loc FROM live GROUP BY 1")
def a3_languages(spark, d):
    return architecture.languages(live_files(spark, d))


@query(f"""WITH {SQL_FILES}, up AS (SELECT unnest(list_transform(range(0, len(string_split(path, '/'))), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))) AS dir, line_count FROM live)
SELECT dir, (CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END)::INT AS depth, count(*) AS files, sum(line_count)::BIGINT AS loc FROM up GROUP BY dir""")
def a4_directory_tree(spark, d):
    return architecture.tree(live_files(spark, d))


@query(f"""WITH {_GE} SELECT DISTINCT path FROM live WHERE lower(regexp_extract(path, '[^/]*$')) IN ({', '.join(repr(n) for n in architecture.ENTRY_NAMES)})
OR (kind = 'source' AND path NOT IN (SELECT dst FROM ued WHERE kind = 'import') AND path IN (SELECT src FROM ued WHERE kind = 'import'))""")
def j16_entrypoints(spark, d):
    return architecture.entrypoints(live_files(spark, d), edges(spark, d))


@query(f"""WITH {_GE}, c AS (SELECT dst AS path, count(*) AS n FROM ued WHERE kind = 'import' AND dst IN (SELECT path FROM known) GROUP BY dst ORDER BY n DESC, path LIMIT 5)
SELECT path, CASE WHEN n < 100 THEN n ELSE (floor(n / (10 ^ (length(n::VARCHAR) - 2)) + 0.5) * (10 ^ (length(n::VARCHAR) - 2)))::BIGINT END AS n FROM c""")
def q9_o8_key_files(spark, d):
    return architecture.key_files(live_files(spark, d), edges(spark, d))


@query(f"WITH {SQL_FILES}, {SQL_SYMBOLS}, {SQL_EDGES} SELECT 'files' AS what, count(*) AS n FROM live UNION ALL SELECT 'symbols', count(*) FROM usy UNION ALL SELECT 'edges', count(*) FROM ued UNION ALL SELECT 'chunks', count(DISTINCT chunk_id) FROM chunks")
def a1_s7_counts(spark, d):
    parts = [("files", live_files(spark, d)), ("symbols", symbols(spark, d)), ("edges", edges(spark, d)), ("chunks", chunks(spark, d))]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# -- identity


@query(f"""WITH {SQL_FILES}, r AS (SELECT repo, path, left(sha256(path), 3) AS bucket, strlen(path) || ':' || path || strlen(content_hash) || ':' || content_hash AS rec FROM live WHERE content_hash IS NOT NULL),
b AS (SELECT repo, bucket, sha256(string_agg(strlen(rec) || ':' || rec, '' ORDER BY path)) AS h FROM r GROUP BY repo, bucket),
j AS (SELECT repo, string_agg(bucket || h, '' ORDER BY bucket) AS all_ FROM b GROUP BY repo)
SELECT repo, sha256(strlen('content_state.tree') || ':content_state.tree' || strlen(all_) || ':' || all_) AS state FROM j""")
def a14_content_state(spark, d):
    from ..operators.identity import content_state

    return content_state(live_files(spark, d).filter("content_hash IS NOT NULL"))


# -- changes

_DIFF = f"{SQL_FILES}, df AS (SELECT coalesce(b.path, l.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'deleted' WHEN b.content_hash IS DISTINCT FROM l.content_hash THEN 'modified' ELSE 'unchanged' END AS status FROM before b FULL JOIN live l ON b.path = l.path)"


@query(f"WITH {_DIFF} SELECT * FROM df")
def j8_j14_changed(spark, d):
    return changes.diff(live_files(spark, d, 1), live_files(spark, d))


@query(f"""WITH {_DIFF}, {SQL_EDGES}, t AS (SELECT DISTINCT src AS path, CASE kind WHEN 'test' THEN 'test-of:' ELSE 'imports:' END || dst AS reason FROM ued JOIN df ON dst = df.path AND status IN ('modified', 'deleted'))
SELECT path, (CASE WHEN count(*) > 2 THEN 3 ELSE count(*) END)::INT AS reasons FROM t WHERE path NOT IN (SELECT path FROM df WHERE status <> 'unchanged') GROUP BY path""")
def j9_impacted(spark, d):
    i = changes.impacted(changes.diff(live_files(spark, d, 1), live_files(spark, d)), edges(spark, d))
    return i.select("path", F.size("reasons").alias("reasons"))


# -- memory

_FOLD = """m0 AS (SELECT DISTINCT ON (line_no) * FROM memory_log),
m1 AS (SELECT *, coalesce(deleted, false) AS gone FROM m0 WHERE id IS NOT NULL AND (coalesce(deleted, false) OR (kind IN ('note', 'decision', 'constraint') AND length(trim(coalesce(text, ''))) > 0))),
m2 AS (SELECT *, row_number() OVER w AS n, max(gone::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS dead FROM m1 WINDOW w AS (PARTITION BY repo, id ORDER BY line_no DESC)),
mem AS (SELECT m2.* EXCLUDE (n, dead, gone, deleted), first_line FROM m2 JOIN (SELECT repo, id, min(line_no) AS first_line FROM m2 WHERE dead = 0 GROUP BY repo, id) USING (repo, id) WHERE n = 1 AND NOT gone)"""


def _memory(spark, d):
    return memory.fold(table(spark, d, "memory_log"))


@query(f"WITH {_FOLD} SELECT repo, id, kind, text, line_no, first_line FROM mem")
def w7_memory_fold(spark, d):
    return _memory(spark, d).select("repo", "id", "kind", "text", "line_no", "first_line")


_STALE = f"""{_FOLD}, {SQL_FILES}, linked AS (SELECT repo, id, unnest(map_entries(files)).key AS path, unnest(map_entries(files)).value AS given FROM mem),
st AS (SELECT k.repo, k.id, bool_or(coalesce(NOT starts_with(lower(l.content_hash), lower(k.given)), true)) AS bad FROM linked k LEFT JOIN live l USING (repo, path) GROUP BY 1, 2),
stale AS (SELECT mem.repo, mem.id, coalesce(bad, false) AS stale FROM mem LEFT JOIN st USING (repo, id))"""


@query(f"WITH {_STALE} SELECT * FROM stale")
def j12_stale_memories(spark, d):
    return memory.staleness(_memory(spark, d), live_files(spark, d))


_FOLDED = f"translate(lower(coalesce(text, '')), '{S.ACCENTED}', '{S.PLAIN}')"
_WORDS = r"list_filter(string_split_regex(" + _FOLDED + r", '[^\p{L}\p{N}\p{Co}]+'), lambda t: t <> '')"
_GAIN = " + ".join(
    f"CASE WHEN list_contains({_WORDS}, '{t}') THEN 1.0 WHEN list_contains(coalesce(tags, []), '{t}') THEN 1.0 WHEN len(list_filter(coalesce(map_keys(files), []), lambda p: contains(lower(p), '{t}'))) > 0 THEN 0.5 ELSE 0.0 END" for t in TERMS
)


@query(f"WITH {_FOLD} SELECT repo, id, floor(({_GAIN}) / {len(TERMS)} * 1e4 + 0.5) / 1e4 AS score FROM mem WHERE ({_GAIN}) > 0")
def t9_memory_match(spark, d):
    return memory.match(_memory(spark, d), TERMS).filter("score > 0").select("repo", "id", S.round4(F.col("score")).alias("score"))


@query(f"WITH {_STALE}, s AS (SELECT mem.*, ({_GAIN}) / {len(TERMS)} AS score FROM mem WHERE session IS NULL) SELECT repo, id, stale, floor(score * 1e4 + 0.5) / 1e4 AS score FROM s JOIN stale USING (repo, id) WHERE score > 0 ORDER BY s.score DESC, created DESC, id, repo LIMIT 10")
def q11_f9_memory_search(spark, d):
    return memory.search(_memory(spark, d), live_files(spark, d), TERMS).select("repo", "id", "stale", S.round4(F.col("score")).alias("score"))


@query(f"WITH {_FOLD} SELECT repo, id, created FROM mem WHERE session IS NULL AND kind = 'decision' ORDER BY created DESC, id, repo LIMIT 10")
def o3_memory_list(spark, d):
    return memory.search(_memory(spark, d), live_files(spark, d), kind="decision").select("repo", "id", "created")


@query(f"""WITH {_FOLD}, {sql_ranked(TERMS)}, mx AS (SELECT max(adjusted) AS m FROM ranked), lk2 AS (SELECT repo, id, unnest(map_keys(files)) AS path FROM mem),
ov AS (SELECT lk2.repo, lk2.id, max(adjusted / m) AS overlap FROM lk2 JOIN ranked USING (path), mx GROUP BY 1, 2),
bm AS (SELECT mem.repo, mem.id, floor((0.7 * (({_GAIN}) / {len(TERMS)}) + 0.3 * coalesce(overlap, 0.0)) * 1e9 + 0.5) / 1e9 AS s FROM mem LEFT JOIN ov USING (repo, id) WHERE session IS NULL)
SELECT repo, id, floor(s * 1e4 + 0.5) / 1e4 AS score FROM bm WHERE s > 0 ORDER BY s DESC, id, repo LIMIT 3""")
def t10_o4_j13_bundle_memories(spark, d):
    return memory.for_bundle(_memory(spark, d), _ranked(spark, d), TERMS).select("repo", "id", S.round4(F.col("bundle_score")).alias("score"))


# -- usage

_U = "u AS (SELECT DISTINCT ON (usage_id) * FROM usage_log), ok AS (SELECT * FROM u WHERE v = 1 AND ts IS NOT NULL AND length(command) > 0 AND source IN ('cli', 'mcp') AND served >= 0 AND replaced >= 0)"
_T = "count(*) AS calls, sum(served)::BIGINT AS served, sum(replaced)::BIGINT AS replaced, (sum(replaced) - sum(served))::BIGINT AS saved"


def _usage(spark, d):
    return usage.valid(table(spark, d, "usage_log"))


@query(f"WITH {_U} SELECT {_T}, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM ok")
def a5_s12_usage_totals(spark, d):
    return usage.totals(_usage(spark, d))


@query(f"WITH {_U} SELECT command, {_T} FROM ok GROUP BY command")
def a5_usage_by_command(spark, d):
    return usage.by_command(_usage(spark, d))


@query(f"WITH {_U} SELECT * FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, {_T} FROM ok GROUP BY 1 ORDER BY 1 DESC LIMIT 14)")
def w8_usage_days(spark, d):
    return usage.by_day(_usage(spark, d))


@query(f"WITH {SQL_FILES}, r AS (SELECT path, greatest(coalesce(l.token_count, 0), 0) AS avoided FROM live l JOIN before b USING (path) WHERE l.content_hash = b.content_hash) SELECT count(DISTINCT path) AS files, coalesce(sum(avoided), 0)::BIGINT AS avoided FROM r")
def a9_reuse(spark, d):
    l, b = live_files(spark, d), live_files(spark, d, 1).select("path", F.col("content_hash").alias("h"))
    same = l.join(b, "path").filter("content_hash = h").select("path", F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)).cast("long").alias("avoided"))
    return usage.reuse(same)


@query(f"WITH {SQL_FILES} SELECT path, CASE WHEN path IN (SELECT path FROM symbols) THEN greatest(coalesce(token_count, 0), 0) ELSE 0 END::BIGINT AS replaced FROM live")
def a13_replaced_tokens(spark, d):
    return usage.replaced_by_outline(live_files(spark, d), symbols(spark, d))


# -- sets


@query(f"WITH {SQL_FILES}, a AS (SELECT path, content_hash FROM before WHERE content_hash IS NOT NULL), b AS (SELECT path, content_hash FROM live WHERE content_hash IS NOT NULL) SELECT coalesce(b.path, a.path) AS path, coalesce(b.content_hash, a.content_hash) AS known FROM a FULL JOIN b ON a.path = b.path")
def u3_merged_known(spark, d):
    old = live_files(spark, d, 1).filter("content_hash IS NOT NULL").select("path", F.col("content_hash").alias("old"))
    new = live_files(spark, d).filter("content_hash IS NOT NULL").select("path", F.col("content_hash").alias("new"))
    return old.join(new, "path", "full_outer").select("path", F.coalesce("new", "old").alias("known"))


@query(f"WITH {SQL_FILES} SELECT DISTINCT left(content_hash, 43) AS receipt FROM (SELECT content_hash FROM live UNION ALL SELECT content_hash FROM before) WHERE content_hash IS NOT NULL")
def u2_merged_receipts(spark, d):
    r = lambda back: live_files(spark, d, back).select(F.substring("content_hash", 1, 43).alias("receipt"))
    return r(0).unionByName(r(1)).filter(S.is_receipt(F.col("receipt"))).distinct()


@query()
def a6_u5_context_signals(spark, d):
    sig, _, _ = context.candidates(table(spark, d, "chunks"), live_files(spark, d), TERMS)
    return sig.select("path", S.round4(F.col("fts")).alias("fts"), S.round4(F.col("symbol")).alias("symbol"), "reasons")
