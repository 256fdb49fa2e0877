"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.context import path_signal
from ..sources.tables import SQL_EDGES, SQL_FILES, SQL_SYMBOLS, edges, live_files, symbols, table
from .registry import query

TERMS = ["courier", "session", "token"]
IGNORE = ["# build output", "node_modules", "dist/", "/obj", "*.min.js", "*.log", "!keep.log", "docs/**/notes", "static/*.js"]

_ext = r"regexp_extract(regexp_extract(path, '[^/]*$'), '(\.[^.]*)$', 1)"
_name = "regexp_extract(path, '[^/]*$')"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_TEST = f"(contains(path, '/__tests__/') OR contains(path, '/__mocks__/') OR contains(path, '/Tests/') OR starts_with(path, 'Tests/') OR contains(lower({_name}), '.test.') OR contains(lower({_name}), '.spec.') OR {_name} LIKE '%Tests.cs' OR {_name} LIKE '%Test.cs')"
_KIND = f"""CASE WHEN {_TEST} THEN 'test' WHEN lower({_ext}) IN {_in(S.DOC_ENDINGS)} OR lower({_name}) = 'readme' THEN 'doc'
  WHEN lower({_ext}) IN {_in(S.CONFIG_ENDINGS)} OR {_name} = '.gitignore' OR starts_with(lower({_name}), 'appsettings') OR starts_with(lower({_name}), 'tsconfig') THEN 'config'
  WHEN lower({_ext}) IN {_in(S.SOURCE_ENDINGS)} THEN 'source' ELSE 'other' END"""
_LANGUAGE = "CASE " + " ".join(f"WHEN lower({_ext}) IN {_in(e)} THEN '{k}'" for k, e in S.LANGUAGES.items()) + " ELSE 'none' END"
_VENDOR = "(contains(lower(path), '.min.') OR contains(lower(path), '.generated.') OR contains(lower(path), '/vendor/') OR contains(lower(path), '/dist/') OR starts_with(lower(path), 'vendor/'))"


@query(f"SELECT doc_id, path, {_KIND} AS kind, {_LANGUAGE} AS language FROM documents")
def f1_f2_classify(spark, d):
    p = F.col("path")
    return table(spark, d, "documents").select("doc_id", "path", S.classify_kind(p).alias("kind"), S.detect_language(p).alias("language"))


@query(f"SELECT doc_id, {_VENDOR} AS vendor, lower({_ext}) IN {_in(S.BINARY_ENDINGS)} AS binary_ending FROM documents")
def f3_s5_path_flags(spark, d):
    p = F.col("path")
    return table(spark, d, "documents").select("doc_id", S.is_vendor(p).alias("vendor"), S.is_binary_ending(p).alias("binary_ending"))


@query(rf"SELECT doc_id, regexp_replace(path, '/?[^/]*$', '') AS dir, {_name} AS name, regexp_replace({_name}, '\.[^.]*$', '') AS stem, {_ext} AS ext FROM documents")
def f4_path_parts(spark, d):
    p = F.col("path")
    return table(spark, d, "documents").select("doc_id", S.dirname(p).alias("dir"), S.basename(p).alias("name"), S.stem(p).alias("stem"), S.ext(p).alias("ext"))


@query(rf"""WITH m AS (SELECT path, {' + '.join(f"contains(lower(path), '{t}')::INT" for t in TERMS)} AS matches, regexp_replace(lower({_name}), '\.[^.]*$', '') IN {_in(TERMS)} AS exact FROM documents)
SELECT path, (matches + CASE WHEN exact THEN 2 ELSE 0 END)::DOUBLE AS path_score, CASE WHEN exact THEN 'path-name-match' ELSE 'path-match' END AS reason FROM m WHERE matches > 0 OR exact""")
def f5_path_match(spark, d):
    return path_signal(table(spark, d, "documents").select("path"), TERMS)


@query(f"""WITH {SQL_FILES}
SELECT l.path, b.content_hash IS NOT NULL AND length(left(b.content_hash, 12)) >= 8 AND starts_with(lower(l.content_hash), lower(left(b.content_hash, 12))) AS known
FROM live l JOIN before b USING (repo, path) WHERE l.content_hash IS NOT NULL""")
def f6_known_files(spark, d):
    old = live_files(spark, d, 1).select("repo", "path", S.short_hash(F.col("content_hash")).alias("given"))
    j = live_files(spark, d).filter("content_hash IS NOT NULL").join(old, ["repo", "path"])
    return j.select("path", F.coalesce(S.hash_matches(F.col("content_hash"), F.col("given")), F.lit(False)).alias("known"))


_canon = "sha256(strlen('r1') || ':' || 'r1' || strlen(path) || ':' || path || strlen(content_hash) || ':' || content_hash)"


@query(f"WITH {SQL_FILES} SELECT path, translate(rtrim(to_base64(unhex({_canon})), '='), '+/', '-_') AS receipt, true AS well_formed FROM live WHERE content_hash IS NOT NULL")
def f7_receipts(spark, d):
    r = S.receipt(S.canonical_hash(F.lit("r1"), F.col("path"), F.col("content_hash")))
    return live_files(spark, d).filter("content_hash IS NOT NULL").select("path", r.alias("receipt")).withColumn("well_formed", S.is_receipt(F.col("receipt")))


@query(f"""WITH {SQL_SYMBOLS}
SELECT a.symbol_id AS outer_id, b.symbol_id AS inner_id FROM usy a JOIN usy b ON a.path = b.path AND a.kind IN ('class', 'interface')
AND a.start_line <= b.start_line AND a.end_line >= b.end_line AND (a.start_line < b.start_line OR a.end_line > b.end_line)""")
def f8_containment(spark, d):
    s = symbols(spark, d).select("symbol_id", "path", "kind", "start_line", "end_line")
    a, b = s.filter(F.col("kind").isin("class", "interface")).alias("a"), s.alias("b")
    inside = S.strictly_contains(F.col("a.start_line"), F.col("a.end_line"), F.col("b.start_line"), F.col("b.end_line"))
    return a.join(b, (F.col("a.path") == F.col("b.path")) & inside).select(F.col("a.symbol_id").alias("outer_id"), F.col("b.symbol_id").alias("inner_id"))


@query(r"SELECT symbol_id, array_to_string(list_filter(string_split_regex(lower(signature), '[^\p{L}\p{Nd}]+'), lambda x: x <> ''), ' ') AS tokens FROM (SELECT DISTINCT symbol_id, signature FROM symbols) WHERE signature IS NOT NULL")
def f11_query_tokens(spark, d):
    return table(spark, d, "symbols").select("symbol_id", "signature").distinct().filter("signature IS NOT NULL").select("symbol_id", F.array_join(S.tokenize(F.col("signature")), " ").alias("tokens"))


def _ignore_sql() -> str:
    def verdict(p: str, is_dir: bool) -> str:
        cases = [f"WHEN regexp_matches({p}, '{r}') THEN {str(not neg).lower()}" for r, neg, only in reversed(S.ignore_rules(IGNORE)) if is_dir or not only]
        return "CASE " + " ".join(cases) + " ELSE false END"

    dirs = "list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))"
    return f"SELECT doc_id, path, {verdict('path', False)} OR len(list_filter({dirs}, lambda x: {verdict('x', True)})) > 0 AS ignored FROM documents"


@query(_ignore_sql())
def s3_s4_ignored(spark, d):
    return table(spark, d, "documents").select("doc_id", "path", S.is_ignored(F.col("path"), S.ignore_rules(IGNORE)).alias("ignored"))


@query(r"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)))::BIGINT END AS n_lines, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END END AS line_count FROM documents WHERE text IS NOT NULL")
def x1_x4_lines(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(S.lines(t)).cast("long").alias("n_lines"), S.count_lines(t).cast("long").alias("line_count"))


_split = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'))"


@query(f"WITH p AS (SELECT DISTINCT symbol_id, list_filter(string_split({_split}, ' '), lambda x: x <> '') AS q FROM symbols) SELECT symbol_id, array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i), ' ') AS parts FROM p")
def x7_identifier_parts(spark, d):
    return table(spark, d, "symbols").select("symbol_id", "name").distinct().select("symbol_id", F.array_join(S.split_identifier(F.col("name")), " ").alias("parts"))


@query(f"""WITH {SQL_SYMBOLS} SELECT symbol_id, trim(regexp_replace(string_split(string_split(signature, chr(10))[1], '{{')[1], '\\s+', ' ', 'g')) AS signature, left(trim(string_split(doc, chr(10))[1]), 140) AS summary FROM usy""")
def x11_x13_outline_text(spark, d):
    return symbols(spark, d).select("symbol_id", S.signature(F.col("signature")).alias("signature"), S.doc_summary(F.col("doc")).alias("summary"))


@query(f"WITH {SQL_FILES} SELECT path, least(ceil(token_count * 1.2), 2147483647)::BIGINT AS scaled, left(content_hash, 12) AS short_hash FROM live WHERE token_count IS NOT NULL")
def x16_x20_scaled_tokens(spark, d):
    return live_files(spark, d).filter("token_count IS NOT NULL").select("path", S.scale_tokens(F.col("token_count"), 1.2).alias("scaled"), S.short_hash(F.col("content_hash")).alias("short_hash"))


_cents = "floor(abs(n) * 5 / 1e4 + 0.5)::BIGINT"


@query(f"""WITH u AS (SELECT DISTINCT usage_id, served, replaced, replaced - served AS n FROM usage_log WHERE served >= 0)
SELECT usage_id, CASE WHEN n < 0 AND {_cents} > 0 THEN '-' ELSE '' END || '$' || ({_cents} // 100)::VARCHAR || '.' || lpad(({_cents} % 100)::VARCHAR, 2, '0') AS price, CASE WHEN replaced > 0 THEN floor(n * 100.0 / replaced + 0.5)::INT::VARCHAR || '%' ELSE '' END AS percent FROM u""")
def x21_x22_price(spark, d):
    u = table(spark, d, "usage_log").select("usage_id", "served", "replaced").distinct().filter("served >= 0").withColumn("n", F.col("replaced") - F.col("served"))
    return u.select("usage_id", S.price(F.col("n"), 5.0).alias("price"), F.when(F.col("replaced") > 0, F.concat(F.floor(F.col("n") * 100.0 / F.col("replaced") + 0.5).cast("int").cast("string"), F.lit("%"))).otherwise("").alias("percent"))


@query("""WITH t AS (SELECT line_no, unnest(tags) AS tag, len(tags) <= 8 AS few FROM (SELECT DISTINCT line_no, tags FROM memory_log))
SELECT line_no, tag, few AND tag IS NOT NULL AND regexp_matches(lower(trim(tag)), '^[a-z0-9_-]{1,32}$') AS valid FROM t""")
def x23_tags(spark, d):
    m = table(spark, d, "memory_log").select("line_no", "tags").distinct()
    return m.select("line_no", F.explode("tags").alias("tag"), (F.size("tags") <= 8).alias("few")).select("line_no", "tag", (F.col("few") & F.coalesce(S.valid_tag(F.col("tag")), F.lit(False))).alias("valid"))


_parts = lambda c: f"list_filter(string_split(regexp_replace({c}, '/?[^/]*$', ''), '/'), lambda s: s <> '')"


@query(f"""WITH {SQL_EDGES}, s AS (SELECT src, dst, kind, {_parts('src')} AS a, {_parts('dst')} AS b FROM ued),
n AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: list_slice(a, 1, i) = list_slice(b, 1, i))) AS same FROM s)
SELECT src, dst, kind, (len(a) + len(b) - 2 * same)::INT AS distance FROM n""")
def g5_directory_distance(spark, d):
    return edges(spark, d).select("src", "dst", "kind", S.dir_distance(S.dirname(F.col("src")), S.dirname(F.col("dst"))).alias("distance"))


@query(r"""WITH i AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, 'from "(\.[^"]+)"', 1)) AS spec FROM documents),
r AS (SELECT path, spec, list_concat(list_filter(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), lambda s: s <> ''), string_split(spec, '/')) AS parts FROM i)
SELECT path, spec, list_reduce(list_prepend('', parts), lambda acc, s: CASE WHEN s = '.' OR s = '' THEN acc WHEN s = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN acc = '' THEN s ELSE acc || '/' || s END) AS target FROM r""")
def g6_x9_import_targets(spark, d):
    i = table(spark, d, "documents").select("path", F.explode(F.regexp_extract_all("text", F.lit(r'from "(\.[^"]+)"'), 1)).alias("spec")).distinct()
    return i.select("path", "spec", S.resolve_dots(F.concat_ws("/", S.dirname(F.col("path")), "spec")).alias("target"))


_log = "(10 ^ (length(n::VARCHAR) - 2))"


@query(f"WITH {SQL_FILES}, n AS (SELECT repo, sum(line_count)::BIGINT AS n FROM live GROUP BY repo) SELECT repo, n, CASE WHEN n < 100 THEN n ELSE (floor(n / {_log} + 0.5) * {_log})::BIGINT END AS rounded FROM n")
def a15_quantized_sizes(spark, d):
    n = live_files(spark, d).groupBy("repo").agg(F.sum("line_count").alias("n"))
    return n.select("repo", "n", S.quantize(F.col("n")).alias("rounded"))


@query(r"""SELECT settings_id, CASE WHEN starts_with(body, chr(65279)) THEN substr(body, 2) ELSE body END AS text, sha256(body) AS content_hash, contains(left(body, 8000), chr(0)) AS looks_binary FROM (SELECT DISTINCT settings_id, body FROM appsettings) WHERE body IS NOT NULL""")
def s2_s6_decoded_settings(spark, d):
    from ..sources.files import decode_text, looks_binary

    raw = table(spark, d, "appsettings").select("settings_id", F.col("body").cast("binary").alias("content")).distinct().filter("content IS NOT NULL")
    return raw.select("settings_id", decode_text(F.col("content")).alias("text"), F.sha2("content", 256).alias("content_hash"), looks_binary(F.col("content")).alias("looks_binary"))
