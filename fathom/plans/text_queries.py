"""Queries of chunking, symbols, comments, differences and token counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import textops
from ..operators import chunking
from ..sources.tables import SQL_SYMBOLS, symbols, table
from .registry import query


def _docs(spark, d):
    return table(spark, d, "documents").select("path", "text")


_LINES = r"CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)) END"
_MD = r"regexp_matches(lower(path), '\.mdx?$')"


@query(rf"""WITH t AS (SELECT path, {_LINES} AS l FROM documents WHERE text <> '' AND NOT {_MD}),
s AS (SELECT path, l, unnest(list_concat([1::BIGINT], range(21, len(l) + 1, 60))) AS s FROM t)
SELECT path, CASE WHEN s = 1 THEN 'preamble' ELSE 'block' END AS kind, s::INT AS start_line, least(s + CASE WHEN s = 1 THEN 20 ELSE 60 END - 1, len(l))::INT AS end_line, sha256(array_to_string(list_slice(l, s, s + CASE WHEN s = 1 THEN 20 ELSE 60 END - 1), chr(10))) AS content_hash FROM s""")
def x2_generic_chunks(spark, d):
    c = chunking.generic(_docs(spark, d).filter(S.detect_language(F.col("path")) != "markdown"))
    return c.select("path", "kind", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query(rf"""WITH t AS (SELECT path, {_LINES} AS l FROM documents WHERE text <> '' AND {_MD}), u AS (SELECT path, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^#{{1,6}} ')) AS hs FROM t WHERE len(l) > 0),
s AS (SELECT path, l, CASE WHEN len(hs) > 0 AND hs[1] = 1 THEN hs ELSE list_concat([1::BIGINT], hs) END AS s FROM u), x AS (SELECT path, l, s, unnest(range(1, len(s) + 1)) AS i FROM s),
y AS (SELECT path, l, s[i] AS a, coalesce(s[i + 1] - 1, len(l)) AS b FROM x)
SELECT path, a::INT AS start_line, b::INT AS end_line, CASE WHEN regexp_matches(l[a], '^#{{1,6}} ') THEN 'markdownheading' ELSE 'preamble' END AS kind, CASE WHEN regexp_matches(l[a], '^#{{1,6}} ') THEN regexp_replace(l[a], '^[#\s]+|[#\s]+$', '', 'g') END AS heading FROM y""")
def x3_markdown_chunks(spark, d):
    c = chunking.markdown(_docs(spark, d).filter(S.detect_language(F.col("path")) == "markdown"))
    return c.select("path", "start_line", "end_line", "kind", "heading")


_split = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'))"
_PARTS = f"list_filter(string_split({_split}, ' '), lambda x: x <> '')"


@query(f"WITH {SQL_SYMBOLS}, p AS (SELECT *, {_PARTS} AS q FROM usy) SELECT path, start_line, name AS heading, sha256(concat_ws(chr(10), name, array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i), ' '), kind, signature, doc)) AS content_hash FROM p")
def x6_symbol_chunks(spark, d):
    return chunking.symbol_chunks(symbols(spark, d)).select("path", "start_line", "heading", F.sha2("content", 256).alias("content_hash"))


@query(f"WITH {SQL_SYMBOLS} SELECT path, name, start_line, kind IN ('method', 'route') AS member FROM usy WHERE kind IN ('function', 'method', 'route', 'class', 'interface', 'property') AND path IN (SELECT path FROM documents WHERE text IS NOT NULL)")
def x8_x10_symbols_found(spark, d):
    """Of the declarations that the symbols table lists, those that the extractor finds at the same place."""
    found = textops.symbols(_docs(spark, d)).select("path", "name", "start_line", F.col("kind").isin("method", "route").alias("member")).distinct()
    return found.join(symbols(spark, d).select("path", "name", "start_line", "symbol_id"), ["path", "name", "start_line"]).drop("symbol_id")


@query()
def x8_x12_symbols(spark, d):
    return textops.symbols(_docs(spark, d))


@query()
def x14_stripped_comments(spark, d):
    s = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", textops.strip_comments(F.col("text")).alias("s"))
    return s.select("doc_id", F.length("s.text").alias("n_chars"), "s.changed")


@query()
def x15_x17_token_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", textops.token_count(t).alias("n_tokens"))


@query()
def x19_hunks(spark, d):
    """Differences between each document and the same without its comment lines."""
    pairs = table(spark, d, "documents").filter("text IS NOT NULL").select("path", F.col("text").alias("old"), textops.strip_comments(F.col("text")).getField("text").alias("new"))
    return textops.hunks(pairs).select("path", "old_start", "old_lines", "new_start", "new_lines")
