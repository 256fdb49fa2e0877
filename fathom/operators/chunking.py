"""Cutting texts into chunks: fixed blocks of lines, Markdown sections, and one chunk for each symbol.

All of it is higher-order functions over the lines of one text, so a text is never spread over rows before
its chunks are complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

PREAMBLE, BLOCK = 20, 60


def generic(texts: DataFrame) -> DataFrame:
    """(path, kind, start_line, end_line, heading, content): lines 1 to 20, then blocks of 60.

    Null and empty texts have no chunks.
    """
    t = texts.filter(F.length("text") > 0).select("path", S.lines(F.col("text")).alias("l"))
    n = F.size("l")
    starts = F.concat(F.array(F.lit(1)), F.when(n > PREAMBLE, F.sequence(F.lit(PREAMBLE + 1), n, F.lit(BLOCK))).otherwise(F.array().cast("array<int>")))
    c = t.select("path", "l", F.explode(starts).alias("start_line"))
    first = F.col("start_line") == 1
    size = F.when(first, PREAMBLE).otherwise(BLOCK)
    return c.select(
        "path", F.when(first, "preamble").otherwise("block").alias("kind"), "start_line", F.least(F.col("start_line") + size - 1, F.size("l")).alias("end_line"),
        F.lit(None).cast("string").alias("heading"), F.array_join(F.slice("l", F.col("start_line"), size), "\n").alias("content"),
    )


def markdown(texts: DataFrame) -> DataFrame:
    """Sections at lines of one to six # and a blank; what is before the first one is the preamble.

    Code fences are not looked at.
    """
    t = texts.filter(F.length("text") > 0).select("path", S.lines(F.col("text")).alias("l"))
    is_head = lambda x: x.rlike("^#{1,6} ")
    at = F.filter(F.transform("l", lambda x, i: F.when(is_head(x), i + 1)), lambda i: i.isNotNull())
    t = t.withColumn("at", at).filter("size(l) > 0")
    starts = F.when((F.size("at") > 0) & (F.try_element_at("at", F.lit(1)) == 1), F.col("at")).otherwise(F.concat(F.array(F.lit(1)), F.col("at")))
    t = t.withColumn("s", starts)
    c = t.select("path", "l", "s", F.posexplode("s").alias("i", "start_line"))
    end = F.coalesce(F.try_element_at("s", F.col("i") + 2) - 1, F.size("l"))
    line = F.try_element_at("l", F.col("start_line"))
    head = is_head(line)
    return c.select(
        "path", F.when(head, "markdownheading").otherwise("preamble").alias("kind"), "start_line", end.alias("end_line"),
        F.when(head, F.regexp_replace(line, r"^[#\s]+|[#\s]+$", "")).alias("heading"), F.array_join(F.slice("l", F.col("start_line"), end - F.col("start_line") + 1), "\n").alias("content"),
    )


def symbol_chunks(symbols: DataFrame) -> DataFrame:
    """A chunk for each symbol: name, name parts, kind, signature and doc on lines of their own."""
    parts = F.array_join(S.split_identifier(F.col("name")), " ")
    body: Column = F.concat_ws("\n", "name", parts, "kind", "signature", "doc")
    return symbols.select("path", F.lit("symbol").alias("kind"), "start_line", "end_line", F.col("name").alias("heading"), body.alias("content"))


def chunk(texts: DataFrame) -> DataFrame:
    """All content chunks of (path, text): Markdown by sections, anything else by blocks."""
    md = S.detect_language(F.col("path")) == "markdown"
    return markdown(texts.filter(md)).unionByName(generic(texts.filter(~md)))
