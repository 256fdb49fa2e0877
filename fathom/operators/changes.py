"""Comparing an index with a newer state of the files, and what a change touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def diff(index: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status) of all paths of two (path, content_hash) states: added, modified, deleted or unchanged.

    A full outer join on the path. Hashes that are both null are taken as equal.
    """
    a = index.select("path", F.col("content_hash").alias("old"), F.lit(True).alias("was"))
    b = now.select("path", F.col("content_hash").alias("new"), F.lit(True).alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def impacted(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, reasons): files that import or test a modified or deleted file and are not changed themselves."""
    hit = changes.filter(F.col("status").isin("modified", "deleted")).select(F.col("path").alias("dst"))
    why = F.concat(F.when(F.col("kind") == "test", "test-of:").otherwise("imports:"), "dst")
    touched = edges.join(hit, "dst").select(F.col("src").alias("path"), why.alias("reason")).distinct()
    changed = changes.filter("status <> 'unchanged'").select("path")
    return touched.join(changed, "path", "left_anti").groupBy("path").agg(S.compress_reasons(F.array_sort(F.collect_list("reason"))).alias("reasons"))
