"""Reports over the usage log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCES = ("cli", "mcp")


def valid(log: DataFrame) -> DataFrame:
    """Records of version 1 from a known source with a time, a command and counts that aren't negative, each once."""
    one = log.dropDuplicates(["usage_id"]) if "usage_id" in log.columns else log
    return one.filter((F.col("v") == 1) & F.col("ts").isNotNull() & (F.length("command") > 0) & F.col("source").isin(*SOURCES) & (F.col("served") >= 0) & (F.col("replaced") >= 0))


def _totals():
    return [F.count("*").alias("calls"), F.sum("served").alias("served"), F.sum("replaced").alias("replaced"), (F.sum("replaced") - F.sum("served")).alias("saved")]


def totals(records: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return records.agg(*_totals(), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def by_command(records: DataFrame) -> DataFrame:
    return records.groupBy("command").agg(*_totals()).orderBy("command")


def by_day(records: DataFrame, last: int = 14) -> DataFrame:
    """The last ``last`` days that have records, oldest first."""
    days = records.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(*_totals())
    return days.orderBy(F.desc("day")).limit(last).orderBy("day")


def reuse(units: DataFrame) -> DataFrame:
    """(files, avoided): distinct files of reused (path, avoided) units and the sum of their greatest saving."""
    return units.groupBy("path").agg(F.max("avoided").alias("m")).agg(F.count("*").alias("files"), F.coalesce(F.sum("m"), F.lit(0)).alias("avoided"))


def replaced_by_outline(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, replaced): a file's tokens where an outline of it shows any symbol, else 0."""
    some = symbols.select("path").distinct().withColumn("any", F.lit(True))
    return files.join(some, "path", "left").select("path", F.when(F.col("any"), F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0))).otherwise(0).cast("long").alias("replaced"))
