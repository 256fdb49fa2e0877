"""The usage log as a stream: daily totals per command that grow as records arrive, late ones included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import usage
from ..sources.logs import USAGE_SCHEMA


def records(spark: SparkSession, folder: str, fmt: str = "json", schema: str = USAGE_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """Valid records of a growing folder; times without a zone are taken as UTC."""
    raw = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(stream: DataFrame, lateness: str = "14 days") -> DataFrame:
    """(day, command, calls, served, replaced) with each usage_id once within the time that lateness allows."""
    marked = stream.withWatermark("ts", lateness)
    if "usage_id" in stream.columns:
        marked = marked.dropDuplicatesWithinWatermark(["usage_id"])
    ok = marked.filter((F.col("v") == 1) & F.col("source").isin(*usage.SOURCES) & (F.col("served") >= 0) & (F.col("replaced") >= 0) & (F.length("command") > 0))
    w = F.window("ts", "1 day")
    return ok.groupBy(w, "command").agg(F.count("*").alias("calls"), F.sum("served").alias("served"), F.sum("replaced").alias("replaced")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "command", "calls", "served", "replaced")


def start(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write closed days to Parquet; the checkpoint must lie in storage that all executors share."""
    return df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
