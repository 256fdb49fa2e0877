"""Relevance of ranked results against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, labels: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 8)) -> DataFrame:
    """(query, recall_k..., ndcg_8, leaked) from (query, path, rank) and (query, path, place, forbidden).

    ``place`` orders the wanted paths from 0; the gain of one is the number of wanted paths less its place.
    """
    want = labels.filter("NOT forbidden")
    n = want.groupBy("query").agg(F.count("*").alias("n"))
    gain = want.join(n, "query").select("query", "path", (F.col("n") - F.col("place")).alias("gain"))
    hit = gain.join(ranked, ["query", "path"], "left")
    ideal = gain.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), "path"))).filter("i <= 8")
    ideal = ideal.groupBy("query").agg(F.sum(F.col("gain") / F.log2(F.col("i") + 1)).alias("best"))
    bad = ranked.filter("rank <= 8").join(labels.filter("forbidden").select("query", "path"), ["query", "path"]).groupBy("query").agg(F.count("*").alias("bad"))
    aggs = [F.avg((F.coalesce(F.col("rank") <= k, F.lit(False))).cast("double")).alias(f"recall_{k}") for k in cutoffs]
    got = F.sum(F.when(F.col("rank") <= 8, F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    out = hit.groupBy("query").agg(*aggs, got.alias("got")).join(ideal, "query").join(bad, "query", "left")
    return out.select("query", *(f"recall_{k}" for k in cutoffs), (F.col("got") / F.col("best")).alias("ndcg_8"), (F.coalesce("bad", F.lit(0)) > 0).alias("leaked"))


def line_density(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, density): the part of the delivered lines that labelled ranges (query, path, start, end) cover."""
    line = lambda df, name: df.select("query", "path", F.explode(F.sequence("start", "end")).alias("line")).distinct().withColumn(name, F.lit(1))
    j = line(spans, "given").join(line(wanted, "good"), ["query", "path", "line"], "left")
    return j.groupBy("query").agg((F.count("good") / F.count("*")).alias("density"))
