"""Session construction and run-wide settings that can be changed at run time."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fathom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow transfer; on a cluster the submitted settings win."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package; on a cluster --py-files does this.

    Arrow batches are bounded by Spark itself, in bytes (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    there = sc.environment.get("PYTHONPATH", "")
    if root not in there.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, there) if x)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    The folder named by ``spark.checkpoint.dir`` is used. Only where none is set (tests on one
    machine) a local one is made.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(?:\[.*\])?", sc.master):  # local-cluster has executors of its own
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"fathom-checkpoint-{os.getpid()}"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys, minimum: int = 12) -> DataFrame:
    """Repartition by ``keys`` into as many parts as the session shuffles into."""
    n = max(minimum, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan of few, large partitions over all cores before costly Python work.

    Inputs with as many partitions as half of the cores, and inputs that a shuffle has made, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString() or 2 * plan.execute().getNumPartitions() > cores:
        return df
    return df.repartition(cores)
