"""Reading the index tables, as they are and as the index sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; projections and filters reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files_at(files: DataFrame, snapshots_back: int = 0) -> DataFrame:
    """The files of each repository in its newest delivery, or so many deliveries before it.

    Paths and hashes come in normal form; of several rows for a path the one indexed last counts, of
    equally late ones the greatest. One shuffle by path; the newest delivery of each repository is a
    small aggregate that Catalyst may broadcast.
    """
    f = files.withColumns({"path": S.norm_path(F.col("path")), "content_hash": S.norm_hash(F.col("content_hash"))})
    order = Window.partitionBy("repo").orderBy(F.desc("snapshot_id"))
    wanted = files.select("repo", "snapshot_id").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") == snapshots_back + 1).drop("n")
    late = Window.partitionBy("repo", "path").orderBy(
        F.desc("indexed_at"), F.desc_nulls_last("content_hash"), F.desc_nulls_last("token_count"), F.desc_nulls_last("kind"), F.desc_nulls_last("language"), F.desc_nulls_last("size_bytes"), F.desc_nulls_last("line_count")
    )
    return f.join(wanted, ["repo", "snapshot_id"]).withColumn("n", F.row_number().over(late)).filter(F.col("n") == 1).drop("n", "indexed_at")


def live_files(spark: SparkSession, d: str, snapshots_back: int = 0) -> DataFrame:
    return files_at(table(spark, d, "files"), snapshots_back)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without repeated rows."""
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols without repeated rows; of rows that differ the greatest counts."""
    cols = ["repo", "path", "name", "kind", "start_line", "end_line", "signature", "doc"]
    one = table(spark, d, "symbols").groupBy("symbol_id").agg(F.max(F.struct(F.col("doc"), *(c for c in cols if c != "doc"))).alias("s"))
    return one.select("symbol_id", *(f"s.{c}" for c in cols))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Links between different paths, each once."""
    return table(spark, d, "edges").filter("src <> dst").dropDuplicates(["repo", "src", "dst", "kind"])


#: The same relations in SQL, to be put after WITH.
SQL_PATH = r"regexp_replace(regexp_replace(trim(path), '[\\/]+', '/', 'g'), '^(\.?/)+', '')"
SQL_FILES = rf"""
f0 AS (SELECT repo, {SQL_PATH} AS path, snapshot_id, kind, language, size_bytes, line_count, nullif(regexp_extract(lower(content_hash), '[0-9a-f]{{64}}'), '') AS content_hash, token_count, indexed_at FROM files),
deliveries AS (SELECT repo, snapshot_id, row_number() OVER (PARTITION BY repo ORDER BY snapshot_id DESC) AS back FROM (SELECT DISTINCT repo, snapshot_id FROM files)),
versions AS (SELECT f0.* EXCLUDE (indexed_at), back FROM f0 JOIN deliveries USING (repo, snapshot_id) WHERE back <= 2
  QUALIFY row_number() OVER (PARTITION BY f0.repo, path, snapshot_id ORDER BY indexed_at DESC, content_hash DESC NULLS LAST, token_count DESC NULLS LAST, kind DESC NULLS LAST, language DESC NULLS LAST, size_bytes DESC NULLS LAST, line_count DESC NULLS LAST) = 1),
live AS (SELECT * EXCLUDE (back) FROM versions WHERE back = 1),
before AS (SELECT * EXCLUDE (back) FROM versions WHERE back = 2)"""
SQL_CHUNKS = "uch AS (SELECT DISTINCT chunk_id, repo, path, kind, start_line, end_line, heading, content FROM chunks)"
SQL_SYMBOLS = "usy AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY doc DESC NULLS LAST) = 1)"
SQL_EDGES = "ued AS (SELECT DISTINCT repo, src, dst, kind FROM edges WHERE src <> dst)"
