"""The shape of repositories: languages, directory tree, central files, entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import graph

# Fixed value: names that start a program or a page.
ENTRY_NAMES = "program.cs main.cs main.ts main.js main.tsx middleware.ts middleware.js page.tsx page.jsx layout.tsx layout.jsx route.ts route.tsx route.js".split()


def languages(files: DataFrame) -> DataFrame:
    """(language, files, loc) in the order of lines, then name."""
    return files.groupBy(F.coalesce("language", F.lit("none")).alias("language")).agg(F.count("*").alias("files"), F.sum("line_count").alias("loc")).orderBy(F.desc("loc"), "language")


def tree(files: DataFrame, depth: int | None = None) -> DataFrame:
    """(dir, depth, files, loc): each file counts in every directory above it, the root '' included.

    Partial aggregation happens before the shuffle, so the root is no hot key.
    """
    up = files.select(F.explode(S.ancestors(F.col("path"))).alias("dir"), "line_count")
    level = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    t = up.groupBy("dir").agg(F.count("*").alias("files"), F.sum("line_count").alias("loc")).withColumn("depth", level)
    return t if depth is None else t.filter(F.col("depth") <= depth)


def entrypoints(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files with an entry name, and sources that nothing imports but that import something."""
    named = files.filter(F.lower(S.basename(F.col("path"))).isin(*ENTRY_NAMES)).select("path")
    roots = graph.without_dependents(files.filter("kind = 'source'"), edges).join(graph.with_outgoing(files, edges), "path", "left_semi")
    return named.unionByName(roots).distinct()


def key_files(files: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """The most imported files, sorted by path, with rounded counts."""
    c = graph.centrality(edges.join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi"), top)
    return c.orderBy("path").select("path", S.quantize(F.col("n")).alias("n"))
