"""Building an index of a scanned repository and keeping it in versioned folders.

A version holds files, chunks, symbols, edges and postings as Parquet and meta as JSON; a pointer file names
the current one and is swapped last, so a reader never sees half an index. Files whose hash has not changed
keep their chunks and symbols: only the others reach the text functions.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textops
from ..session import cut_lineage
from ..sources.files import Config
from . import changes, chunking, graph, identity, search

SCHEMA_VERSION, PRODUCER = 4, "fathom-1"


@dataclass
class Tables:
    files: DataFrame
    chunks: DataFrame
    symbols: DataFrame
    edges: DataFrame


def parse(sources: DataFrame, counter: textops.TokenCounter | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, chunks, symbols) of scanned sources (path, kind, language, ..., text)."""
    files = sources.withColumn("token_count", textops.token_count(F.col("text"), counter).cast("int")).drop("text")
    symbols = cut_lineage(textops.symbols(sources))  # used by the tables of chunks, symbols and edges, and lexed once
    chunks = chunking.chunk(sources.select("path", "text")).unionByName(chunking.symbol_chunks(symbols))
    cid = F.xxhash64("path", "kind", "start_line", "end_line", F.coalesce("heading", F.lit("")))
    return files, chunks.withColumn("chunk_id", cid), symbols.withColumn("symbol_id", F.xxhash64("path", "start_line", "name", "kind"))


def link(sources: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """All import and test edges, made anew."""
    types = symbols.filter("kind IN ('class', 'interface', 'struct', 'record', 'enum') AND path LIKE '%.cs'").select("path", "name")
    imports = graph.script_edges(sources, files).unionByName(graph.csharp_edges(sources, types))
    return imports.unionByName(graph.test_edges(files, imports))


def build(sources: DataFrame, old: Tables | None = None, counter: textops.TokenCounter | None = None) -> tuple[Tables, DataFrame]:
    """(tables, changes) of an index over scanned sources; unchanged files are taken from ``old``."""
    if old is None:
        files, chunks, symbols = parse(sources, counter)
        delta = sources.select("path", F.lit("added").alias("status"))
    else:
        delta = changes.diff(old.files, sources)
        fresh = delta.filter("status IN ('added', 'modified')").select("path")
        same = delta.filter("status = 'unchanged'").select("path")
        files, chunks, symbols = parse(sources.join(fresh, "path", "left_semi"), counter)
        keep = lambda o, n: n.unionByName(o.join(same, "path", "left_semi").select(*n.columns))
        files, chunks, symbols = keep(old.files, files), keep(old.chunks, chunks), keep(old.symbols, symbols)
    return Tables(files, chunks, symbols, link(sources, files, symbols)), delta


def config_hash(cfg: Config) -> str:
    return identity.canonical("index_config.v1", json.dumps([cfg.include, cfg.exclude, cfg.sensitive, cfg.max_file_kb, cfg.include_tests, cfg.include_docs]))


def current(folder: str) -> int | None:
    try:
        with open(os.path.join(folder, "CURRENT")) as f:
            return int(f.read())
    except (OSError, ValueError):
        return None


def write(tables: Tables, folder: str, cfg: Config) -> int:
    """Write the next version of an index in a folder shared by all executors, then point to it."""
    v = (current(folder) or 0) + 1
    base = os.path.join(folder, f"v={v}")
    spark = tables.files.sparkSession
    for name in ("files", "chunks", "symbols", "edges"):
        getattr(tables, name).write.mode("overwrite").parquet(os.path.join(base, name))
    done = load(spark, folder, v)
    # sorted by term, so that row groups are skipped when a query asks for its own terms
    search.postings(done.chunks).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(os.path.join(base, "postings"))
    state = identity.content_state(done.files.withColumn("repo", F.lit(""))).first()
    meta = {"schema_version": SCHEMA_VERSION, "producer": PRODUCER, "config_hash": config_hash(cfg), "state_hash": state["state"] if state else identity.canonical("content_state.v3", "")}
    meta |= {f"{name}_count": getattr(done, name).count() for name in ("files", "chunks", "symbols", "edges")}
    with open(os.path.join(base, "meta.json"), "w") as f:
        json.dump(meta, f)
    with open(os.path.join(folder, "CURRENT.tmp"), "w") as f:
        f.write(str(v))
    os.replace(os.path.join(folder, "CURRENT.tmp"), os.path.join(folder, "CURRENT"))
    return v


def load(spark: SparkSession, folder: str, version: int | None = None) -> Tables:
    v = version if version is not None else current(folder)
    if v is None:
        raise FileNotFoundError(f"no index in {folder}")
    base = os.path.join(folder, f"v={v}")
    return Tables(*(spark.read.parquet(os.path.join(base, n)) for n in ("files", "chunks", "symbols", "edges")))


def meta(folder: str) -> dict:
    with open(os.path.join(folder, f"v={current(folder)}", "meta.json")) as f:
        return json.load(f)


def ensure_usable(folder: str, cfg: Config) -> dict:
    """The meta of the current index; raises if it was made by another schema, producer or configuration."""
    m = meta(folder)
    import re

    for key, want in (("schema_version", SCHEMA_VERSION), ("producer", PRODUCER), ("config_hash", config_hash(cfg))):
        if m.get(key) != want:
            raise ValueError(f"the index is out of date: {key}")
    if not re.fullmatch(r"[0-9a-f]{64}", m.get("state_hash") or ""):
        raise ValueError("the index is out of date: state_hash")
    return m
