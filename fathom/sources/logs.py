"""The JSON-lines logs of memory entries and calls: tolerant reads, appends and compaction.

Each file of a folder is a part of the log; an append adds a file. Line numbers order a log, so a line
carries its own: (part, position) of files named by time.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

MEMORY_SCHEMA = "id string, kind string, text string, files map<string,string>, tags array<string>, session string, created string, deleted boolean, line_no long, repo string"
USAGE_SCHEMA = "v int, ts timestamp, command string, source string, served int, replaced int, files int, unchanged int, usage_id long, repo string"
#: A log is rewritten when it has so many parts more than live entries.
SLACK = 1000


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records of a log; lines that aren't JSON of this schema are dropped."""
    df = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    return df.filter("_bad IS NULL").drop("_bad")


def append(folder: str, records: list[dict]) -> str:
    """Add records as a new part of a local or mounted log folder; returns its path."""
    os.makedirs(folder, exist_ok=True)
    name = os.path.join(folder, f"part-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json")
    with open(name + ".tmp", "w") as f:
        for r in records:
            f.write(json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False) + "\n")
    os.replace(name + ".tmp", name)
    return name


def compact(spark: SparkSession, live: DataFrame, folder: str) -> bool:
    """Rewrite a log as its live entries alone, if it has ``SLACK`` parts more than those; whether it was rewritten.

    The new log is complete before it takes the old one's place, so a reader finds one or the other.
    """
    if len(os.listdir(folder)) <= live.count() + SLACK:
        return False
    new, old = f"{folder}.new-{time.time_ns()}", f"{folder}.old-{time.time_ns()}"
    live.write.mode("errorifexists").json(new)
    os.replace(folder, old)
    os.replace(new, folder)
    shutil.rmtree(old)
    return True
