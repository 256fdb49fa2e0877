"""Differences between successive full deliveries of a table (problem 4).

Rows are spread over hash buckets by the record's key, as compact arrays only: a 128-bit key hash, an
ordinal of the delivery, the time of indexing and a 64-bit hash of the value. In a bucket these arrays are
sorted in numpy, and binary searches (searchsorted) for (key, delivery - 1) and (key, delivery + 1) give the
set differences. Full values are read in a second scan, for differing keys only: a Bloom filter of those,
of a fixed size, lets the scan drop nearly all other rows before they are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import norm_hash, norm_path
from ..session import cut_lineage, tune

#: Rows that a bucket should hold at most; the number of buckets follows the table.
BUCKET_ROWS = 500_000
#: Bits of the filter of differing keys: 2 MB, whatever the table; beyond some millions of keys it lets more rows through.
FILTER_BITS = 1 << 24
_OUT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ord", pa.int64()), ("change_kind", pa.string())])


def _deliveries(snapshots: DataFrame) -> DataFrame:
    """Listed deliveries with their place in the repository's order and the delivery that follows."""
    w = Window.partitionBy("repo").orderBy("snapshot_id")
    one = snapshots.select("repo", "snapshot_id").dropna().distinct()
    return one.select("repo", "snapshot_id", F.row_number().over(w).alias("ord"), F.lead("snapshot_id").over(w).alias("next_id"))


def _find(k1, k2, t, want: int):
    """For arrays sorted by (k1, k2, t), without repetition: the index of (k1, k2, t + want) for each row, or -1."""
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    # a number for each key in their order, joined with the delivery into one sorted array
    new = np.ones(n, bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    span = int(t.max()) + 3
    flat = (np.cumsum(new) - 1) * span + t
    at = np.searchsorted(flat, flat + want)
    at = np.where(at < n, at, 0)
    return np.where(flat[at] == flat + want, at, -1)


def compare(rows: pa.Table) -> pa.RecordBatch:
    """Differences within one bucket of (k1, k2, ord, last, stamp, value); ``ord`` is that of the reporting delivery."""
    k1, k2, t, stamp, last = (rows[c].to_numpy(zero_copy_only=False) for c in ("k1", "k2", "ord", "stamp", "last"))
    known = pc.is_valid(rows["value"]).to_numpy(zero_copy_only=False)
    value = pc.fill_null(rows["value"], 0).to_numpy(zero_copy_only=False)
    order = np.lexsort((value, known, stamp, t, k2, k1))
    k1, k2, t, value, known, last = (a[order] for a in (k1, k2, t, value, known, last))
    # of several rows for a key and delivery the one indexed last counts
    keep = np.ones(len(t), bool)
    keep[:-1] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (t[1:] != t[:-1])
    k1, k2, t, value, known, last = (a[keep] for a in (k1, k2, t, value, known, last))
    prev, nxt = _find(k1, k2, t, -1), _find(k1, k2, t, 1)
    added = np.flatnonzero((prev < 0) & (t > 1))
    changed = np.flatnonzero((prev >= 0) & (value != value[prev]) & known & known[prev])
    removed = np.flatnonzero((nxt < 0) & ~last)
    at = np.concatenate([added, changed, removed])
    when = np.concatenate([t[added], t[changed], t[removed] + 1])
    kind = ["added"] * len(added) + ["changed"] * len(changed) + ["removed"] * len(removed)
    return pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(when, pa.int64()), pa.array(kind, pa.string())], schema=_OUT)


def _bits(k1, k2):
    """Three places of a key in the filter."""
    a, b = k1.view(np.uint64), k2.view(np.uint64) | np.uint64(1)
    return [((a + np.uint64(i) * b) >> np.uint64(40)).astype(np.int64) % FILTER_BITS for i in range(3)]


def _filter_of(keys: DataFrame) -> np.ndarray | None:
    """A Bloom filter of (k1, k2), None where so many differ that it would let everything through."""
    if keys.count() > FILTER_BITS // 4:
        return None

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            for at in _bits(b.column(0).to_numpy(), b.column(1).to_numpy()):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["f"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in keys.select("k1", "k2").coalesce(4).mapInArrow(run, "f binary").collect():  # four rows at most
        out |= np.frombuffer(r["f"], np.uint8)
    return out


def snapshot_changes(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, repo, path, change_kind) between consecutive listed deliveries of a repository.

    A path is added, removed (reported with the delivery that lacks it) or changed (another
    content_hash). Of several rows for a path and delivery the one with the latest indexed_at counts,
    of equally late ones the greatest hash. Paths and hashes are compared in normal form; a hash that
    is null or unreadable on either side is no evidence of a change. Rows of deliveries that are not
    listed, and rows with a null repo, snapshot or path, are left out. The first delivery has no rows.
    """
    spark = tune(files.sparkSession)
    d = _deliveries(snapshots)
    f = files.select("repo", norm_path(F.col("path")).alias("path"), F.col("snapshot_id").cast("int").alias("snapshot_id"), F.col("indexed_at").cast("timestamp_ntz").cast("string").alias("at"), norm_hash(F.col("content_hash")).alias("hash")).filter("path <> ''")
    k1, k2 = F.xxhash64("repo", "path").alias("k1"), F.xxhash64(F.lit(7), "path", "repo").alias("k2")
    stamp = F.coalesce(F.unix_micros(F.to_timestamp("at")), F.lit(-(1 << 62))).alias("stamp")
    # a repository has few deliveries and there are few repositories; the optimizer sends them to all
    rows = f.join(d, ["repo", "snapshot_id"]).select(k1, k2, F.col("ord").cast("long").alias("ord"), F.col("next_id").isNull().alias("last"), stamp, F.when(F.col("hash").isNotNull(), F.xxhash64("hash")).alias("value"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count() // BUCKET_ROWS + 1)

    def run(batches):
        own = list(batches)
        if own:
            yield compare(pa.Table.from_batches(own))

    found = cut_lineage(rows.repartition(n, "k1").mapInArrow(run, "k1 bigint, k2 bigint, ord bigint, change_kind string"))
    # the whole rows of the repositories that have a listed delivery
    names = f.join(d.select("repo").distinct(), "repo", "left_semi").select(k1, k2, "repo", "path")
    bits = _filter_of(found)
    if bits is not None:
        wanted = spark.sparkContext.broadcast(bits)

        def differing(batches):
            bits = np.unpackbits(wanted.value)
            for b in batches:
                a, c = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                yield b.filter(pa.array(np.logical_and.reduce([bits[at] == 1 for at in _bits(a, c)])))

        names = names.mapInArrow(differing, "k1 bigint, k2 bigint, repo string, path string")
    names = names.dropDuplicates(["k1", "k2"])
    return found.join(names, ["k1", "k2"]).join(d.select("repo", F.col("ord").cast("long").alias("ord"), "snapshot_id"), ["repo", "ord"]).select("snapshot_id", "repo", "path", "change_kind")
