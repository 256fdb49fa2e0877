"""How distinctive a term is for its record (problem 2).

A record is a graph of words: its terms in order, an edge between any two at most ``WINDOW`` places
apart. A term's weight is its number of distinct neighbours, damped by the record's length, times the
rarity of the term in the collection. Every record is tokenized once per pass inside an Arrow batch;
only counts and candidate pairs are shuffled.

Unusual input: repeated rows of one record id count once (of rows that differ, the one with the
greatest content, then heading); null heading and content are empty; records without terms have no
rows; null ids are one record.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread, tune

WINDOW = 4
#: Damping of the record's length.
SLOPE = 0.003
MIN_LETTERS = 5
_PIECE = re.compile(r"[A-Z]+[a-z]*|[a-z]+")
#: A partial vocabulary of this size is handed on, so that a task's memory stays bounded.
FLUSH = 400_000


def terms(heading: str | None, content: str | None) -> list[str]:
    """Runs of ASCII letters, split before a capital that follows a small letter, of five letters or more."""
    return [t.lower() for t in _PIECE.findall(f"{heading or ''}\n{content or ''}") if len(t) >= MIN_LETTERS]


def degree(seq: list[str], term: str) -> int:
    """Distinct other terms within WINDOW places of any occurrence of ``term``."""
    near: set[str] = set()
    at = -1
    try:
        while True:
            at = seq.index(term, at + 1)
            near.update(seq[max(0, at - WINDOW) : at + WINDOW + 1])
    except ValueError:
        near.discard(term)
        return len(near)


def degrees_of(seq: list[str]) -> dict[str, int]:
    """The degree of every term of a record, in one pass."""
    near: dict[str, set[str]] = {}
    for i, t in enumerate(seq):
        around = seq[max(0, i - WINDOW) : i + WINDOW + 1]
        if t in near:
            near[t].update(around)
        else:
            near[t] = set(around)
    return {t: len(s) - 1 for t, s in near.items()}


def _records(chunks: DataFrame) -> DataFrame:
    """Each record once, in the partition of its id."""
    tune(chunks.sparkSession)
    c = chunks.select("chunk_id", F.col("content").cast("string"), F.col("heading").cast("string"))
    return spread(c, "chunk_id").sortWithinPartitions("chunk_id", F.desc_nulls_last("content"), F.desc_nulls_last("heading"))


def _once(batches):
    """(id, terms in order) of each record; the rows come sorted by id."""
    last, first = None, True
    for b in batches:
        for key, content, heading in zip(*(c.to_pylist() for c in b.columns)):
            if first or key != last:
                first, last = False, key
                yield key, terms(heading, content)


_VOCABULARY = "term string, n bigint, found array<struct<chunk_id:bigint,tf:int,degree:int>>"
_FOUND = pa.list_(pa.struct([("chunk_id", pa.int64()), ("tf", pa.int32()), ("degree", pa.int32())]))


def _vocabulary(records: DataFrame, min_tf: int | None, max_n: int) -> DataFrame:
    """Per part of the data: a term, its number of records there and its candidate records.

    Candidates have the term ``min_tf`` times or more. A term that a single part already has in more
    than ``max_n`` records can't be rare, so its candidates are dropped at once; any other term has at
    most ``max_n`` of them in each part.
    """

    def run(batches):
        count: Counter = Counter()
        found: dict[str, list] = {}

        def out():
            names = list(count)
            hits = [found.get(t) if count[t] <= max_n else None for t in names]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([count[t] for t in names], pa.int64()), pa.array(hits, _FOUND)], names=["term", "n", "found"])

        for key, seq in _once(batches):
            if min_tf is None:
                count.update(set(seq))
            else:
                tf = Counter(seq)
                count.update(tf.keys())
                for t, n in tf.items():
                    if n >= min_tf and count[t] <= max_n:
                        found.setdefault(t, []).append({"chunk_id": key, "tf": n, "degree": degree(seq, t)})
            if len(count) > FLUSH:
                yield out()
                count.clear()
                found.clear()
        yield out()

    return records.mapInArrow(run, _VOCABULARY)


def rare_terms(chunks: DataFrame, min_tf: int, min_records: int, max_records: int) -> DataFrame:
    """(chunk_id, term, tf, degree, records) of the terms that set a record apart.

    A row is a record and a term that it has ``min_tf`` times or more and that between ``min_records``
    and ``max_records`` records of the collection have. All records count, one shuffle by term.
    """
    v = _vocabulary(_records(chunks), min_tf, max_records)
    total = v.groupBy("term").agg(F.sum("n").alias("records"), F.flatten(F.collect_list("found")).alias("found"))
    rare = total.filter(F.col("records").between(min_records, max_records))
    return rare.select("term", "records", F.explode("found").alias("f")).select("f.chunk_id", "term", "f.tf", "f.degree", "records")


def score_terms(chunks: DataFrame, top: int | None = None) -> DataFrame:
    """(chunk_id, term, tf, degree, records, score) of every record and term, or of its ``top`` ones.

    Terms in a 2000th of the records or more are joined by broadcast: as a record has a bounded number
    of terms on average, there are at most 2000 times that many of them. The others are joined by a
    shuffle, in which none of them is hot. Ties are broken by the term.
    """
    records = _records(chunks)
    df = _vocabulary(records, None, 0).groupBy("term").agg(F.sum("n").alias("records"))
    n = chunks.select("chunk_id").distinct().count()

    def run(batches):
        ids, names, counts, degrees, lengths = columns = [], [], [], [], []

        def out():
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk_id", "term", "tf", "degree", "length"])

        for key, seq in _once(batches):
            tf = Counter(seq)
            near = degrees_of(seq)
            ids += [key] * len(tf)
            names += tf
            counts += tf.values()
            degrees += [near[t] for t in tf]
            lengths += [len(seq)] * len(tf)
            if len(ids) > 50_000:
                yield out()
                for c in columns:
                    c.clear()
        yield out()

    pairs = records.mapInArrow(run, "chunk_id bigint, term string, tf int, degree int, length int")
    floor = max(2, n // 2000)
    hot = df.filter(F.col("records") >= floor)
    cold = df.filter(F.col("records") < floor)
    tagged = pairs.join(F.broadcast(hot), "term", "left")
    cols = ["chunk_id", "term", "tf", "degree", "length", "records"]
    rest = tagged.filter(F.col("records").isNull()).drop("records").join(cold, "term")
    both = tagged.filter(F.col("records").isNotNull()).select(*cols).unionByName(rest.select(*cols))
    # the average length is a constant factor of the damping; the length in terms of 100 is used instead
    damp = 1 - SLOPE + SLOPE * F.col("length") / 100
    out = both.withColumn("score", F.col("degree") / damp * F.log((F.lit(n) + 1) / F.col("records")))
    if top is not None:
        w = Window.partitionBy("chunk_id").orderBy(F.desc("score"), "term")
        out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return out.drop("length")
