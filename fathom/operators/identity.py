"""Fingerprints: values that stand for a state of content, and receipts of delivered units."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def canonical(*fields: str) -> str:
    """SHA-256 over the fields, each led by its UTF-8 length and a colon; the same as the column form."""
    h = hashlib.sha256()
    for f in fields:
        b = f.encode()
        h.update(f"{len(b)}:".encode() + b)
    return h.hexdigest()


def join_records(records: Iterable[str]) -> str:
    return "".join(f"{len(r.encode())}:{r}" for r in records)


def _record() -> Column:
    rec = F.concat(F.octet_length("path").cast("string"), F.lit(":"), F.col("path"), F.octet_length("content_hash").cast("string"), F.lit(":"), F.col("content_hash"))
    return F.concat(F.octet_length(rec).cast("string"), F.lit(":"), rec)


def _ordered(key: str, value: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), "")


def content_state(files: DataFrame) -> DataFrame:
    """(repo, state): a fingerprint over all (path, content_hash) of a repository, as a tree of hashes.

    Files fall into 4096 buckets by the hash of their path; a bucket's records are hashed in path order and
    the buckets' hashes in theirs, so no row ever holds all records of a large repository.
    """
    one = files.select("repo", "path", F.substring(F.sha2("path", 256), 1, 3).alias("bucket"), _record().alias("rec"))
    leaves = one.groupBy("repo", "bucket").agg(F.sha2(_ordered("path", "rec"), 256).alias("h")).select("repo", "bucket", F.concat("bucket", "h").alias("leaf"))
    return leaves.groupBy("repo").agg(_ordered("bucket", "leaf").alias("all")).select("repo", S.canonical_hash(F.lit("content_state.tree"), F.col("all")).alias("state"))


def flat_content_state(files: list[tuple[str, str]]) -> str:
    """The same over one list of (path, content_hash) as a single sequence, for a tree small enough for the driver."""
    return canonical("content_state.v3", "".join(f"{len(r.encode())}:{r}" for r in (join_records(f) for f in sorted(files))))


# The producers that a unit's receipt depends on; another one would make old receipts worthless.
PRODUCERS = {"pointer": "pointer.v1", "span": "dec1.ev1", "symbol": "dec1.par1.ev1"}


def unit_receipt(path: str, file_hash: str, detail: str, kind: str, start: int = 0, end: int = 0, symbol: str = "", evidence: str = "") -> str:
    """The receipt of a delivered unit, 43 characters that are safe in addresses.

    ``kind`` is pointer, span or symbol; ``evidence`` is the text as delivered, for a symbol its signature and
    doc as joined records. Lines are 0 for a pointer.
    """
    digest = canonical("r1", path.replace("\\", "/"), file_hash, detail, kind, str(start), str(end), symbol, hashlib.sha256(evidence.encode()).hexdigest(), PRODUCERS[kind])
    return base64.urlsafe_b64encode(bytes.fromhex(digest)).decode().rstrip("=")


def analysis_state(state: str, producer: str, schema: int, config_hash: str) -> str:
    return canonical("analysis_state.v1", state, producer, str(schema), "rank1", "ev1", config_hash)


def worktree_state(state: str, changes: Iterable[tuple[str, str, str | None]]) -> str:
    """Over (status, path, hash) of the local changes in path order; a deleted file has '-' for its hash."""
    ordered = sorted(changes, key=lambda c: (c[1], c[0]))
    return canonical("worktree_state.v1", state, join_records(join_records([s, p, h or "-"]) for s, p, h in ordered))


def evidence_id(analysis: str, query: str, options: str, records: Iterable[str]) -> str:
    return canonical("evidence_id.v1", analysis, query, options, join_records(records))


def representation_id(evidence: str, fmt: str, profile: str, encoding: str, surface: str, body: str) -> str:
    """``body`` is the rendered response without its own id."""
    return canonical("representation_id.v1", evidence, "3", "rep1", fmt, profile, encoding, surface, hashlib.sha256(body.encode()).hexdigest())
