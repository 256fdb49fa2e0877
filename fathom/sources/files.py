"""Reading a directory of source files: walk, admission, decoding and hashing, as one distributed scan.

Order of the admission tests: sensitive, ignored, too large, binary ending, NUL in the first 8000 bytes,
then kind. A sensitive file leaves no trace, not even its path; an ignored directory hides what it holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


# The defaults of an index's settings.
@dataclass
class Config:
    """Settings of an index with their defaults."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: ["node_modules", "dist", "bin", "obj", ".next", ".git"])
    sensitive: list[str] = field(default_factory=lambda: [".env*", "*.secret.*", "appsettings.Production.json"])
    max_file_kb: int = 512
    include_tests: bool = True
    include_docs: bool = True
    weights: dict[str, float] = field(default_factory=lambda: {"fts": 0.4, "symbol": 0.3, "graph": 0.2, "path": 0.1})
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    token_factor: float = 1.0
    price_rate: float = 5.0
    currency: str = "USD"


def decode_text(content: Column) -> Column:
    """Text of UTF-8 bytes without a byte-order mark; invalid bytes become U+FFFD."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^﻿", "")


def looks_binary(content: Column) -> Column:
    return F.instr(F.decode(F.substring(content, 1, 8000), "ISO-8859-1"), "\x00") > 0


def admit(raw: DataFrame, cfg: Config, ignore_lines: list[str] = ()) -> DataFrame:
    """Files of (path, content binary) that belong in an index, with kind and language."""
    p = F.col("path")
    hidden = S.is_ignored(p, S.ignore_rules(cfg.sensitive))
    ignored = S.is_ignored(p, S.ignore_rules([*cfg.exclude, *ignore_lines])) | p.rlike(r"(^|/)\.git(/|$)")
    df = raw.filter(~hidden & ~ignored & (F.octet_length("content") <= cfg.max_file_kb * 1024) & ~S.is_binary_ending(p))
    df = df.filter(~looks_binary(F.col("content"))).withColumns({"kind": S.classify_kind(p), "language": S.detect_language(p)})
    if cfg.include:
        under = F.lit(False)
        for root in cfg.include:
            root = root.strip("./").rstrip("/")
            under = under | F.lit(root == "") | (p == root) | p.startswith(f"{root}/")
        df = df.filter(under)
    if not cfg.include_tests:
        df = df.filter("kind <> 'test'")
    if not cfg.include_docs:
        df = df.filter("kind <> 'doc'")
    return df


def scan(spark: SparkSession, root: str, cfg: Config | None = None, repo: str = "") -> DataFrame:
    """(repo, path, kind, language, size_bytes, line_count, content_hash, text) of a directory tree.

    ``root`` is a path that Spark can list. The hash is that of the raw bytes; the text is decoded.
    Rules of a .gitignore at the root are kept.
    """
    cfg = cfg or Config()
    base = root.rstrip("/")
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    relative = F.regexp_replace(F.substring_index("path", base + "/", -1), "^/", "").alias("path")
    rules = binary.option("pathGlobFilter", ".gitignore").load(base).select(relative, "content").filter("path = '.gitignore'").select(F.col("content").cast("string").alias("t")).head(1)
    # the length is tested before a file is read: content that is too large is never loaded
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).filter(F.col("length") <= cfg.max_file_kb * 1024)
    raw = found.select(relative, "content")
    text = decode_text(F.col("content"))
    return admit(raw, cfg, rules[0]["t"].splitlines() if rules else []).select(
        F.lit(repo).alias("repo"), "path", "kind", "language", F.octet_length("content").cast("long").alias("size_bytes"), S.count_lines(text).alias("line_count"), F.sha2("content", 256).alias("content_hash"), text.alias("text")
    )
