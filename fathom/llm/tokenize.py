"""Encoding texts with a public byte-level BPE tokenizer.

The vocabulary is a local rank file (one base64 token and its rank per line); its folder is a
parameter and is read by each Python worker once. Results for unusual texts, the same everywhere in
this package: a null text and an empty text both have the empty list of ids and 0 tokens.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import tune, widen

#: Where vocabulary files are looked for; a path can be given to every operator instead.
FOLDER = os.environ.get("FATHOM_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters that the pre-tokenizer counts as white space.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts above this many characters are encoded in blocks.
LONG = 1 << 16
#: Runs of white space so long that the pre-tokenizer's look-ahead has no room for them.
_WIDE = re.compile(rf"[{WHITE}]{{{LONG},}}")
#: No pre-token spans a printable ASCII character followed by a blank or line feed.
SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")
#: Where one kind of ASCII character ends and another begins; none spans that either, but for contractions after an apostrophe.
_ASCII_JOINT = re.compile(r"(?<=[A-Za-z])(?=[!-@\[-`{-~\t\n\r ])|(?<=[0-9])(?=[!-/:-~\t\n\r ])|(?<=[!-&(-/:-@\[-`{-~])(?=[0-9A-Za-z\t\n\r ])")


def vocabulary(name: str = RANKS, folder: str | None = None) -> str:
    return os.path.join(folder or FOLDER, name)


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder of a rank file, built once per Python process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> np.ndarray:
    """Length in bytes of every token id."""
    enc = encoding(path)
    out = np.zeros(enc.n_vocab, dtype=np.int64)
    for tok, rank in enc._mergeable_ranks.items():
        out[rank] = len(tok)
    return out


@lru_cache(maxsize=100_000)
def _kind(c: str) -> str:
    """L, N, P or s of a character as the pre-tokenizer sees it; '' where versions of Unicode may differ on it."""
    if c in " \t\n\r":
        return "s"
    k = unicodedata.category(c)[0]
    if k in "CZ" or k != unicodedata.ucd_3_2_0.category(c)[0]:
        return ""
    return k if k in "LN" else "P"


def joints(text: str, start: int = 1, stop: int | None = None):
    """Offsets in order at which no pre-token goes on: a letter, number or sign followed by another kind.

    What is left and right of a joint is encoded the same whether the other side is there or not.
    """
    stop = len(text) if stop is None else stop
    if text.isascii():
        for m in _ASCII_JOINT.finditer(text, max(start - 1, 0), stop):
            if start <= m.start() < stop:
                yield m.start()
        return
    if start >= stop:
        return
    before, c = _kind(text[start - 1]) if start else "", text[start - 1 : start]
    for i in range(max(start, 1), stop):
        d = text[i]
        after = _kind(d)
        if after != before and after and before and before != "s" and c != "'":
            yield i
        before, c = after, d


def blocks(text: str, size: int = LONG):
    """Cut a long text into blocks at joints; encoding the blocks gives the ids of the whole.

    A run of one kind of character without any joint, such as a long word, stays one block: it is one
    pre-token, and the encoder's time for that grows little more than with its length.
    """
    at = 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size, at + 2 * size)
        cut = m.start() if m else next(joints(text, at + size), None)
        if cut is None:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _parts(text: str, enc):
    """Arrays of the ids of a long text, in order."""
    at = 0
    for m in _WIDE.finditer(text):
        # all but its last character is a pre-token of its own where something follows
        stop = m.end() - (m.end() < len(text))
        if at < m.start():
            yield from (enc.encode_to_numpy(b, disallowed_special=()) for b in blocks(text[at : m.start()]))
        yield np.array(enc._encode_single_piece(text[m.start() : stop]), np.uint32)
        at = stop
    if at < len(text):
        yield from (enc.encode_to_numpy(b, disallowed_special=()) for b in blocks(text[at:]))


def encode(text: str | None, path: str) -> np.ndarray:
    """Token ids as uint32; null and empty give an empty array."""
    if not text:
        return np.empty(0, np.uint32)
    enc = encoding(path)
    if len(text) <= LONG:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate(list(_parts(text, enc)))


def decode(ids, path: str) -> bytes:
    """The raw bytes of a list of ids (a single id need not be valid UTF-8)."""
    return encoding(path).decode_bytes(list(ids))


def encode_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row, whole texts, without special tokens and without a shuffle.

    Null and empty texts give ``[]``; rows are neither dropped nor merged, so repeated ids stay.
    """
    path = ranks or vocabulary()
    tune(df.sparkSession)

    def run(batches):
        for b in batches:
            arrays = [encode(t, path) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(arrays) + 1, np.int32)
            np.cumsum([len(a) for a in arrays], out=offsets[1:])
            flat = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return widen(df.select(id_col, F.col(text_col).cast("string"))).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """(id, raw binary): the bytes that the ids stand for; a null list gives null."""
    path = ranks or vocabulary()
    tune(df.sparkSession)

    def run(batches):
        for b in batches:
            raw = [None if x is None else decode(x, path) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=[id_col, "raw"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, raw binary")


def count_tokens(df: DataFrame, text_col: str = "text", out: str = "n_tokens", ranks: str | None = None) -> DataFrame:
    """The frame without its text and with an exact token count (0 for null and empty texts).

    An existing column of the name ``out`` is replaced.
    """
    path = ranks or vocabulary()
    tune(df.sparkSession)
    keep = [c for c in df.columns if c not in (text_col, out)]

    def run(batches):
        for b in batches:
            n = [len(encode(t, path)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*keep, out])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` bigint"])
    return widen(df.select(F.col(text_col).cast("string"), *(F.col(f"`{c}`") for c in keep))).mapInArrow(run, schema)
