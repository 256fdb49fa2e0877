"""Splitting oversized texts at natural boundaries (problem 10).

A piece's size is its number of tokens under the public tokenizer when encoded by itself. The text is
encoded once; prefix sums over its tokens and a sorted array of boundaries then give the size of any
piece by subtraction, and each cut is one binary search. Boundaries, best first: a blank line, if it
leaves the piece three quarters full; the start of a line; the end of a sentence, if it leaves the piece
half full; the blank before a word; a joint, where one kind of character ends and another begins (also
behind the punctuation of scripts without blanks). Only inside a word that is larger than a piece is the
cut made at a token, and checked by encoding the piece.

A cut inside white space changes how that white space is encoded on both sides, so every boundary
carries the size of the white space it leaves behind and takes along. Work is in proportion to the text:
a hard cut encodes a window of about one piece, never the rest of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import tune, widen
from .tokenize import WHITE, encode, joints, token_bytes, vocabulary

_RUN = re.compile(rf"(?<=[^{WHITE}])[{WHITE}]*\n[{WHITE}]*(?=[^{WHITE}])")
_WORD = re.compile(rf"(?<=[^{WHITE}]) (?=[^{WHITE}])")
_ENDED = frozenset(".!?;:")
#: Fixed value: punctuation that ends a sentence where no blank follows.
_STOPS = frozenset("\u3002\uff01\uff1f\uff1b\uff0e\uff61\u0964\u06d4")


@lru_cache(maxsize=200_000)
def _space(s: str, path: str) -> int:
    return len(encode(s, path))


@lru_cache(maxsize=100_000)
def _run(run: str, path: str) -> tuple[int, int, int, int, bool]:
    """Of a run of white space with a line break: where a line starts in it, how many characters at its end
    go with what follows, the sizes of what the cut leaves behind and takes along, and whether a line is blank."""
    k = run.rindex("\n") + 1
    blank = run.count("\n") > 1
    if k == len(run):
        return k, 0, _space(run, path), 0, blank
    # what follows keeps its last blank with the next word; any other last character stands alone
    return k, 1, _space(run[:k], path), _space(run[k:-1], path), blank


class Ruler:
    """Boundaries of one text and the sizes between them.

    A table of boundaries has the columns offset, tokens up to the cut, tokens at which what follows goes
    on, extra tokens before and extra tokens after; a boundary is a row of it.
    """

    def __init__(self, text: str, path: str):
        self.text, self.path = text, path
        ids = encode(text, path)
        self.total = len(ids)
        self.ends = np.concatenate([[0], np.cumsum(token_bytes(path)[ids])])
        self.bytes_at = None if text.isascii() else np.concatenate([np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80), [self.ends[-1]]])
        self._line_tables()
        self._words = self._sentences = self._joints = None
        self._run = 0, 0  # no joint between these offsets

    def _prefix(self, chars) -> list[int]:
        """Tokens before each character offset, which must be a pre-token boundary."""
        chars = np.asarray(chars, np.int64)
        return np.searchsorted(self.ends, chars if self.bytes_at is None else self.bytes_at[chars]).tolist()

    def _line_tables(self):
        cut, start, stop, tail, lead, strong = [], [], [], [], [], []
        for m in _RUN.finditer(self.text):
            at = m.start()
            k, back, before, after, blank = _run(m.group(), self.path)
            if blank:
                strong.append(len(cut))
            cut.append(at + k)
            start.append(at)
            stop.append(m.end() - back)
            tail.append(before)
            lead.append(after)
        # lists, as single look-ups by bisection are far quicker there than in arrays
        self.lines = cut, self._prefix(start), self._prefix(stop), tail, lead
        self.paragraphs = tuple([c[i] for i in strong] for c in self.lines)

    def _plain(self, at: list[int]):
        """The table of boundaries that change no token on either side."""
        pre, zero = self._prefix(at), [0] * len(at)
        return at, pre, pre, zero, zero

    @property
    def words(self):
        if self._words is None:
            self._words = self._plain([m.start() for m in _WORD.finditer(self.text)])
        return self._words

    @property
    def joints(self):
        if self._joints is None:
            self._joints = self._plain(list(joints(self.text)))
        return self._joints

    @property
    def sentences(self):
        if self._sentences is None:
            t = self.text
            at = [i for i in self.words[0] if t[i - 1] in _ENDED]
            if not t.isascii():
                at = sorted({*at, *(i for i in self.joints[0] if t[i - 1] in _STOPS)})
            self._sentences = self._plain(at)
        return self._sentences

    def first(self):
        return 0, 0, 0, 0, 0

    def last(self):
        return len(self.text), self.total, self.total, 0, 0

    @staticmethod
    def size(p, q) -> int:
        """Tokens of the text between two boundaries, encoded by itself."""
        return p[4] + q[1] - p[2] + q[3]

    def furthest(self, table, p, beyond: int, most: int):
        """The last boundary of ``table`` past the offset ``beyond`` with at most ``most`` tokens from p."""
        k = bisect_right(table[1], most + p[2] - p[4]) - 1
        while k >= 0 and table[0][k] > beyond:
            q = (table[0][k], table[1][k], table[2][k], table[3][k], table[4][k])
            if q[1] < p[2]:
                return None
            if self.size(p, q) <= most:
                return q
            k -= 1
        return None

    def nearest(self, table, q, after: int, most: int):
        """The first boundary past ``after`` from which at most ``most`` tokens lead to q."""
        k = bisect_left(table[2], q[1] + q[3] - most)
        while k < len(table[0]) and table[0][k] < q[0]:
            p = (table[0][k], table[1][k], table[2][k], table[3][k], table[4][k])
            if p[0] > after and p[2] <= q[1] and self.size(p, q) <= most:
                return p
            k += 1
        return None

    def best(self, p, beyond: int, most: int):
        """(kind, boundary) at which a piece from p ends best, None without a boundary in reach."""
        q = self.furthest(self.paragraphs, p, beyond, most)
        if q and 4 * self.size(p, q) >= 3 * most:
            return "paragraph", q
        q = self.furthest(self.lines, p, beyond, most)
        if q:
            return "line", q
        q = self.furthest(self.sentences, p, beyond, most)
        if q and 2 * self.size(p, q) >= most:
            return "sentence", q
        for kind in ("words", "joints"):
            q = self.furthest(getattr(self, kind), p, beyond, most)
            if q:
                return kind[:-1], q
        return None

    def _token_at(self, char: int) -> int:
        """The number of the token that a character begins or lies in."""
        at = char if self.bytes_at is None else self.bytes_at[char]
        return int(np.searchsorted(self.ends, at, side="right")) - 1

    def _char_of(self, token: int) -> int:
        """The character that a token begins or lies in."""
        at = int(self.ends[min(token, self.total)])
        return at if self.bytes_at is None else int(np.searchsorted(self.bytes_at, at, side="right")) - 1

    def hard(self, start: int, beyond: int, most: int) -> tuple[int, np.ndarray]:
        """A checked end, on a whole character, of a piece that starts at ``start``, and the piece's ids."""
        near = self._token_at(start)
        stop = max(self._char_of(near + most + most // 4 + 16), beyond + 1)
        raw = self.text[start:stop].encode()
        ends = np.cumsum(token_bytes(self.path)[encode(self.text[start:stop], self.path)])
        n = most
        while True:
            char = max(start + len(raw[: int(ends[min(n, len(ends)) - 1])].decode(errors="ignore")), beyond + 1)
            ids = encode(self.text[start:char], self.path)
            if len(ids) <= most or char == beyond + 1:
                return char, ids
            n = max(1, n - max(1, (len(ids) - most) // 2))

    def tail(self, start: int, end: int, ids: np.ndarray, most: int) -> tuple[int, int]:
        """(offset, tokens) of an end of the piece [start, end) that has at most ``most`` tokens by itself."""
        raw = self.text[start:end].encode()
        skip = int(token_bytes(self.path)[ids[: max(len(ids) - most, 0)]].sum())
        at = max(end - len(raw[skip:].decode(errors="ignore")), start + 1)
        while at < end:
            n = len(encode(self.text[at:end], self.path))
            if n <= most:
                return at, n
            at += max(1, (n - most) // 4)
        return end, 0

    def resume(self, start: int, most: int):
        """A boundary at any character: what is left of its pre-token is encoded by itself, if it is no larger than a piece or two."""
        if not self._run[0] <= start < self._run[1]:
            self._run = start, next(joints(self.text, start + 1), len(self.text))
        stop = self._run[1]
        goes_on = self._prefix([stop])[0]
        lead = goes_on - self._token_at(start)
        if lead <= 2 * most + 64:
            lead = len(encode(self.text[start:stop], self.path))
        return start, goes_on, goes_on, 0, lead


def split_text(text: str | None, max_tokens: int, overlap: int, path: str) -> list[tuple[int, int, int, int, str]]:
    """(start, end, tokens, overlap tokens, kind of cut) of the pieces of one text.

    A text within the limit, null or empty has no pieces: it is not cut. Pieces cover the text without
    a gap, none exceeds ``max_tokens`` (of 8 at least, as a single character may have several tokens), and
    neighbours share at most ``overlap`` tokens, as many as the nearest boundary allows. An overlap is below half of the limit, so every piece moves on.
    """
    if not text:
        return []
    r = Ruler(text, path)
    return [] if r.total <= max_tokens else cut(r, max_tokens, overlap)


def cut(r: Ruler, max_tokens: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    if max_tokens < 8 or overlap < 0 or 2 * overlap > max_tokens:
        raise ValueError("max_tokens must be 8 at least and the overlap at most half of it")
    out, p, done, shared = [], r.first(), 0, 0
    rest = r.last()
    while True:
        if r.size(p, rest) <= max_tokens:
            out.append((p[0], rest[0], r.size(p, rest), shared, "end"))
            return out
        found = r.best(p, done, max_tokens)
        if found is None:
            end, ids = r.hard(p[0], done, max_tokens)
            out.append((p[0], end, len(ids), shared, "hard"))
            start, shared = r.tail(p[0], end, ids, overlap) if overlap else (end, 0)
            done, p = end, r.resume(start, max_tokens)
            continue
        kind, q = found
        out.append((p[0], q[0], r.size(p, q), shared, kind))
        done, p_next, shared = q[0], q, 0
        if overlap:
            back = r.nearest(r.lines, q, p[0], overlap)
            if back is None or 2 * r.size(back, q) < overlap:
                back = r.nearest(r.words, q, p[0], overlap) or back or r.nearest(r.joints, q, p[0], overlap)
            if back is not None:
                p_next, shared = back, r.size(back, q)
        p = p_next


def split_documents(df: DataFrame, limits: list[tuple[str, int, int]], id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """One row per piece and profile of every text that is larger than the profile's limit.

    ``limits`` is a short parameter list of (profile, max_tokens, overlap_tokens). Columns: the id,
    profile, piece, start, end (code points, end excluded), n_tokens, overlap_tokens, cut, text.
    Texts within a limit, null and empty ones have no rows for it; repeated ids are cut each by itself.
    The pieces of a text in order, each without what it shares with the one before, are the text.
    """
    path = ranks or vocabulary()
    tune(df.sparkSession)
    names = [id_col, "profile", "piece", "start", "end", "n_tokens", "overlap_tokens", "cut", "text"]
    least = min((m for _, m, _ in limits), default=0)

    def run(batches):
        for b in batches:
            rows, kept = [[] for _ in names], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text or len(text.encode()) <= least:  # a token has a byte at least
                    continue
                r = Ruler(text, path)
                for profile, most, overlap in limits:
                    if r.total > most:
                        for n, (s, e, size, shared, kind) in enumerate(cut(r, most, overlap)):
                            for col, v in zip(rows, (key, profile, n, s, e, size, shared, kind, text[s:e])):
                                col.append(v)
                            kept += e - s
                if kept > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)
                    rows, kept = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    kind = df.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    schema = f"`{id_col}` {kind.simpleString()}, profile string, piece int, start int, `end` int, n_tokens int, overlap_tokens int, cut string, text string"
    return widen(df.select(id_col, F.col(text_col).cast("string"))).mapInArrow(run, schema)
