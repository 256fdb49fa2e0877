"""Functions of whole texts that SQL cannot express, run in Arrow batches: symbols, comments, diffs, tokens."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune, widen
from .lexing import clean_doc, extract_functions, mask


class TokenCounter(Protocol):
    def count(self, text: str) -> int: ...


class PatternTokens:
    """Tokens of a text by a fixed pattern: for when no vocabulary is at hand. '' has 0."""

    profile = "pattern"
    _pattern = re.compile(r"'(?:s|t|re|ve|m|ll|d)\b| ?[^\W\d_]+| ?\d{1,3}| ?[^\s\w]+|_+|\s+(?!\S)|\s+")

    def count(self, text: str) -> int:
        return len(self._pattern.findall(text))


class RankTokens:
    """Tokens under a byte-pair vocabulary file of (base64 token, rank) lines."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self.profile, self._enc = path, pattern, path.rsplit("/", 1)[-1], None

    def count(self, text: str) -> int:
        if self._enc is None:
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._enc = tiktoken.Encoding("local", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return len(self._enc.encode_ordinary(text))


def token_count(c: Column, counter: TokenCounter | None = None) -> Column:
    """Tokens of a text; null gives 0."""
    _ready()
    own = counter or PatternTokens()

    @F.pandas_udf("bigint")
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda t: own.count(t) if t else 0)

    return count(c)


def json_escaped(text: str) -> str:
    """A text as it stands in a JSON body of the default encoder, which also escapes quotes, + and angle brackets."""
    body = json.dumps(text, ensure_ascii=True)[1:-1].replace('\\"', "\\u0022")
    return re.sub("[<>&+'`]", lambda m: f"\\u{ord(m.group()):04X}", body)


# -- symbols

_TYPE_SCRIPT = re.compile(r"(?m)^[ \t]*(?:(?:export|default|declare|abstract|const)\s+)*(class|interface|enum|type)\s+([A-Za-z_$][\w$]*)")
_TYPE_CS = re.compile(r"(?m)^[ \t]*(?:\[[^\]\n]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref|file)\s+)*(class|interface|struct|record|enum)\s+(?:struct\s+|class\s+)?([A-Za-z_]\w*)")
_PROPERTY_CS = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|required|new)\s+)+([\w.<>\[\],? ]+?)\s+([A-Za-z_]\w*)\s*(?=\{\s*(?:(?:private|protected|internal)\s+)?(?:get|set|init)\b|=>)")
_BLANK = re.compile(r"\s*")
_CONTROLLER = re.compile(r"\[\s*ApiController\b")
_ROUTE_VERBS = frozenset("GET POST PUT PATCH DELETE HEAD OPTIONS".split())


def _end(code: str, at: int) -> int:
    """Where the braces that open after an offset close; the end of the line where none open first."""
    brace, semi = code.find("{", at), code.find(";", at)
    if brace < 0 or 0 <= semi < brace:
        end = semi if semi >= 0 else code.find("\n", at)
        return end if end >= 0 else len(code)
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, brace):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return len(code)


def _doc_before(text: str, code: str, comments: list[tuple[int, int]], ends: list[int], start: int) -> str | None:
    k = last = bisect_right(ends, start) - 1
    blank = _BLANK.fullmatch  # stops at the first code
    if k < 0 or not blank(code, ends[k], start):
        return None
    while k > 0 and text.startswith("//", comments[k][0]) and text.startswith("//", comments[k - 1][0]) and blank(code, ends[k - 1], comments[k][0]):
        k -= 1
    return clean_doc(text[comments[k][0] : ends[last]]) or None


def extract_symbols(path: str, text: str | None) -> list[tuple]:
    """(name, kind, start_line, end_line, signature, doc) of the declarations in a TypeScript, JavaScript or C# text.

    Kinds: class, interface, struct, record, enum, typealias, property, function, method and route. A
    function is a method inside a type; it is a route if it is a verb of a route file, or a method of a
    controller. Texts of other languages, null and empty ones have none.
    """
    ext = path.rsplit(".", 1)[-1].lower()
    csharp = ext == "cs"
    if not text or ext not in ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "cs"):
        return []
    text = text.replace("\r\n", "\n")
    code, comments = mask(text, csharp)
    breaks = [m.start() for m in re.finditer("\n", text)]
    ends = [e for _, e in comments]
    stops = [m.end() for m in re.finditer("[;{}]", code)] if csharp else []
    out, types = [], []
    for m in (_TYPE_CS if csharp else _TYPE_SCRIPT).finditer(code):
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        end = _end(code, m.end())
        kind = "typealias" if m.group(1) == "type" else m.group(1)
        k = bisect_right(stops, start)  # attributes stand between the declaration before and the name
        controller = csharp and (m.group(2).endswith("Controller") or bool(_CONTROLLER.search(code, stops[k - 1] if k else 0, m.end())))
        types.append((start, end, controller, kind))
        out.append((m.group(2), kind, start, end, _doc_before(text, code, comments, ends, start)))
    if csharp:
        for m in _PROPERTY_CS.finditer(code):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            out.append((m.group(2), "property", start, _end(code, m.end()), _doc_before(text, code, comments, ends, start)))
    route_file = bool(re.search(r"(?:^|/)app/(?:.*/)?route\.(?:ts|tsx|js)$", path))
    holders = [t for t in types if t[3] in ("class", "struct", "record", "interface")]
    inside: list[tuple] = []  # the types around a place, the innermost last
    seen = 0
    for f in extract_functions(text, csharp):
        while seen < len(holders) and holders[seen][0] < f["start"]:
            inside.append(holders[seen])
            seen += 1
            while len(inside) > 1 and inside[-2][1] <= inside[-1][0]:
                del inside[-2]
        while inside and inside[-1][1] <= f["start"]:
            inside.pop()
        kind = "method" if inside else "function"
        if inside and inside[-1][2] or route_file and not inside and f["name"] in _ROUTE_VERBS:
            kind = "route"
        out.append((f["name"], kind, f["start"], f["end"] - 1, f["doc"] or None))
    rows = []
    for name, kind, start, end, doc in sorted(out, key=lambda r: (r[2], r[0])):
        k = bisect_left(breaks, start)
        line_end = breaks[k] if k < len(breaks) else len(text)
        brace = text.find("{", start, line_end)
        first = text[start : brace if brace >= 0 else line_end]
        rows.append((name, kind, bisect_left(breaks, start) + 1, bisect_left(breaks, min(end, len(text))) + 1, re.sub(r"\s+", " ", first).strip(), doc))
    return rows


def symbols(texts: DataFrame) -> DataFrame:
    """(path, name, kind, start_line, end_line, signature, doc) of every declaration of (path, text)."""
    tune(texts.sparkSession)
    schema = "path string, name string, kind string, start_line int, end_line int, signature string, doc string"

    def run(frames):
        for df in frames:
            rows = [(p, *s) for p, t in zip(df["path"], df["text"]) for s in extract_symbols(p, t)]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "start_line", "end_line", "signature", "doc"])

    return widen(texts.select("path", F.col("text").cast("string"))).mapInPandas(run, schema)


# -- comments and differences


def strip_comment_lines(text: str) -> tuple[str, bool]:
    """(text, changed) without lines that are comments only; blank runs become one, blank edges go.

    A comment behind code stays.
    """
    out, inside, dropped = [], False, False
    for line in text.split("\n"):
        s = line.strip()
        if inside:
            dropped = True
            if "*/" in s:
                inside, rest = False, s.split("*/", 1)[1].strip()
                if rest:
                    out.append(rest)
            continue
        if s.startswith("//"):
            dropped = True
            continue
        if s.startswith("/*"):
            if "*/" not in s:
                inside = dropped = True
                continue
            if not s.split("*/", 1)[1].strip():
                dropped = True
                continue
        out.append(line)
    if not dropped:
        return text, False
    kept: list[str] = []
    for line in out:
        if line.strip() or (kept and kept[-1].strip()):
            kept.append(line)
    while kept and not kept[-1].strip():
        kept.pop()
    return "\n".join(kept), True


def shortest_edits(x: list, y: list, most: int) -> list[tuple[int, int, int, int]] | None:
    """(i1, i2, j1, j2) of the parts x[i1:i2] and y[j1:j2] that differ, with as few lines taken out and put in as possible.

    None where more than ``most`` are needed. For each number of edits the furthest place on each diagonal
    is kept; the path is read back from there, so time and room grow with the edits, not with the square of the lines.
    """
    n, m = len(x), len(y)
    far = {1: 0}
    history: list[dict[int, int]] = []
    found = None
    for d in range(min(most, n + m) + 1):
        now: dict[int, int] = {}
        for k in range(-d, d + 1, 2):
            if k < -m or k > n:
                continue
            down = far.get(k + 1, -1)
            right = far.get(k - 1, -2) + 1
            i = max(down, right)
            j = i - k
            if i < 0 or j < 0 or i > n or j > m:
                continue
            while i < n and j < m and x[i] == y[j]:
                i, j = i + 1, j + 1
            now[k] = i
            if i == n and j == m:
                found = d
                break
        history.append(now)
        if found is not None:
            break
        far = now
    if found is None:
        return None
    steps, i, j = [], n, m
    for d in range(found, 0, -1):
        before, k = history[d - 1], i - j
        down, right = before.get(k + 1, -1), before.get(k - 1, -2) + 1
        if down >= right:
            i, j = down, down - k - 1  # then a line of y was put in
            steps.append((i, i, j, j + 1))
        else:
            i, j = right - 1, right - 1 - (k - 1)
            steps.append((i, i + 1, j, j))
    out: list[tuple[int, int, int, int]] = []
    for i1, i2, j1, j2 in reversed(steps):
        if out and out[-1][1] == i1 and out[-1][3] == j1:
            out[-1] = (out[-1][0], i2, out[-1][2], j2)
        else:
            out.append((i1, i2, j1, j2))
    return out


def line_hunks(old: str, new: str, context: int = 2, max_edits: int = 2000, max_lines: int = 20_000) -> list[tuple[int, int, int, int, str]]:
    """(old start, old lines, new start, new lines, text) of the differing parts, with lines of context; the edits are the fewest.

    Line ends don't matter. Common edges are trimmed first; where more than ``max_edits`` lines differ, or
    more than ``max_lines`` are left, the whole rest is one hunk.
    """
    a, b = (x.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n") if x else [] for x in (old, new))
    if a == b:
        return []
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    ops = shortest_edits(x, y, max_edits) if len(x) + len(y) <= max_lines else None
    groups: list[list] = []
    for i1, i2, j1, j2 in ops if ops is not None else [(0, len(x), 0, len(y))]:
        i1, i2, j1, j2 = i1 + lo, i2 + lo, j1 + lo, j2 + lo
        if groups and i1 - groups[-1][-1][1] <= 2 * context:
            groups[-1].append((i1, i2, j1, j2))
        else:
            groups.append([(i1, i2, j1, j2)])
    out = []
    for g in groups:
        s, e = max(0, g[0][0] - context), min(len(a), g[-1][1] + context)
        t, u = max(0, g[0][2] - context), min(len(b), g[-1][3] + context)
        lines, at = [], s
        for i1, i2, j1, j2 in g:
            lines += [" " + z for z in a[at:i1]] + ["-" + z for z in a[i1:i2]] + ["+" + z for z in b[j1:j2]]
            at = i2
        lines += [" " + z for z in a[at:e]]
        out.append((s + 1, e - s, t + 1, u - t, "\n".join(lines)))
    return out


def _ready() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        tune(spark)


def _struct_udf(f: Callable, schema: str):
    _ready()

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(t) if t is not None else (None, None) for t in s], columns=["text", "changed"])

    return run


def strip_comments(c: Column) -> Column:
    """struct<text, changed> of a text; null gives nulls."""
    return _struct_udf(strip_comment_lines, "text string, changed boolean")(c)


def hunks(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """(path, old_start, old_lines, new_start, new_lines, text) of the differences of (path, old, new); a null side is empty."""
    tune(pairs.sparkSession)
    names = ["path", "old_start", "old_lines", "new_start", "new_lines", "text"]

    def run(frames):
        for df in frames:
            rows = [(p, *h) for p, a, b in zip(df["path"], df["old"], df["new"]) for h in line_hunks(a or "", b or "")]
            yield pd.DataFrame(rows, columns=names)

    return pairs.select("path", F.col(old).alias("old"), F.col(new).alias("new")).mapInPandas(run, "path string, old_start int, old_lines int, new_start int, new_lines int, text string")
