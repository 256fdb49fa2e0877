"""Functions paired with their documentation (problem 3).

A source file is run through a state machine that knows strings, templates, regular expressions and
comments. What is left is code with unchanged offsets, in which braces are matched to delimit functions;
the comment that ends directly before a function, with nothing but attributes between, is its
documentation. Symbols of an index are looked up among these pairs by path, name and line. Pairs whose
documentation says nothing that the function's name, parameters and types do not are dropped: those come
from the whole signature in the source, which may be longer than the line that an index keeps.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import extract_functions
from ..session import tune, widen

FUNCTION_KINDS = ("function", "method", "route")

# Words that add nothing to a name, and words that only stand in for a description.
_FILLERS = frozenset("""
a an the this that these those it its is are was be been being will would can does do did done of to for from in on at by with and or as into via
function functions func fn method methods procedure routine helper route handler endpoint operation implementation implements
show shows showing display displays render renders
given passed supplied specified provided certain some which our your their current corresponding respective simply just
""".split())  # fmt: skip
_STAND_INS = frozenset("""
todo fixme tbd tba xxx hack wip na none nil null empty blank noop nop stub placeholder undocumented
description descriptions describe documentation doc docs document documented comment comments comes come goes go here there later add write fill missing text
auto autogenerated generated no not yet available see above below same ditto self explanatory obvious summary remarks inheritdoc inheritdocs
beschreibung beschreibungen keine kein fehlt folgt noch nicht vorhanden siehe oben unten dokumentation
sans aucune description documentation voir sin descripción descripcion pendiente documentar ninguna
returns return params param region endregion helpers lorem ipsum
""".split())  # fmt: skip
_DIRECTIVE = re.compile(r"(?i)^\W*(?:eslint|istanbul|prettier|tslint|jshint|jslint|stylelint|c8|v8|biome|rome|webpack\w*|ts-(?:ignore|nocheck|expect-error|check)|@ts-\w+|#?pragma|#?(?:end)?region|noinspection|nolint|noqa|resharper|sonar\w*|codecov|coverage|cspell|spell-?checker|dprint|flow)\b[\s:-]")
_TODO = re.compile(r"(?i)\b(?:todo|fixme|xxx|hack)\b\s*(?:\([^)]*\))?\s*:?.*?(?:\.(?=\s|$)|$)", re.S)
_WORD = re.compile(r"[^\W\d_]+|\d+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])|[_\W]+")


def _stem(w: str) -> str:
    w = w.lower()
    for end, rest in (("ies", "y"), ("ied", "y"), ("ying", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""), ("e", "")):
        if w.endswith(end) and len(w) - len(end) >= 2 and not (end == "s" and w.endswith("ss")):
            w = w[: len(w) - len(end)] + rest
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "ls":
        w = w[:-1]
    return w[:-1] if w.endswith("e") and len(w) > 3 else w


def informative_words(doc: str | None, name: str | None, signature: str | None = None) -> list[str]:
    """The words of a documentation that neither the name, the parameters nor an empty phrase account for."""
    if not doc:
        return []
    text = "".join(c for c in unicodedata.normalize("NFKC", doc) if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t")
    text = re.sub(r"\{@\w+\s*([^{}]*)\}", r" \1 ", text)
    text = re.sub(r"<\|[^|<>]*\|>|</?[A-Za-z][^<>]*>|<!--|-->|&\w+;", " ", text)
    text = "\n".join("" if _DIRECTIVE.match(line + " ") else re.sub(r"^\s*@\w+", " ", line) for line in text.split("\n"))
    text = _TODO.sub(" ", text)
    own = {_stem(p) for p in _HUMP.split(name or "") if p} | {_stem(name or "")}
    own |= {_stem(p) for w in _WORD.findall((signature or "").partition("(")[2]) for p in _HUMP.split(w) if p}
    out = []
    for w in _WORD.findall(text):
        parts = [w] if w.islower() or w.isupper() else [p for p in _HUMP.split(w) if p]
        for p in parts:
            low = p.lower()
            if low not in _FILLERS and low not in _STAND_INS and _stem(p) not in own:
                out.append(low)
    return out


def says_something(doc: str | None, name: str | None, signature: str | None = None) -> bool:
    """Whether a documentation tells something that the name does not.

    Null and blank docs, separators, markup, tags, tool directives, stand-ins, notes of work to do and
    restatements of the name tell nothing. Single letters and bare numbers don't count as words.
    """
    words = informative_words(doc, name, signature)
    return any(len(w) > 1 and not w.isdigit() or ord(w[0]) > 0x2E7F for w in words)


def _lexed(docs: DataFrame) -> DataFrame:
    """(path, name, line, signature, doc, start, end) of every function in TypeScript, JavaScript and C# files."""
    tune(docs.sparkSession)
    src = docs.select("path", F.col("text").cast("string")).filter(F.col("path").rlike(r"\.(?:tsx?|js|cs)\s*$") & F.col("text").isNotNull())
    names = ["path", "name", "line", "signature", "doc", "start", "end"]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, line = 0, 1
                for f in sorted(extract_functions(text, path.rstrip().endswith(".cs")), key=lambda f: f["start"]):
                    line += text.count("\n", at, f["start"])
                    at = f["start"]
                    for col, v in zip(rows, (path, f["name"], line, f["signature"], f["doc"], f["start"], f["end"])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    return widen(src).mapInArrow(run, "path string, name string, line int, signature string, doc string, start int, `end` int")


def _telling(rows: DataFrame, doc: str, name: str, signature: str) -> DataFrame:
    """The rows whose documentation tells something."""
    cols = rows.columns
    at = [cols.index(c) for c in (doc, name, signature)]

    def run(batches):
        for b in batches:
            keep = [i for i, (d, n, s) in enumerate(zip(*(b.column(k).to_pylist() for k in at))) if says_something(d, n, s)]
            yield b.take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def _symbols(symbols: DataFrame) -> DataFrame:
    """Functions among the symbols, each symbol_id once: of rows that differ, the one with the greatest doc, then signature."""
    s = symbols.select("symbol_id", "repo", "path", "kind", "name", "start_line", "signature", "doc").filter(F.lower(F.trim("kind")).isin(*FUNCTION_KINDS))
    best = F.max(F.struct("doc", "signature", "name", "path", "start_line", "repo", "kind")).alias("s")
    return s.groupBy("symbol_id").agg(best).select("symbol_id", "s.repo", "s.path", "s.kind", "s.name", "s.start_line", "s.signature", "s.doc")


def symbol_pairs(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """(symbol_id, repo, path, kind, name, signature, doc) of functions with a telling documentation.

    ``symbols`` is an index's list of declarations, ``docs`` (path, text) the files; a symbol is paired with
    the function of its name that begins at its line. The signature is the one in the source. The doc is
    the symbol's own, as the index has cleaned it; a symbol without one has no pair, whatever the file says
    now. Where the files don't have the function (a path that is gone, another version, a null name or
    line), the symbol's own row is the pair. Kinds are compared without case and blanks; rows with a null
    id are one symbol. Two functions of a name on one line: the first counts.
    """
    tune(symbols.sparkSession)
    s = _symbols(symbols).filter(F.length(F.trim("doc")) > 0)
    found = _lexed(docs).filter("doc <> ''").groupBy(F.trim("path").alias("path"), "name", F.col("line").alias("start_line")).agg(F.min_by("signature", "start").alias("whole"))
    both = s.join(found, ["path", "name", "start_line"], "left").withColumn("signature", F.coalesce("whole", "signature"))
    return _telling(both.select("symbol_id", "repo", "path", "kind", "name", "signature", "doc"), "doc", "name", "signature")


def source_pairs(docs: DataFrame) -> DataFrame:
    """(path, name, signature, doc, start, end) of every documented function in TypeScript, JavaScript and C# files.

    start and end are code points of the function in the text. Texts that are null, empty or of another
    language have no rows. No shuffle.
    """
    return _telling(_lexed(docs).drop("line"), "doc", "name", "signature")
