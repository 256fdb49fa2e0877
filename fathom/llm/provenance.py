"""Generated, minified, vendored and data files among source code (problem 7).

Evidence comes in three layers. Attribute files of a repository declare paths as generated or vendored;
their globs are resolved with git's precedence, directory by directory. For repositories that declare
nothing, equivalent path patterns are mined from the corpus: how often files under a pattern prove by
their content to be what the pattern says. The content itself decides: a tool's notice at the head of a
file, the shape of minified code, nothing but literals, or the word shingles of a known library. A mined
pattern only tips the balance for a file whose own content is undecided: it shows such a sign, but too
weakly to count by itself.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import mask
from ..functions.scalars import ancestors
from ..session import cut_lineage, tune, widen

CODE = r"\.(?:tsx?|js|cs)\s*$"
#: A word shingle has five words; a copy shares this part of them.
SHINGLE, SIMILAR = 5, 0.8
#: From this part on a file is undecided about being a copy.
WEAK = 0.5
#: A mined pattern counts from so many files with content evidence and this rate of it.
MINED_FILES, MINED_RATE = 20, 0.9

# Attributes and their meaning.
_ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored", "gitlab-generated": "generated"}

_NOTICE = re.compile(
    r"(?i)@generated\b|<auto-?generated\b|\b(?:auto(?:matically)?|machine)[- ]?(?:generated|written|created|produced)\b(?![- ]+(?:method|constructor|property|class|event)\s+stub)"
    r"|\b(?:code|file|source|module)\s+(?:(?:was|is|has been)\s+)?(?:auto(?:matically)?[- ])?(?:generated|produced|created|emitted|written) (?:by|from|with|using) (?:a |the |an )?(?:tool|script|compiler|generator|[\w./-]*gen\b|[\w-]*codegen)"
    r"|\bcode generated by\b|\bgenerated (?:by|from|with|using)\b.{0,80}\bdo not (?:edit|modify|change)\b"
    r"|\bdo not (?:edit|modify|change)\b.{0,40}(?:\bby hand\b|\bmanually\b|\bdirectly\b|\bthis file\b|\bgenerated\b|\boutput of\b)|\bgenerated (?:code|file|source)\b.{0,60}\bdo not\b|changes (?:to this file )?will be (?:lost|overwritten)"
    r"|\bfile was (?:produced|generated|written|emitted) by\b|\boutput of the [\w-]+ (?:compiler|generator|tool)\b|\bedit [\w./-]+ instead\b"
    r"|\b(?:maschinell|automatisch) (?:erzeugt|erstellt|generiert)\b|\bgénéré automatiquement\b|\bgenerado automáticamente\b|\bgerado automaticamente\b"
)
_HEAD = re.compile(r"﻿?\s*(?:#![^\n]*\n\s*)?((?:(?://[^\n]*(?:\n\s*|$))|/\*[\s\S]*?\*/\s*)+)")
_WORDS = re.compile(r"\w+")
_LITERAL_SCRIPT = re.compile(r"\b(?:export|default|const|let|var|module|exports|as|readonly|true|false|null|undefined|use|strict|satisfies|Object|freeze|number|string|boolean|any|unknown|Array|ReadonlyArray|Record|Uint8Array|Uint16Array|Uint32Array|Int8Array|Int16Array|Int32Array|Float32Array|Float64Array|new|enum|JSON|parse)\b")
_LITERAL_CS = re.compile(r"\b(?:using|namespace|public|internal|private|protected|static|readonly|const|sealed|partial|class|struct|enum|new|true|false|null|byte|sbyte|short|ushort|int|uint|long|ulong|float|double|decimal|string|char|bool|var|System|Collections|Generic|Dictionary|List|IReadOnlyList|IReadOnlyDictionary|ReadOnlySpan)\b")


def has_notice(text: str) -> bool:
    """Whether the comments at the head of a file say that a tool wrote it."""
    m = _HEAD.match(text)
    if not m:
        return False
    head = m.group(1)
    # a documentation comment that belongs to the first declaration isn't the file's head
    return bool(_NOTICE.search(re.sub(r"[ \t]*\n[ \t]*(?://|\*)?[ \t]*", " ", head)))


_MEMBER = re.compile(r"(?m)^[ \t]*(?:[\w<>?\[\]]+[ \t]+)*([A-Za-z_$][\w$]*?)_?(\d+)[ \t]*(?:\([^()\n]*\)|[:=])")


def is_numbered(text: str, least: int = 5) -> bool:
    """Whether most of a file is a run of ``least`` members or more that differ by a counter only."""
    runs: dict[str, set[int]] = {}
    for m in _MEMBER.finditer(text):
        runs.setdefault(m.group(1), set()).add(int(m.group(2)))
    name, numbers = max(runs.items(), key=lambda kv: len(kv[1]), default=("", set()))
    if len(numbers) < least or max(numbers) - min(numbers) > 2 * len(numbers):
        return False
    lines = [re.sub(r"\d+", "0", x.strip()) for x in text.split("\n") if x.strip()]
    return len(set(lines)) < 0.4 * len(lines)


def is_minified(text: str, part: float = 0.6, most_blanks: float = 0.12) -> bool:
    """Whether ``part`` of a file or more is code in very long lines with few blanks."""
    lines = text.split("\n")
    long = [x for x in lines if len(x) > 300]
    size = sum(map(len, long))
    if size < 300 or size < part * len(text.strip()):
        return False
    blanks = sum(x.count(" ") for x in long) / size
    breaks = sum(x.count(";") + x.count("{") + x.count("}") for x in long) / size
    return blanks < most_blanks and breaks > 0.02


def is_data(text: str, csharp: bool, least: int = 8) -> bool:
    """Whether a file declares nothing but literals, ``least`` of them or much text."""
    if text.startswith("﻿"):
        text = text[1:]
    code, comments = mask(text, csharp)
    body = code.strip()
    if not body or "=>" in body or re.search(r"\b(?:function|return|if|for|while|import|require|interface|get|set|void|async|await|this|throw|switch)\b", body):
        return False
    literal = text
    for s, e in reversed(comments):
        literal = literal[:s] + literal[e:]
    if csharp:
        body = re.sub(r"\b(?:namespace|using)\s+[\w.]+\s*[;{]", " ", body)
        body = re.sub(r"\b(?:class|struct|enum)\s+\w+|[\w\]>?]\s+\w+\s*(?==)|[{,]\s*\w+\s*(?==\s*-?\d)", " ", body)
        if "(" in re.sub(r"\bnew\b[^;{]*\(\s*\)", "", body) or "=" not in code:
            return False
        left = _LITERAL_CS.sub(" ", body)
    else:
        body = re.sub(r"\b(?:const|let|var|enum)\s+[\w$]+\s*(?::\s*[\w<>,\[\]|{}: ]+)?", " ", body)
        body = re.sub(r"[\w$]+\s*:", " ", body)
        if re.search(r"[\w$]\s*\(", re.sub(r"\bnew\s+\w+Array\s*\(|Object\.freeze\s*\(|JSON\.parse\s*\(", "", body)):
            return False
        left = _LITERAL_SCRIPT.sub(" ", body)
    left = re.sub(r"0[xX][0-9a-fA-F_]+|\d[\d_.]*(?:[eE][+-]?\d+)?[a-zA-Z]{0,2}", "", left)
    if re.search(r"[A-Za-z_]", left):
        return False
    values = len(re.findall(r"\d[\w.]*|\"[^\"\n]*\"|'[^'\n]*'", literal)) + literal.count("`") // 2
    return values >= least or len(literal.strip()) >= 300


class Libraries:
    """Shingle hashes of known library files and the lookup of a text in them."""

    def __init__(self, texts: list[str]):
        self.words: dict[str, int] = {}
        sets = [np.unique(self._hashes(t)) for t in texts]
        self.sizes = np.array([len(s) for s in sets] or [0])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) if sets else np.empty(0, int)
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner = every[order], owner[order]

    def _hashes(self, text: str) -> np.ndarray:
        import xxhash

        words = self.words
        if len(words) > 500_000:
            words.clear()
        ids = []
        for w in _WORDS.findall(text):
            h = words.get(w)
            if h is None:
                h = words[w] = xxhash.xxh64_intdigest(w)
            ids.append(h)
        if len(ids) < SHINGLE:
            return np.empty(0, np.uint64)
        a = np.array(ids, np.uint64)
        out = np.zeros(len(a) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            out = out * np.uint64(0x9E3779B97F4A7C15) + a[k : len(a) - SHINGLE + 1 + k]
        return out

    def likeness(self, text: str) -> float:
        """How much of the shingles the text shares with the nearest library: of both together, or of the smaller one if that is no snippet."""
        if not len(self.hashes):
            return 0.0
        own = np.unique(self._hashes(text))
        if len(own) < 10:
            return 0.0
        lo = np.searchsorted(self.hashes, own, "left")
        hi = np.searchsorted(self.hashes, own, "right")
        found = hi > lo
        if int(found.sum()) < WEAK * min(len(own), int(self.sizes.min())):
            return 0.0
        shared = np.zeros(len(self.sizes), int)
        for a, b in zip(lo[found], hi[found]):
            shared[self.owner[a:b]] += 1
        less = np.minimum(len(own), self.sizes)
        return float(np.maximum(shared / np.maximum(len(own) + self.sizes - shared, 1), np.where(less >= 60, shared / np.maximum(less, 1), 0)).max())


def classify(text: str, csharp: bool, libraries: Libraries) -> str | None:
    """'vendored', 'generated', 'minified', 'data', 'undecided' (a weak sign of any) or None for a hand-written text."""
    like = libraries.likeness(text)
    if like >= SIMILAR:
        return "vendored"
    if has_notice(text) or is_numbered(text):
        return "generated"
    if is_minified(text):
        return "minified"
    if is_data(text, csharp):
        return "data"
    longest = max(map(len, text.split("\n")))
    weak = like >= WEAK or longest > 1000 and longest > 0.5 * len(text) or is_numbered(text, 3) or is_minified(text, 0.4, 0.2) or is_data(text, csharp, 2)
    return "undecided" if weak else None


# -- declared and mined paths


def parse_attributes(text: str | None, macros: dict[str, list[str]] | None = None) -> list[tuple[str, str, bool]]:
    """(glob, kind, value) in the order of an attribute file; later rules win. Null and empty give none.

    ``macros`` is filled by lines that begin with [attr] and used by the others: a name for several
    attributes. Quoted patterns are unquoted; a pattern that begins with ! is not allowed and is left out.
    """
    rules, macros = [], {} if macros is None else macros
    for line in (text or "").splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = re.match(r'("(?:[^"\\]|\\.)*"|\S+)\s*(.*)', line)
        pattern, attrs = m.group(1), m.group(2).split()
        if pattern.startswith("[attr]"):
            macros[pattern[6:]] = attrs
            continue
        if pattern.startswith('"'):
            pattern = re.sub(r"\\(.)", r"\1", pattern[1:-1])
        if pattern.startswith("!"):
            continue
        for attr in attrs:
            name = attr.lstrip("-!").partition("=")[0]
            # a macro that is set sets its own attributes, before it
            for one in [*(macros.get(name, ()) if attr == name else ()), attr]:
                name, _, value = one.lstrip("-!").partition("=")
                if name in _ATTRIBUTES:
                    rules.append((pattern, _ATTRIBUTES[name], not one.startswith(("-", "!")) and value.lower() not in ("false", "0")))
    return rules


@lru_cache(maxsize=10_000)
def _glob(pattern: str) -> re.Pattern | None:
    """A pattern of an attribute file as an expression over paths below it, None if it can't match a file.

    Without a slash it is matched against the name alone; one that ends in a slash means a directory and
    no file in it. A star stays in a segment, two stars as a segment cross them; [...] is a set, [!...] its opposite.
    """
    if pattern.endswith("/"):
        return None
    anchored = "/" in pattern
    body, out, i = pattern.lstrip("/"), "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body[i:] == "**" and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            while body.startswith("*", i + 1):
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := body.find("]", i + 2 + (body[i + 1 : i + 2] in ("!", "^")))) > 0:
            inner = body[i + 1 : end]
            no = inner[:1] in ("!", "^")
            out += "(?!/)[" + ("^" if no else "") + re.sub(r"([\\\[\]^&~|])", r"\\\1", inner[1:] if no else inner) + "]"
            i = end + 1
        else:
            if c == "\\" and i + 1 < len(body):
                i += 1
            out, i = out + re.escape(body[i]), i + 1
    return re.compile(out if anchored else f"(?:.*/)?{out}")


class Attributes:
    """The attribute files of many sources: rules by source and directory, parsed when first asked for."""

    def __init__(self, rows: list[tuple[str | None, str, str | None]]):
        self._texts: dict[str, dict[str, str]] = {}
        for source, path, text in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2] or "")):
            self._texts.setdefault(source or "", {})[path.strip().rpartition("/")[0]] = text or ""
        self._rules: dict[str, dict[str, list]] = {}

    def kinds(self, source: str | None, path: str) -> set[str]:
        own = self._texts.get(source or "")
        if not own:
            return set()
        rules = self._rules.get(source or "")
        if rules is None:
            macros: dict[str, list[str]] = {}
            top = min(own, key=len)  # macros are only defined at the top
            first = parse_attributes(own[top], macros)
            rules = self._rules[source or ""] = {d: first if d == top else parse_attributes(re.sub(r"(?m)^\s*\[attr\].*$", "", t), macros) for d, t in own.items()}
        return declared(path, rules)


def declared(path: str, files: dict[str, list[tuple[str, str, bool]]]) -> set[str]:
    """The kinds that a path is declared to be by attribute files, given by their directory ('' is the root).

    Files of deeper directories win over those above, later lines over earlier ones.
    """
    state: dict[str, bool] = {}
    parts = path.split("/")[:-1]
    for depth in range(len(parts) + 1):
        folder = "/".join(parts[:depth])
        inner = path[len(folder) + 1 :] if folder else path
        for pattern, kind, value in files.get(folder, ()):
            glob = _glob(pattern)
            if glob and glob.fullmatch(inner):
                state[kind] = value
    return {k for k, v in state.items() if v}


def path_patterns(path: str) -> list[str]:
    """The patterns of a path that can be mined: each directory's name and the compound ending."""
    *folders, name = path.split("/")
    out = [f"{x.lower()}/" for x in dict.fromkeys(folders[1:])]
    m = re.search(r"((?:\.[A-Za-z0-9_]+){2,})$", name)
    if m:
        out.append("*" + re.sub(r"[0-9a-f]{6,}", "#", m.group(1).lower()))
    m = re.search(r"(_pb|_generated|_gen)\.[a-z]+$", name)
    if m:
        out.append("*" + m.group(0))
    return out


_JUDGED = "path string, source string, verdict string, patterns array<string>, declared string"


def _attribute_files(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("path").endswith(".gitattributes") & F.col("path").rlike(r"(^|/)\.gitattributes$") & F.col("text").isNotNull()).select(F.col("source").cast("string").alias("source"), "path", F.col("text").cast("string").alias("text"))


def classify_files(docs: DataFrame, thirdparty: DataFrame, max_library_bytes: int = 64 << 20, max_attribute_bytes: int = 64 << 20) -> DataFrame:
    """(path, source, verdict, patterns, declared) of every code document with text.

    ``thirdparty`` is the table of known library files; it is sent to every worker, so its size is
    checked against ``max_library_bytes``. ``declared`` has the kinds that attribute files (documents named
    .gitattributes) of the source give the path, '' for none; up to ``max_attribute_bytes`` of them are sent
    to every worker as well, beyond that they are joined by source and directory. Null, empty and blank
    texts, and other endings than .ts, .tsx, .js and .cs have no rows; repeated paths are judged each by itself.
    """
    tune(docs.sparkSession)
    size = thirdparty.select(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_library_bytes:
        raise ValueError(f"the known libraries have {size} bytes; at most {max_library_bytes} are sent to every worker")
    texts = [r["text"] for r in thirdparty.filter(F.col("text").isNotNull()).select("text").distinct().collect()]
    shared = docs.sparkSession.sparkContext.broadcast(sorted(texts))
    files = _attribute_files(docs)
    few = (files.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= max_attribute_bytes
    rules = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in files.collect()] if few else [])
    code = docs.select("path", F.col("source").cast("string"), F.col("text").cast("string")).filter(F.col("path").rlike(CODE) & (F.length(F.trim("text")) > 0))

    def run(batches):
        known, attributes = Libraries(shared.value), Attributes(rules.value)
        for b in batches:
            verdicts, patterns, said = [], [], []
            for path, source, text in zip(*(c.to_pylist() for c in b.columns)):
                verdicts.append(classify(text, path.rstrip().endswith(".cs"), known))
                patterns.append(path_patterns(path.strip()))
                said.append(",".join(sorted(attributes.kinds(source, path.strip()))))
            cols = [b.column(0), b.column(1), pa.array(verdicts, pa.string()), pa.array(patterns, pa.list_(pa.string())), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["path", "source", "verdict", "patterns", "declared"])

    judged = widen(code).mapInArrow(run, _JUDGED)
    return judged if few else declare(judged, files)


def declare(judged: DataFrame, files: DataFrame) -> DataFrame:
    """The judged files with ``declared`` from more attribute files than fit into a worker.

    A path is joined to the attribute files of the directories above it, for each directory by itself, so
    that no key holds a whole source. The files that it meets are few: one a directory at most, and of them
    all one row is made.
    """
    own = files.select(F.coalesce("source", F.lit("")).alias("s"), F.regexp_replace(F.trim("path"), r"/?[^/]*$", "").alias("dir"), "text")
    rows = judged.withColumn("row", F.monotonically_increasing_id()).drop("declared")
    rows = cut_lineage(rows)  # the row's number must not change between its uses
    up = rows.select("row", F.coalesce("source", F.lit("")).alias("s"), F.explode(ancestors(F.trim("path"))).alias("dir"))
    # the top file of a source may define macros for all others
    met = up.join(own, ["s", "dir"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("dir", "text"))).alias("a"))
    both = rows.join(met, "row", "left").select("path", "source", "verdict", "patterns", "a")

    def run(batches):
        for b in batches:
            said = []
            for path, found in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
                given = Attributes([("", f"{x['dir']}/.gitattributes".lstrip("/"), x["text"]) for x in found or ()])
                said.append(",".join(sorted(given.kinds("", path.strip()))))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(said, pa.string())], names=["path", "source", "verdict", "patterns", "declared"])

    return both.mapInArrow(run, _JUDGED)


def mine_patterns(judged: DataFrame) -> DataFrame:
    """(pattern, files, proven, rate): how often the files under a path pattern are proven by content."""
    proven = F.coalesce(F.col("verdict") != "undecided", F.lit(False)).cast("long")
    rows = judged.select(F.explode("patterns").alias("pattern"), proven.alias("p"))
    return rows.groupBy("pattern").agg(F.count("*").alias("files"), F.sum("p").alias("proven")).withColumn("rate", F.col("proven") / F.col("files"))


def machine_made(docs: DataFrame, thirdparty: DataFrame, **options) -> DataFrame:
    """(path, source, reason) of the files that nobody wrote by hand in this repository.

    A declaration in an attribute file counts as it is; content evidence counts as it is; an undecided
    file counts if one of its path patterns was proven in ``MINED_RATE`` of at least ``MINED_FILES`` files.
    """
    judged = cut_lineage(classify_files(docs, thirdparty, **options))
    good = mine_patterns(judged).filter((F.col("files") >= MINED_FILES) & (F.col("rate") >= MINED_RATE)).select("pattern")
    sure = judged.filter((F.col("declared") != "") | (F.col("verdict") != "undecided")).select("path", "source", F.coalesce(F.when(F.col("declared") != "", F.concat(F.lit("declared "), "declared")), F.col("verdict")).alias("reason"))
    open_ = judged.filter((F.col("declared") == "") & (F.col("verdict") == "undecided")).select("path", "source", F.explode("patterns").alias("pattern"))
    tipped = open_.join(good, "pattern").select("path", "source", F.lit("pattern").alias("reason")).distinct()
    return sure.unionByName(tipped)
