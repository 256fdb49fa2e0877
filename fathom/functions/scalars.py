"""Column functions: paths, labels, identifiers, lines and numbers, all evaluated inside the JVM.

A null argument gives null unless a function says otherwise.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies of the file classification.
BINARY_ENDINGS = """.png .jpg .jpeg .gif .bmp .ico .webp .svgz .pdf .zip .gz .tar .tgz .7z .rar .bz2 .xz .dll .exe .so .dylib .a .o .lib .pdb
.class .jar .wasm .pyc .woff .woff2 .ttf .otf .eot .mp3 .mp4 .mov .avi .mkv .wav .flac .bin .dat .db .sqlite""".split()
LANGUAGES = {"typescript": [".ts", ".mts", ".cts"], "tsx": [".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "csharp": [".cs"], "markdown": [".md", ".mdx"], "json": [".json"]}
SOURCE_ENDINGS = ".ts .tsx .js .jsx .mjs .cjs .mts .cts .cs .go .py .rb .java .rs .c .h .cpp .hpp .php .swift .kt".split()
DOC_ENDINGS = ".md .mdx .rst".split()
CONFIG_ENDINGS = ".json .yml .yaml .toml .ini .config .csproj .props .targets .editorconfig .xml".split()
STOP_WORDS = (
    "a an the to of in on at for and or is are be i want wanna would like my me it this that with how do need please can should "
    "ich möchte moechte will der die das den dem ein eine einen und oder zu von mit für fuer wie soll möchten im am"
).split()


def _folding() -> tuple[str, str]:
    """Accented Latin letters and the letters they stand on, derived from their decompositions."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


# -- paths


def norm_path(c: Column) -> Column:
    """Path in normal form: trimmed, single forward slashes, relative. Null stays null, blank becomes ''."""
    p = F.regexp_replace(F.regexp_replace(c, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", ""), r"[\\/]+", "/")
    return F.regexp_replace(p, r"^(?:\.?/)+", "")


def norm_hash(c: Column) -> Column:
    """A content hash as 64 lower-case hex digits, or null where none can be read."""
    return F.nullif(F.regexp_extract(F.lower(c), r"(?:^|[^0-9a-f])([0-9a-f]{64})(?:$|[^0-9a-f])", 1), F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What is before the last slash, '' for a path without one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ext(path: Column) -> Column:
    """The last ending with its dot, '' without one."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    """The name without its last ending: login.test for login.test.ts."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def resolve_dots(path: Column) -> Column:
    """Drop empty and '.' segments; '..' takes the segment before it and stops at the root."""
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))


def dir_distance(a: Column, b: Column) -> Column:
    """Segments that two directories do not share, counted from the root on both sides."""
    x, y = F.filter(F.split(a, "/"), lambda s: s != ""), F.filter(F.split(b, "/"), lambda s: s != "")
    same = F.zip_with(F.slice(x, 1, F.least(F.size(x), F.size(y))), F.slice(y, 1, F.least(F.size(x), F.size(y))), lambda p, q: p == q)
    # the shared prefix ends at the first difference
    shared = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("long"))
    return (F.size(x) + F.size(y) - 2 * shared).cast("int")


def ancestors(path: Column) -> Column:
    """Every directory above a path, the root '' first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


# -- classification


def is_test(path: Column) -> Column:
    name = basename(path)
    return (
        path.contains("/__tests__/") | path.contains("/__mocks__/") | path.contains("/Tests/") | path.startswith("Tests/")
        | F.lower(name).contains(".test.") | F.lower(name).contains(".spec.") | name.endswith("Tests.cs") | name.endswith("Test.cs")
    )


def detect_language(path: Column) -> Column:
    e, out = F.lower(ext(path)), F.lit("none")
    for language, endings in LANGUAGES.items():
        out = F.when(e.isin(*endings), language).otherwise(out)
    return out


def classify_kind(path: Column) -> Column:
    """test, doc, config, source or other; the first that applies in this order."""
    e, name = F.lower(ext(path)), basename(path)
    config = e.isin(*CONFIG_ENDINGS) | (name == ".gitignore") | F.lower(name).startswith("appsettings") | F.lower(name).startswith("tsconfig")
    return (
        F.when(is_test(path), "test")
        .when(e.isin(*DOC_ENDINGS) | (F.lower(name) == "readme"), "doc")
        .when(config, "config")
        .when(e.isin(*SOURCE_ENDINGS), "source")
        .otherwise("other")
    )


def is_binary_ending(path: Column) -> Column:
    return F.lower(ext(path)).isin(*BINARY_ENDINGS)


def is_vendor(path: Column) -> Column:
    p = F.lower(path)
    return p.contains(".min.") | p.contains(".generated.") | p.contains("/vendor/") | p.contains("/dist/") | p.startswith("vendor/")


def glob_to_regex(glob: str) -> str:
    """Java and RE2 regular expression of a glob: * and ? stay in a segment, ** crosses segments."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.sub(r"([\\.^$+{}()|\[\]])", r"\\\1", c)), i + 1
    return f"^{out}$"


def ignore_rules(lines: list[str]) -> list[tuple[str, bool, bool]]:
    """(regex, negated, directories only) of ignore-file lines: an inner or leading slash anchors a rule."""
    rules = []
    for line in lines:
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        negated, rule = rule.startswith("!"), rule.removeprefix("!")
        only_dirs, rule = rule.endswith("/"), rule.rstrip("/")
        anchored, rule = "/" in rule, rule.lstrip("/")
        body = glob_to_regex(rule)[1:-1]
        rules.append((f"^{body}$" if anchored else f"^(?:.*/)?{body}$", negated, only_dirs))
    return rules


def is_ignored(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Whether a file or any directory above it is ignored; the last rule that matches wins."""

    def verdict(p: Column, is_dir: bool) -> Column:
        out = F.lit(False)
        for regex, negated, only_dirs in rules:
            if is_dir or not only_dirs:
                out = F.when(p.rlike(regex), not negated).otherwise(out)
        return out

    above = F.filter(ancestors(path), lambda d: d != "")
    return verdict(path, False) | F.exists(above, lambda d: verdict(d, True))


# -- text


#: What a full-text token is made of.
TOKEN = r"[\p{L}\p{N}\p{Co}]"
NO_TOKEN = r"[^\p{L}\p{N}\p{Co}]"


def fold(c: Column) -> Column:
    """Lower case without the accents of Latin letters; plain ASCII skips the slow translation."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(F.lower(c), ACCENTED, PLAIN))


def words(c: Column) -> Column:
    """Full-text tokens: runs of letters and numbers of the folded text; null gives none."""
    return F.filter(F.split(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def tokenize(c: Column) -> Column:
    """Query tokens: runs of letters and decimal digits, in lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def split_identifier(c: Column) -> Column:
    """Parts of a name at humps, acronym ends, digits and other characters; lower case, each once, in order."""
    s = F.regexp_replace(c, r"[^A-Za-z0-9]+", " ")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    s = F.regexp_replace(s, r"([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Za-z])([0-9])", "$1 $2")
    s = F.regexp_replace(s, r"([0-9])([A-Za-z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(s), " "), lambda t: t != ""))


def lines(c: Column) -> Column:
    """Lines of a text; one final line break is dropped; an empty text has none."""
    t = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"\n\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1))


def count_lines(c: Column) -> Column:
    """Line feeds plus one, less one for a final line feed; 0 for an empty text."""
    n = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.when(c == "", 0).otherwise(n + 1 - F.when(c.endswith("\n"), 1).otherwise(0)).cast("int")


def signature(c: Column) -> Column:
    """First line up to the brace, white space collapsed."""
    return F.trim(F.regexp_replace(F.substring_index(F.substring_index(c, "\n", 1), "{", 1), r"\s+", " "))


def doc_summary(c: Column) -> Column:
    """First line of a documentation, 140 characters at most."""
    return F.substring(F.trim(F.substring_index(c, "\n", 1)), 1, 140)


def specificity(heading: Column, terms: list[str]) -> Column:
    """Share of a heading's parts that are query terms; 0 without parts."""
    parts = split_identifier(heading)
    hit = F.size(F.filter(parts, lambda p: p.isin(*terms))) if terms else F.lit(0)
    return F.when(F.size(parts) > 0, hit / F.size(parts)).otherwise(0.0)


# -- numbers and identity


def round4(c: Column) -> Column:
    """Four decimals, halves upwards."""
    return F.floor(c * 1e4 + 0.5) / 1e4


def quantize(c: Column) -> Column:
    """Two significant digits, halves away from zero; below 100 unchanged."""
    m = F.pow(F.lit(10.0), F.length(c.cast("string")) - 2)
    return F.when(c < 100, c.cast("long")).otherwise((F.floor(c / m + 0.5) * m).cast("long"))


def scale_tokens(c: Column, factor: float) -> Column:
    """Tokens under another tokenizer's factor, rounded up, at most the largest int."""
    return F.least(F.ceil(c * F.lit(factor)), F.lit(2**31 - 1)).cast("long")


def price(tokens: Column, rate: float, currency: str = "USD") -> Column:
    """Price text of so many tokens at a rate per million; null for a rate of 0 or less."""
    if rate <= 0:
        return F.lit(None).cast("string")
    cents = F.floor(F.abs(tokens) * rate / 1e4 + 0.5).cast("long")
    number = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    sign = F.when((tokens < 0) & (cents > 0), "-").otherwise("")
    return F.concat(sign, F.lit("$" if currency == "USD" else f"{currency} "), number)


def short_hash(c: Column) -> Column:
    return F.substring(c, 1, 12)


def hash_matches(stored: Column, given: Column) -> Column:
    """Whether a given hash of 8 digits or more is a prefix of the stored one, without case."""
    return (F.length(given) >= 8) & F.lower(stored).startswith(F.lower(given))


def is_receipt(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_-]{43}$")


def canonical_hash(*fields: Column) -> Column:
    """SHA-256 over the fields, each led by its length in bytes and a colon."""
    parts = []
    for f in fields:
        parts += [F.octet_length(f).cast("string"), F.lit(":"), f]
    return F.sha2(F.concat(*parts), 256)


def receipt(hexhash: Column) -> Column:
    """A hash of 64 hex digits as 43 characters that are safe in addresses."""
    return F.translate(F.rtrim(F.base64(F.unhex(hexhash)), F.lit("=")), "+/", "-_")


def strictly_contains(outer_start: Column, outer_end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (outer_start <= inner_start) & (outer_end >= inner_end) & ((outer_start < inner_start) | (outer_end > inner_end))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def valid_tag(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike("^[a-z0-9_-]{1,32}$")


def compress_reasons(reasons: Column, keep: int = 2) -> Column:
    """Each reason once, in order; graph reasons beyond ``keep`` become one 'graph:+n' after the last kept one."""
    once = F.array_distinct(reasons)
    graph = lambda r: r.rlike("^(?:imports|imported-by|tested-by|test-of):")
    g = F.filter(once, graph)
    last = F.when(F.size(g) > keep, F.array_position(once, F.element_at(g, keep)))
    kept = F.filter(once, lambda r: ~graph(r) | F.array_contains(F.slice(g, 1, keep), r))
    at = F.array_position(kept, F.element_at(g, keep))
    note = F.array(F.concat(F.lit("graph:+"), (F.size(g) - keep).cast("string")))
    return F.when(last.isNotNull(), F.concat(F.slice(kept, F.lit(1), at.cast("int")), note, F.slice(kept, at.cast("int") + 1, F.greatest(F.size(kept), F.lit(1))))).otherwise(kept)
