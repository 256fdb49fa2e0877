"""Credentials embedded in source code and configuration (problem 6).

One deterministic automaton (Aho-Corasick) over the token prefixes, the key armor, the keys of connection
strings in plain and base64 form, and credential names scans a text in overlapping windows. Each of its
words names the grammars that may follow it, and only those are tried, on the line of the hit. Spans are
absolute and deduplicated, so windows may overlap as they like. A span is the literal value alone: quotes,
keys and addresses around it stay, and a placeholder is spliced in for it. Tokens of unknown issuers, a
short prefix and a long random body, have no word of their own; one more expression finds those.

Each grammar takes time in proportion to the line, however long.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import tune, widen

PLACEHOLDER = "REDACTED"
#: Windows of a long text and their overlap, in characters; a value that begins in a window is read to its end.
WINDOW, OVERLAP = 1 << 16, 1 << 12

# Grammars that a word of the automaton calls for.
NAMED, PAIR, ADDRESS, ARMOR, FORMAT, PLAIN, ENCODED = (1 << i for i in range(7))

# Words of the automaton, all in lower case.
_NAMES = "password passwd passwort passphrase passcode pass pwd kennwort token tok secret hdr authorization authheader auth_header auth-header credential bearer".split()
_KEYS = ["api", "app", "access", "signing", "subscription", "private", "encryption", "account", "shared", "master", "auth", "secret", "storage", "service", "client", "license", "deploy", "session", "hmac", "jwt", "webhook", "consumer"]
_PAIR_KEYS = ["password", "passwd", "pwd", "accountkey", "sharedaccess", "sharedsecret"]
_TOKENS = ["eyj", "akia", "asia", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "sk_live_", "rk_live_", "sk-", "aiza", "npm_", "sg."]
#: Words whose base64 forms are looked for, in the spellings that are usual.
_WITHIN = ["password", "Password", "PASSWORD", "passwd", "Passwd", "pwd", "Pwd", "PWD", "AccountKey", "SharedAccess", "SharedSecret", "://"]


def base64_forms(word: str) -> set[str]:
    """What a word looks like inside base64, in lower case, wherever in a group of three bytes it begins."""
    out = set()
    for shift in range(3):
        body = base64.b64encode(bytes(shift) + word.encode()).decode()
        out.add(body[-(-shift * 8 // 6) : (shift + len(word)) * 8 // 6].lower())
    return out


def _vocabulary() -> dict[str, int]:
    words: dict[str, int] = {}

    def add(word: str, grammars: int) -> None:
        words[word] = words.get(word, 0) | grammars

    for w in _NAMES:
        add(w, NAMED | ENCODED)
    for k in _KEYS:
        for sep in ("", "_", "-"):
            add(k + sep + "key", NAMED | ENCODED)
    for w in _PAIR_KEYS:
        add(w, PAIR | NAMED)
    for w in _TOKENS:
        add(w, FORMAT)
    add('"key"', PLAIN)
    add("-----begin", ARMOR)
    add("://", ADDRESS)
    for w in _WITHIN:
        for form in base64_forms(w):
            add(form, ENCODED)
    return words


_KEYWORD = (
    r"(?:pass(?:word|wd|wort|phrase|code)?|pwd|kennwort|secret|tok(?:en)?|credentials?|auth[_-]?header|authorization|hdr"
    r"|(?:api|app|access|signing|subscription|private|encryption|account|shared|master|auth|secret|storage|service|client|license|deploy|session|hmac|jwt|webhook|consumer)[_-]?key)"
)
#: The end of a name: a credential word and perhaps a running number. What is before it is looked up after a match.
_NAME = rf"{_KEYWORD}[_-]?\d{{0,4}}(?![A-Za-z0-9_-])"
_SCHEME = r"(?:(?:Bearer|Basic|Token|ApiKey|Digest|Negotiate)\s+)?"
_JOIN = r"[\"'`\]\)]*\s*(?:\?\?=|\|\|=|:=|=>|=|:|,)\s*"
_QUOTED = re.compile(rf"(?i)(?P<name>{_NAME}){_JOIN}(?:\|?>?[-+]?\s*\n\s*)?(?:new\s*(?:\w*\[\])?\s*)?[{{(\[]?\s*[@$]*(?P<q>[\"'`]){_SCHEME}(?P<v>[^\"'`\n]*)(?P<end>(?P=q)|$|\n)")
_BARE = re.compile(rf"(?i)(?P<name>{_NAME})[\"']?\s*(?P<op>=|:)\s*(?P<scheme>{_SCHEME})(?P<v>[^\s\"'`|,]+)")
_TABLE = re.compile(rf"(?i)(?P<name>{_NAME})`?\s*(?:\|\s*`?|to `){_SCHEME}(?P<v>[^\s|`]+)")
_PLAIN_KEY = re.compile(r"(?P<name>\"(?:Key|key)\")\s*:\s*\"(?P<v>[^\"\n]*)\"")
_PAIR = re.compile(r"(?i)(?<![\w-])(?:password|passwd|pwd|accountkey|sharedaccesskey|sharedaccesssignature|sharedsecret)\s*=\s*(?:'(?P<a>[^'\n;]*)'|\\?\"(?P<b>[^\"\n;\\]*)\\?\"|(?P<c>[^;\"'`\s|<>]+))")
_LINKED = re.compile(r"(?i)(?:server|host|data source|database|initial catalog|user id|username|uid|user|addr(?:ess)?|endpoint|accountname|sharedaccesskeyname)\s*=")
_URL = re.compile(r"://(?P<user>[^\s/:@\"'`<>]*):(?P<v>[^\s/@\"'`<>]+)(?P<end>@|[\"'`])")
_ARMOR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ARMOR_BODY = re.compile(r"(?:\\n|\\r|[\s/#*|\"'+>;-])*[A-Za-z0-9+/=:]{16,}|[ \t\r\n`\"']*\Z")
_ARMOR_LINES = re.compile(r"(?:[ \t\r\n]*(?://|#|\*)?[ \t]*[A-Za-z0-9+/=]{8,}[ \t]*\r?(?:\n|$))+")
_ARMOR_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_FORMATS = re.compile(
    r"(?<![A-Za-z0-9_-])(?:eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}|A(?:KIA|SIA)[A-Z0-9]{16}|gh[pos]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{20,}"
    r"|xox[abp]-[\w-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{32,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}"
    r")(?![A-Za-z0-9_])"
)
#: A short prefix of small letters, perhaps the environment, and a long body: what most issuers' tokens look like.
_ISSUED = re.compile(r"(?<![A-Za-z0-9_.-])[a-z]{2,6}(?:_(?:live|test|prod))?[_.-](?P<body>[A-Za-z0-9]{24,})(?![A-Za-z0-9_])")
_ENCODED = re.compile(r"(?P<key>[ \t]*[\"']?[\w.-]+[\"']?[ \t]*:[ \t]*[\"']?)(?P<v>[A-Za-z0-9+/]{8,}={0,2})[\"']?,?[ \t\r]*$", re.M)
#: What a bare value after a colon may stand behind, unless its name begins the line: a comment, a literal or an argument.
_OPENS = re.compile(r"//|--|[#*;\"'`(]")
_BEGINS = re.compile(r"\s*(?:-\s+)?[\"']?")
_GOES_ON = re.compile(r"\s*(?:\+|\\|\.)\s*\n?\s*[@$]?([\"'`])([^\"'`\n]*)\1")
_STAND_IN = re.compile(
    r"(?i)\$\{|\$\(|\{\{|\}\}|<[^<>]*>?$|^%[^%]*%$|^\{[\w.]*\}$|^\$\w+$|^[*xX.#?_\-\s]*$|^@\w+\(|^env:|\benv\.|getenv|environ|vault|keyvault|secretsmanager|^ssm:|^op://|^file:"
    r"|your[_-]?|replace[_-]?me|change[_-]?(?:me|it)|placeholder|redacted|^set at|insert[_-]|^todo\b|dummy|^(?:null|none|nil|undefined|true|false|string|empty|hidden|secret|password|token)$"
)
_PUBLIC = re.compile(r"-----BEGIN|^ssh-(?:rsa|ed25519)|^ecdsa-")


def _flips(v: str) -> int:
    return sum(a.isupper() != b.isupper() for a, b in zip(v, v[1:]) if a.isalpha() and b.isalpha())


def is_random(v: str) -> bool:
    """Whether letters of both cases and digits are mixed as by chance, not as in names (capitals begin words) or digests."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in v]
    if len(set(kinds)) < 3:
        return False
    alone = sum(a == "u" and b != "l" for a, b in zip(kinds, [*kinds[1:], "d"]))
    return alone >= 4 or sum(a != b for a, b in zip(kinds, kinds[1:])) >= 0.4 * (len(v) - 1)


def is_literal(v: str, name: str = "", bare: bool = False) -> bool:
    """Whether a value is a credential itself rather than a placeholder, a reference, a hint or code.

    A bare value stands without quotes, where code could stand as well, and has to look random.
    """
    if len(v) < 5 or v.isspace() or _STAND_IN.search(v) or _PUBLIC.search(v) or " " in v.strip():
        return False
    if v[0] in "/~" and re.fullmatch(r"[/~][\w./-]+", v) and v.count("/") >= 2 and not (re.search(r"[A-Z]", v) and re.search(r"\d", v)):
        return False  # a path
    if re.match(r"[a-zA-Z][\w+.-]*://", v) or re.search(r"(?i)(?:server|host|data source|database|endpoint)=", v):
        return False  # an address or connection string: its own grammar finds what is in it
    decoded = decode(v)
    if decoded is not None and (_STAND_IN.search(decoded) or " " in decoded.strip()):
        return False
    varied = any(c.isdigit() for c in v) or bool(re.search(r"[^\w.\-]", v))
    if re.search(r"(?i)(?:pass\w*|pwd|kennwort)[_-]?\d*$", name):
        if not bare:
            return not re.fullmatch(r"[a-z]+|[A-Z][a-z]+", v) or len(v) > 14
        if re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+){2,}", v):
            return True  # a passphrase
        return not re.search(r"[()\[\]{};]|^[\w$]+(?:\.[A-Za-z_$][\w$]*)+$", v.rstrip(";,")) and (varied or _flips(v) >= 3 or "-" in v and _flips(v) >= 1)
    if len(v) < 12:
        return False
    if bare and re.search(r"[()\[\]{};<>]|^[\w$]+(?:\.[A-Za-z_$]+)+$", v):
        return False
    if re.fullmatch(r"[a-z]+(?:[-_.][a-z]+)*|[A-Za-z]+", v) and _flips(v) < 4:
        return False  # words
    return varied or _flips(v) >= 4


def decode(v: str) -> str | None:
    """The printable text that a base64 value stands for, or None."""
    if len(v) < 8 or len(v) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", v):
        return None
    try:
        raw = base64.b64decode(v, validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    return raw if raw.isprintable() else None


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, grammars in _vocabulary().items():
        a.add_word(word, grammars)
    a.make_automaton()
    return a


_machine: list = []


def hits(text: str) -> list[tuple[int, int]]:
    """(offset, grammars) of each place at which the automaton ends words, in order, over overlapping windows."""
    if not _machine:
        _machine.append(_automaton())
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if len(low) <= WINDOW:
        return list(_machine[0].iter(low))
    found = set()
    for at in range(0, len(low), WINDOW - OVERLAP):
        found.update((at + end, grammars) for end, grammars in _machine[0].iter(low[at : at + WINDOW]))
    return sorted(found)


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, family) of every credential's literal value in a text, in order and without overlap.

    Families: value (assigned to a credential name), pair (connection string), address, armor, format
    and encoded; 'more' marks the rest of a value that goes on in another literal. Null and empty texts
    have none.
    """
    if not text:
        return []
    out: dict[int, tuple[int, str]] = {}

    def add(start: int, end: int, family: str) -> None:
        if end > start and (start not in out or out[start][0] < end):
            out[start] = (end, family)

    line_end, begin, grammars = -1, 0, 0
    for at, more in hits(text):
        if at >= line_end:
            if grammars:
                _line(text, begin, line_end, grammars, add)
            begin = text.rfind("\n", 0, at + 1) + 1
            line_end = text.find("\n", at)
            line_end = len(text) if line_end < 0 else line_end
            grammars = 0
        grammars |= more
    if grammars:
        _line(text, begin, line_end, grammars, add)
    for m in _ISSUED.finditer(text):
        if is_random(m["body"]):
            add(m.start(), m.end(), "format")
    spans, done = [], -1
    for start in sorted(out):
        end, family = out[start]
        if start >= done:
            spans.append((start, end, family))
            done = end
    return spans


def _encoded(key: str, raw: str) -> bool:
    if re.search(rf"(?i){_KEYWORD}[_-]?\d{{0,4}}$", key) and is_literal(re.sub(rf"^{_SCHEME}", "", raw), key):
        return True
    return any(is_literal(m["a"] or m["b"] or m["c"] or "", "password") for m in _PAIR.finditer(raw)) or any(m["end"] == "@" and is_literal(m["v"], "password") for m in _URL.finditer(raw))


def _name_start(text: str, at: int, begin: int) -> int:
    """Where the name begins that has its credential word at ``at``."""
    while at > begin and (text[at - 1] in "$.-_" or text[at - 1].isalnum()):
        at -= 1
    return at


def _line(text: str, begin: int, line_end: int, grammars: int, add) -> None:
    """Try grammars on one line; a quoted value may stand on the line after its name."""
    if grammars & ARMOR:
        for m in _ARMOR.finditer(text, begin, line_end):
            stop = text.find("-----BEGIN", m.end())
            end = _ARMOR_END.search(text, m.end(), stop if stop >= 0 else len(text))
            if _ARMOR_BODY.match(text, m.end()):
                rest = end or _ARMOR_LINES.match(text, m.end())
                add(m.start(), rest.end() if rest else m.end(), "armor")
    if grammars & PAIR:
        last = text.rfind(";", begin, line_end)
        linked = None
        for m in _PAIR.finditer(text, begin, line_end):
            g = "a" if m["a"] is not None else "b" if m["b"] is not None else "c"
            if linked is None:  # other keys of a connection string, with a semicolon somewhere behind
                linked = [x.start() for x in _LINKED.finditer(text, begin, line_end) if x.end() <= last]
            if linked and (linked[0] < m.start() or text[m.end() : m.end() + 1] == ";" and linked[-1] >= m.end()):
                v = m[g]
                if is_literal(v + _rest(text, m.end(g)), "password"):
                    add(m.start(g), m.end(g), "pair")
                    _go_on(text, m.end(g), add)
    if grammars & ADDRESS:
        for m in _URL.finditer(text, begin, line_end):
            scheme = _name_start(text, m.start(), begin)
            if not re.match(r"[A-Za-z]|.*[.-][A-Za-z]", text[scheme : m.start()]) or not (text[m.start() - 1].isascii() and text[m.start() - 1].isalnum()):
                continue
            v, user = m["v"], m["user"]
            if m["end"] == "@" and (is_literal(v, "password") or len(v) >= 5 and not _STAND_IN.search(v)):
                add(m.start("v"), m.end("v"), "address")
            elif m["end"] != "@" and not v.isdigit() and "." not in user and (rest := _GOES_ON.match(text, m.end())):
                if "@" in rest.group(2) and not _STAND_IN.search(v):
                    add(m.start("v"), m.end("v"), "address")
                    add(rest.start(2), rest.start(2) + rest.group(2).index("@"), "more")
    if grammars & FORMAT:
        for m in _FORMATS.finditer(text, begin, line_end):
            if _flips(m.group()) >= 3 or any(c.isdigit() for c in m.group()):
                add(m.start(), m.end(), "format")
    if grammars & PLAIN:
        for m in _PLAIN_KEY.finditer(text, begin, line_end):
            if len(m["v"]) >= 20 and is_literal(m["v"], "key") and (_flips(m["v"]) >= 4 or re.fullmatch(r"[0-9a-f]{32,}|[A-Z2-7]{24,}", m["v"])):
                add(m.start("v"), m.end("v"), "value")
    if grammars & ENCODED:
        m = _ENCODED.match(text, begin, line_end)
        raw = decode(m["v"]) if m else None
        if raw is not None and len(raw) >= 5 and _encoded(m["key"].strip(" \t\n\"':"), raw):
            add(m.start("v"), m.end("v"), "encoded")
    if grammars & NAMED:
        _named(text, begin, line_end, add)


def _named(text: str, begin: int, line_end: int, add) -> None:
    """Values that are assigned to credential names on a line."""
    after = text.find("\n", line_end + 1)
    for m in _QUOTED.finditer(text, begin, len(text) if after < 0 else after):
        if m.start() > line_end:
            break
        name = text[_name_start(text, m.start(), begin) : m.end("name")]
        if is_literal(m["v"] + (_rest(text, m.end("v")) if m["end"] == m["q"] else ""), name):
            add(m.start("v"), m.end("v"), "value")
            if m["end"] == m["q"]:
                _go_on(text, m.end() - 1, add)
    for m in _TABLE.finditer(text, begin, line_end):
        if is_literal(m["v"], text[_name_start(text, m.start(), begin) : m.end("name")], bare=True):
            add(m.start("v"), m.end("v"), "value")
    opens = None
    for m in _BARE.finditer(text, begin, line_end):
        v, start = m["v"].rstrip(";,"), _name_start(text, m.start(), begin)
        if m["op"] == ":":
            opens = opens or _OPENS.search(text, begin, line_end)
            if not (opens and opens.end() <= start) and _BEGINS.match(text, begin, start).end() != start:
                continue  # a type annotation or a property of an expression
            if text[m.end("v") - 1] == ";" or text[m.start("v") - 1] == ":":
                continue
        if is_literal(v, text[start : m.end("name")], bare=True):
            add(m.start("v"), m.start("v") + len(v), "value")


def _rest(text: str, at: int) -> str:
    """What concatenated literals add to a value whose closing quote is at ``at``, up to its end in a pair or address."""
    out = ""
    at += 1 if text[at : at + 1] in ("\"", "'", "`") else 0
    while at and text[at - 1] in "\"'`" and (m := _GOES_ON.match(text, at)):
        piece = m.group(2)
        cut = re.search(r"[;@]", piece)
        out += piece[: cut.start()] if cut else piece
        if cut:
            break
        at = m.end()
    return out


def _go_on(text: str, at: int, add) -> None:
    """Mark the literals that a concatenation adds to a value whose closing quote is at ``at``."""
    if text[at : at + 1] not in ("\"", "'", "`"):
        return
    at += 1
    while m := _GOES_ON.match(text, at):
        piece = m.group(2)
        cut = re.search(r"[;@]", piece)
        add(m.start(2), m.start(2) + (cut.start() if cut else len(piece)), "more")
        at = m.end()


def lines_of(text: str, spans) -> list[int]:
    """Lines, counted from 1, on which a credential begins; each once."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    return sorted({bisect_right(breaks, s - 1) + 1 if s else 1 for s, _, family in spans if family != "more"})


def redact(text: str | None, spans=None) -> str | None:
    """The text with a placeholder for every credential and nothing else changed.

    Line breaks inside a masked value are kept, so that lines keep their numbers.
    """
    if not text:
        return text
    out, at = [], 0
    for s, e, family in find_spans(text) if spans is None else spans:
        out += [text[at:s], PLACEHOLDER if family != "more" else "", re.sub(r"[^\n]", "", text[s:e])]
        at = e
    return "".join([*out, text[at:]])


def find_credentials(df: DataFrame, tab: str, id_col: str, text_col: str) -> DataFrame:
    """(tab, id, line) of each line on which a credential begins; lines are counted within the text.

    Repeated rows of an id count once. Null and empty texts have no rows. The only shuffle is that of
    the few found rows.
    """
    tune(df.sparkSession)

    def run(batches):
        for b in batches:
            ids, lines = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                spans = find_spans(text)
                if spans:
                    own = lines_of(text, spans)
                    ids += [i] * len(own)
                    lines += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(lines, pa.int32())], names=["id", "line"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") > 0)
    return widen(rows).mapInArrow(run, "id bigint, line int").distinct().select(F.lit(tab).alias("tab"), "id", "line")


def redact_credentials(df: DataFrame, text_col: str) -> DataFrame:
    """The frame with ``text_col`` masked and a column n_credentials (an existing one is replaced); no shuffle."""
    tune(df.sparkSession)
    keep = [c for c in df.columns if c not in (text_col, "n_credentials")]

    def run(batches):
        for b in batches:
            texts, counts = [], []
            for text in b.column(0).to_pylist():
                spans = find_spans(text)
                texts.append(redact(text, spans))
                counts.append(sum(f != "more" for _, _, f in spans))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[*keep, text_col, "n_credentials"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{text_col}` string", "n_credentials int"])
    return widen(df.select(F.col(text_col).cast("string"), *(F.col(f"`{c}`") for c in keep))).mapInArrow(run, schema)
