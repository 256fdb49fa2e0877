"""A state machine over source text: what is code, what is a comment or literal, and where functions are.

``mask`` blanks comments and literals without moving anything; on the rest, brackets are matched to delimit
declarations, and the comment that ends directly before a declaration is its documentation.
"""

from __future__ import annotations

import re
from bisect import bisect_left

# every alternative begins with a plain character, which lets the search skip to one of those
_MASK_SCRIPT = re.compile(r"""/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:\\[\s\S]|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|\$(?!\{)|[^`\\$])*`|/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/""")
_MASK_CS = re.compile(r''''(?:[^'\\\n]|\\[^'\n]+|\\')'|/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|"""[\s\S]*?"""|\$\$*"""[\s\S]*?"""|\$@"(?:[^"]|"")*"|@\$"(?:[^"]|"")*"|@"(?:[^"]|"")*"|"(?:[^"\\\n]|\\.)*"|\$"(?:[^"\\\n]|\\.)*"''')
#: A regular expression follows one of these, or the word return; after anything else a slash divides.
_BEFORE_REGEX = frozenset("=(,:[!&|?{};>")
_SPACES = " \t\n\r\f\v"
_ARROW = re.compile(r"(?:const|let|var)\s+([\w$]+)\s*(?::[^=;{}\n]+)?=\s*(?:async\b\s*)?(?:function\b\s*\*?\s*[\w$]*\s*)?(?:<[^(){}=;\n]*>)?\(")
_MODS = r"(?:export|default|async|declare|function|public|private|protected|static|override|abstract|get|set)\b"
_SCRIPT_HEAD = re.compile(rf"[\n;{{}}][ \t\r]*+(?P<before>(?:(?:{_MODS}|\*)[ \t]*)*)(?<![\w$#.])(?P<name>[A-Za-z_$#][\w$]*+)[ \t]*+(?:<[^(){{}}=;\n]*>)?\(")
_SCRIPT_FUNCTION = re.compile(r"(?:(?:export|default|async|declare)\s+)*function\s*\*?")
_SCRIPT_MODS = re.compile(r"(?:(?:public|private|protected|static|async|override|abstract|get|set|\*)\s*)*")
_CS_HEAD = re.compile(r"[\n;{}][ \t\r]*+(?P<before>(?:\[[^\[\]\n;{}]*\][ \t]*+)*+[\w.?,<>:\[\] \t]++)\(")
_CS_NAME = re.compile(r"(?<![\w$#.])([A-Za-z_]\w*)[ \t]*(?:<[^(){}=;\n]*>)?$")
_CS_PREFIX = re.compile(r"(?:\[[^\[\]]*\]\s*)*(?!(?:return|await|throw|new|else|in|is|case|yield|when|where)\b)(?:[\w.?,<>:]|\[,*\]|(?<=[\w>?,])\s)+")
_NO_NAMES = frozenset("if for while switch catch function return with do else new typeof await using lock foreach fixed sizeof nameof when constructor super import".split())
_AFTER_SCRIPT = re.compile(r"\s*(?::(?:\s*\{[^{}]*\}[^;{}=]*|[^;{}=]*))?\s*(\{|=>\s*\{?|;)")
_AFTER_CS = re.compile(r"\s*(?:where[^{};]*?)?\s*(\{|=>|;)")
_BETWEEN = re.compile(r"(?:\s|\[[^\[\]]*\]|@[\w.]+(?:\([^()]*\))?|\b(?:export|default|public|private|protected|internal|static|async|abstract|override|virtual|sealed)\b)*")


def _blank(s: str) -> str:
    return " " * len(s) if "\n" not in s else "\n".join(" " * len(x) for x in s.split("\n"))


def _divides(text: str, at: int) -> bool:
    """Whether the slash at an offset of a script is an operator."""
    i = at - 1
    while i >= 0 and text[i] in _SPACES:
        i -= 1
    return i < 0 or text[i] not in _BEFORE_REGEX and not (text[i] == "n" and text[max(0, i - 5) : i + 1] == "return" and not (text[i - 6 : i - 5].isalnum() or text[i - 6 : i - 5] == "_"))


def mask(text: str, csharp: bool) -> tuple[str, list[tuple[int, int]]]:
    """The code with comments and literals blanked, and the spans of the comments."""
    comments: list[tuple[int, int]] = []
    out, at, scan = [], 0, 0
    search = (_MASK_CS if csharp else _MASK_SCRIPT).search
    while m := search(text, scan):
        start, scan = m.span()
        if text[start] == "/":
            if text[start + 1] in "/*":
                comments.append((start, scan))
            elif _divides(text, start):
                scan = start + 1
                continue
        out += (text[at:start], _blank(text[start:scan]))
        at = scan
    out.append(text[at:])
    return "".join(out), comments


def _partners(code: str) -> dict[int, int]:
    """Offset of each opening bracket or brace -> offset of its partner."""
    out, stacks = {}, {")": [], "}": []}
    for m in re.finditer(r"[(){}]", code):
        c = m.group()
        if c in "({":
            stacks[")" if c == "(" else "}"].append(m.start())
        elif stacks[c]:
            out[stacks[c].pop()] = m.start()
    return out


def _in_word(code: str, at: int) -> bool:
    return at > 0 and (code[at - 1].isalnum() or code[at - 1] == "_")


def _exported(code: str, at: int) -> int:
    """Where a declaration begins: at the word export before it, if there is one."""
    i = at
    while i > 0 and code[i - 1] in _SPACES:
        i -= 1
    return i - 6 if i < at and code[max(0, i - 6) : i] == "export" and not _in_word(code, i - 6) else at


def extract_functions(text: str, csharp: bool) -> list[dict]:
    """Functions with a body (or an arrow or a semicolon after the parameters), in order of appearance.

    Each has name, signature, doc (cleaned, '' without one), start and end offsets. A function whose
    braces aren't closed ends with the text.
    """
    code, comments = mask(text, csharp)
    partner = _partners(code)
    ends = [e for _, e in comments]
    out = []
    heads = [] if csharp else [(_exported(code, m.start()), m.end() - 1, m.group(1), "const") for m in _ARROW.finditer(code) if not _in_word(code, m.start())]
    for m in (_CS_HEAD if csharp else _SCRIPT_HEAD).finditer("\n" + code):
        before, paren = m.group("before"), m.end() - 2
        if csharp:
            n = _CS_NAME.search(before)
            if n and n.group(1) not in _NO_NAMES and _CS_PREFIX.fullmatch(before[: n.start()].strip()):
                heads.append((m.start("before") - 1, paren, n.group(1), "member"))
            continue
        name, before = m.group("name"), before.strip()
        if name in _NO_NAMES:
            continue
        begin = (m.start("before") if before else m.start("name")) - 1
        if _SCRIPT_FUNCTION.fullmatch(before):
            heads.append((begin, paren, name, "function"))
        elif _SCRIPT_MODS.fullmatch(before):
            heads.append((begin, paren, name, "member" if before else "bare"))
    for start, paren, name, form in sorted(heads):
        close = partner.get(paren)
        if close is None:
            continue
        after = (_AFTER_CS if csharp else _AFTER_SCRIPT).match(code, close + 1)
        if after is None:
            continue
        sign = after.group(1)
        # a const needs an arrow or a body, a bare name a body: else it is a value or a call
        if form == "const" and sign == ";" or form == "bare" and sign != "{" or form in ("function", "member") and not csharp and sign[0] == "=":
            continue
        brace = after.end() - 1 if sign[-1] == "{" else None
        end = partner.get(brace, len(text)) + 1 if brace is not None else code.find(";", after.end() - 1) + 1 or len(text)
        sig = re.sub(r"\s+", " ", text[start : after.start(1)]).strip()
        k = bisect_left(ends, start + 1) - 1
        doc = ""
        if k >= 0 and _BETWEEN.fullmatch(code, ends[k], start):
            first = k
            while first > 0 and text.startswith("//", comments[first][0]) and text.startswith("//", comments[first - 1][0]) and code[ends[first - 1] : comments[first][0]].strip() == "" and code[ends[first - 1] : comments[first][0]].count("\n") <= 1:
                first -= 1
            doc = clean_doc(text[comments[first][0] : comments[k][1]])
        out.append({"name": name, "signature": sig, "doc": doc, "start": start, "end": min(end, len(text))})
    return out


def clean_doc(comment: str) -> str:
    """The text of a comment without its marks, tags and tag lines."""
    lines = []
    for line in comment.split("\n"):
        line = re.sub(r"^\s*(?:/\*+!?|///?|\*+/?)|\*+/\s*$", "", line.rstrip())
        lines.append(re.sub(r"\*/\s*$", "", line).strip())
    kept = [x for x in lines if not re.match(r"@(?:param|returns?|throws|type|typeparam|template|see|since|author)\b", x)]
    text = "\n".join(kept)
    text = re.sub(r"<(param|typeparam|returns|exception)\b[\s\S]*?(?:</\1>|/>)", "", text)
    return re.sub(r"</?[A-Za-z][^<>]*>", "", text).strip()
