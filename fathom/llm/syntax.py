"""Source files that do not parse (problem 5).

A file is lexed into one character per token. Bracketed groups are then replaced in one pass with a
stack: the content of a group is recognised by generalised LL against every role that its bracket can
have, and the group becomes a single token that stands for the roles it fits. What is left at the top
must be a whole file under one of the language's grammars; a file is flagged when all of them reject it.

Contents repeat a lot, within and across files, so results are kept by content in each worker. Long
lists of statements, members or items are first tried in pieces, cut where one may end: pieces that are
whole lists make a whole list. If any piece fails, the full content decides.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import tune, widen
from .gll import compiled, recognise
from .grammars import ROLES

#: Kept results of a worker are dropped when there are so many.
KEEP = 200_000
_GROUPS = {"(": 0xE000, "[": 0xE800, "{": 0xF000}
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_BRACKET = re.compile(r"[()\[\]{}]")
#: Rules that are lists with commas between their items; in JSON none may end with a comma.
_ITEMS = frozenset("Args Params Array ArrPat Obj ObjPat Named Tuple EnumBody InitList ListExpr Arms Anon Attrs Index Ranked ListPat PosPat".split())
_ENDS_WITH_COMMA = frozenset("EnumBody InitList ListExpr Arms Anon Attrs".split())
_ERROR = "\x00"
#: The opening quote of a literal whose holes need more than a token's expression; never left in a lexed text.
_OPEN = "\x01"

_RESERVED_JS = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
_WORDS_JS = "let static yield await async of get set as from type interface namespace module declare abstract readonly private protected public implements keyof infer is asserts satisfies unique override accessor global out assert using".split()
_RESERVED_CS = "abstract as base break case catch checked class const continue default delegate do else enum event explicit extern false finally fixed for foreach goto if implicit in interface internal is lock namespace new null operator out override params private protected public readonly ref return sealed sizeof stackalloc static struct switch this throw true try typeof unchecked unsafe using virtual volatile while".split()
_WORDS_CS = "var dynamic record get set init add remove where when with and or not async await partial file required scoped global alias from select group by into join let on equals orderby ascending descending notnull unmanaged allows".split()
_PREDEF_CS = "bool byte sbyte char decimal double float int uint long ulong short ushort object string void nint nuint".split()

# literals whose holes have no quotes, comments or braces; of any other only the opening is a token
_TEMPLATE = r"`(?:\\[\s\S]|\$\{[^{}`'\"/]*\}|\$(?!\{)|[^`\\$])*`"
_REGEX = r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*"
_NUMBER = r"(?:0[xXbBoO][0-9a-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[A-Za-z]*)"
_JS_TOKEN = "|".join([
    rf"(?:=>|&&|\|\||\?\?|[!=]==?|[=(,:\[!&|?{{;~^<>+\-*%]|\breturn|\btypeof|\bcase)\s*{_REGEX}",
    r"[^\W\d][\w$]*|\$[\w$]*", r"\n\s*", r"[(){}\[\];,:]", r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)",
    r"=>|===?|!==?|=|!", r"\.\.\.|\?\.(?!\d)|\.(?!\d)", r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'", _NUMBER, _TEMPLATE,
    r"\*\*=?|&&=?|\|\|=?|\?\?=?|\+\+|--|<<=?|[+\-*/%&|^]=?|<=?|>=?|\?", r"#[\w$]+", r"\S",
])
_STR_CS = r'"(?:[^"\\\n]|\\.)*"(?:u8)?'
_CS_TOKEN = "|".join([
    r"@?[^\W\d]\w*", r"[(){}\[\];,]", r"\n[ \t]*#[^\n]*", r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)", r"\.\.|\?\.(?!\d)|\.(?!\d)|->|::|:", r"=>|==|!=|=",
    r'"""(?!")[\s\S]*?"""(?!")|""""(?!")[\s\S]*?""""(?!")', r'\$+"{3,}',
    r'''(?:\$@|@\$)"(?:[^"{}]|""|\{\{|\}\}|\{[^{}"'/@$]*\})*"(?!")''', r'''\$"(?:[^"\\{}\n]|\\.|\{\{|\}\}|\{[^{}"'\n/@$]*\})*"''', r'\$@?"|@\$"', r'@"(?:[^"]|"")*"', _STR_CS,
    r"'(?:[^'\\\n]|\\[^'\n]+|\\')'", _NUMBER.replace(r"\d[\d_]*\.?[\d_]*", r"\d[\d_]*(?:\.\d[\d_]*)?"), r"\+\+|--|\?\?=?|&&|\|\||<<=?|[+\-*/%&|^]=?|<=?|>=?|[!~?]", r"\S",
])
_JSON_TOKEN = r'[{}\[\]:,]|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|(?:true|false|null)(?!\w)|[^ \t\r\n]'


class Alphabet:
    """Characters for tokens and the terminals that each can be."""

    def __init__(self):
        self.classes: dict[str, frozenset] = {_ERROR: frozenset(), _OPEN: frozenset()}
        self.chars: dict[frozenset, str] = {}
        self._next = 0x100

    def add(self, *terminals: str) -> str:
        key = frozenset(terminals)
        if key not in self.chars:
            c = chr(self._next)
            self._next += 1
            self.chars[key], self.classes[c] = c, key
        return self.chars[key]


class Kinds(dict):
    """Token text -> characters; unknown texts are classified once."""

    def __init__(self, classify):
        self.classify = classify

    def __missing__(self, token):
        if len(self) > KEEP:
            self.clear()
        got = self.classify(token)
        if len(token) < 400:
            self[token] = got
        return got


class Dialect:
    """One grammar with its lexer, ready to check texts."""

    def __init__(self, name: str, token: str, reserved, words, newlines: bool):
        text, self.starts, self.roles = ROLES[name]
        self.name, self.grammar, self.newlines = name, compiled(text), newlines
        self.alpha = a = Alphabet()
        self.scan = re.compile(token)
        self.find = self.scan.findall
        self.holes: dict[str, bool] = {}
        self.special = {w: a.add(w, "NAME") for w in reserved} | {w: a.add(w, "NAME", "ID") for w in words}
        self.punct: dict[str, str] = {}
        self.kinds = Kinds(self._classify)
        self.known: dict[tuple[str, str], bool] = {}
        self.group: dict[str, dict[str, str]] = {b: {} for b in _CLOSE}
        self.by_roles: dict[tuple[str, frozenset], str] = {}
        self._setup()

    # -- lexing

    def _setup(self):
        a = self.alpha
        self.ID, self.NUM, self.STR = a.add("ID", "NAME"), a.add("NUM"), a.add("STR")
        self.TEMPLATE, self.REGEX, self.PRIVATE, self.N = a.add("TEMPLATE"), a.add("REGEX"), a.add("PRIVATE"), a.add("N")
        single = [".", "...", "?.", "=", "=>", "?", "!", "~", "+", "-", "*", "<", ">", "|", "&", "@", "^", "->", "::", ".."]
        self.punct = {p: a.add(p) for p in single} | {p: a.add(p) for p in ";,:"} | {b: b for b in "()[]{}"}
        self.punct[">="] = a.add("OP", "GE")  # also the end of >>=
        for op in "** && || ?? == != === !== <= << / %".split():
            self.punct[op] = a.add("OP")
        for op in "+= -= *= /= %= **= &= |= ^= <<= &&= ||= ??=".split():
            self.punct[op] = a.add("ASSIGN")
        # >>= and >= may also close type arguments; >= is an operator only
        self.punct["^"], self.punct["&"], self.punct["|"] = a.add("^", "OP"), a.add("&", "OP"), a.add("|", "OP")
        self.punct["++"] = self.punct["--"] = a.add("INC")
        comma = self.punct[","]
        self.repeats = re.compile(f"([^{comma}]{{1,8}}{comma})\\1\\1+")
        # chains of the same accesses, calls or operators; no type argument, condition or keyword is in them
        links = "".join(re.escape(self.punct[x]) for x in (".", "+", "-", "*", "&", "|", "&&", "==", "/"))
        groups = re.escape(self.TEMPLATE) + "\ue000-\uf7ff"
        parts = "".join(map(re.escape, (self.ID, self.NUM, self.STR))) + groups
        self.chains = re.compile(f"([{groups}]|[{parts}]{{0,4}}[{links}][{parts}]{{0,4}}?)\\1\\1+")
        self.links = re.compile("[" + "".join(re.escape(self.punct[x]) for x in ("+", "-", "*", "&", "|", "&&", "==", "/")) + "]")
        self._cuts()

    def _cuts(self):
        """Where a list of statements or members may be cut, and line breaks that end nothing."""
        p, s = self.punct, self.special
        no = "".join(re.escape(p[x]) for x in [".", "?.", "=", "?", ",", ";", ":", "=>"] if x in p) + "".join(re.escape(s[w]) for w in ("else", "catch", "finally", "while", "as", "satisfies", "is", "when", "with", "switch", "in", "instanceof") if w in s)
        braces = "\uf000-\uf7ff"
        lead = f"{self.N}?" if self.newlines else ""
        if self.newlines:
            self.cut = re.compile(f"(?:(?<={re.escape(p[';'])}){lead}|(?<=[{braces}]){self.N})(?=[^{no}{self.N}])")
        else:
            self.cut = re.compile(f"(?<=[{re.escape(p[';'])}{braces}])(?=[^{no}])")
        if not self.newlines:
            return
        before = [x for x in p.values() if x not in (")", "]", "}", p["!"], p["++"], p[">"])] + [c for w, c in s.items() if w in _RESERVED_JS and w not in ("return", "break", "continue", "throw", "this", "super", "null", "true", "false", "default")]
        after = [p[x] for x in (".", "?.", ",", ";", ":", "=", "=>", "?", "+", "-", "*", "<", ">", "|", "&", "^", "&&", "+=")] + ["(", "[", ")", "]", "}", "{", self.TEMPLATE] + [s[w] for w in ("instanceof", "in", "catch", "finally") if w in s]
        esc = lambda xs: "".join(re.escape(x) for x in sorted(set(xs)))
        self.idle = re.compile(f"(?<=[{esc(before)}]){self.N}+|^{self.N}+|{self.N}+(?=[{esc(after)}]|$)|{self.N}(?={self.N})")

    def _classify(self, t: str) -> str:
        got = self.special.get(t) or self.punct.get(t)
        if got is not None:
            return got
        c = t[0]
        if self.name == "csharp":
            return self._classify_cs(t, c)
        if self.name == "json":
            return self.STR if c == '"' and len(t) > 1 else self.NUM if t[-1].isdigit() and (c == "-" or c.isdigit()) else _ERROR
        if t[-1:] and "/" in t and c not in "/'\"`#\n" and not c.isspace() and re.search(r"/[A-Za-z]*$", t) and len(t) > 2:
            head = re.match(r"=>|&&|\|\||\?\?|[!=]==?|[=(,:\[!&|?{;~^<>+\-*%]|return|typeof|case", t)
            return self.kinds[head.group()] + self.REGEX
        if c == "\n":
            return self.N
        if c == "/":
            return (self.N if "\n" in t else "") if t[:2] == "//" or self._closed(t) else _ERROR
        if c in "\"'":
            return self.STR if len(t) > 1 and t[-1] == c else _ERROR
        if c == "`":
            return self._template(t, 0)[0] if len(t) > 1 else _OPEN
        if c.isdigit() or (c == "." and len(t) > 1):
            return self.NUM if self._number(t) and not (self.name == "module" and re.match(r"0[0-9_]", t)) else _ERROR
        if c == "#":
            return self.PRIVATE if len(t) > 1 else _ERROR
        if c == "_" or c == "$" or c.isalpha():
            return self.ID
        return _ERROR

    @staticmethod
    def _closed(t: str) -> bool:
        return t[:2] == "/*" and len(t) >= 4 and t.endswith("*/")

    @staticmethod
    def _number(t: str) -> bool:
        """A number of any script dialect; the strict one has no octals that begin with 0."""
        return bool(re.fullmatch(r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|\d[\d_]*n|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?", t))

    # -- literals with expressions in them

    _TEMPLATE_TEXT = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$]+)*")
    _STRING_TEXT = re.compile(r'(?:[^"\\{}\n]+|\\.|\{\{|\}\})*')
    _VERBATIM_TEXT = re.compile(r'(?:[^"{}]+|""|\{\{|\}\})*')
    _RUN = re.compile(r'"+|\{+|\}+')

    def _literal(self, text: str, at: int) -> tuple[str, int]:
        """The character of a literal that starts at ``at``, and its end; that of the text where it has none."""
        return self._interpolated(text, at) if self.name == "csharp" else self._template(text, at)

    def _template(self, text: str, at: int) -> tuple[str, int]:
        ok, at = True, at + 1
        while True:
            at = self._TEMPLATE_TEXT.match(text, at).end()
            if text[at : at + 1] == "`":
                return self.TEMPLATE if ok else _ERROR, at + 1
            end, _ = self._hole_end(text, at + 1) if text[at : at + 2] == "${" else (None, None)
            if end is None:
                return _ERROR, len(text)
            ok = self._fits_hole(text[at + 1 : end]) and ok
            at = end

    def _interpolated(self, text: str, at: int) -> tuple[str, int]:
        head = re.compile(r'[$@]+"').match(text, at).group()
        raw = re.compile(r'(\$+)("{3,})').match(text, at)
        if raw:
            return self._raw(text, raw.end(), len(raw.group(1)), len(raw.group(2)))
        ok, at, verbatim = True, at + len(head), "@" in head
        while True:
            at = (self._VERBATIM_TEXT if verbatim else self._STRING_TEXT).match(text, at).end()
            if text[at : at + 1] == '"':
                return self.STR if ok else _ERROR, at + 1
            end, code = self._hole_end(text, at, '"' if verbatim else '"\n') if text[at : at + 1] == "{" else (None, None)
            if end is None:
                return _ERROR, len(text)
            ok = self._fits_hole(text[at + 1 : code]) and ok
            at = end

    def _raw(self, text: str, at: int, braces: int, quotes: int) -> tuple[str, int]:
        """A raw string: as many braces as it has dollar signs open a hole, fewer are text."""
        ok = True
        while m := self._RUN.search(text, at):
            c, n, at = m.group()[0], len(m.group()), m.end()
            if c == '"' and n >= quotes:
                return self.STR if ok and n == quotes else _ERROR, at
            if c == '"' or n < braces:
                continue
            end, code = self._hole_end(text, at - 1) if c == "{" and n < 2 * braces else (None, None)
            if end is None or text[end : end + braces - 1] != "}" * (braces - 1):
                break
            ok = self._fits_hole(text[at:code]) and ok
            at = end + braces - 1
        return _ERROR, len(text)

    def _hole_end(self, text: str, at: int, never: str = "") -> tuple[int | None, int | None]:
        """Behind the brace that matches the one at ``at``, and where the code ends: there or at a C# format.

        A format has none of the characters ``never``. None where the hole has no end.
        """
        braces = others = 0
        while m := self.scan.search(text, at):
            t, at = m.group(), m.end()
            if self.kinds[t] == _OPEN:
                at = self._literal(text, m.start())[1]
            elif t[0] == "{":
                braces += 1
            elif t == "}":
                braces -= 1
                if not braces:
                    return at, at - 1
            elif t[0] in "([":
                others += 1
            elif t in (")", "]"):
                others -= 1
            elif t == ":" and self.name == "csharp" and braces == 1 and others <= 0:
                end = text.find("}", at)
                given = text[at:end].replace('""', "") if "\n" not in never else text[at:end]
                return (None, None) if end <= at or "{" in given or any(c in given for c in never) else (end + 1, m.start())
        return None, None

    def _fits_hole(self, code: str) -> bool:
        """Whether a hole (of a template with its braces, of a C# string without its format) is an expression."""
        got = self.holes.get(code)
        if got is None:
            if self.name == "csharp":
                s = self._collapse(self.lex(code))
            else:
                s = self.lex(code)  # with its braces, as a regular expression may follow the first
                s = self._collapse(s[1:-1]).replace(self.N, "") if s[:1] == "{" and s[-1:] == "}" else _ERROR
            got = _ERROR not in s
            if got and not self.fits("Expr", s):
                # an alignment may follow the value
                value, comma, width = s.rpartition(self.punct[","])
                got = self.name == "csharp" and bool(comma) and self.fits("Expr", value) and self.fits("Expr", width)
            if len(self.holes) > KEEP:
                self.holes.clear()
            self.holes[code] = got
        return got

    def _classify_cs(self, t: str, c: str) -> str:
        if c == "\n":
            return ""
        if c == "/" and t[:2] in ("//", "/*"):
            return "" if t[1] == "/" or self._closed(t) else _ERROR
        if c == "'":
            return self.STR if len(t) > 2 else _ERROR
        if c == "$" or t[:2] == "@$":
            if t in ('$"', '$@"', '@$"') or t[-3:] == '"""' and not t.strip('$"'):
                return _OPEN
            return self._interpolated(t, 0)[0] if len(t) > 1 else _ERROR
        if t[-1] == '"' or t.endswith('"u8'):
            return self.STR if len(t.lstrip("$@")) > 1 else _ERROR
        if c.isdigit() or (c == "." and len(t) > 1):
            return self.NUM if re.fullmatch(r"0[xX][0-9a-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?(?:[fFdDmM]|[uUlL]{1,2})?", t) else _ERROR
        if c in "_@" and len(t) > 1 or c == "_" or c.isalpha():
            return self.ID
        return _ERROR

    def lex(self, text: str) -> str:
        kinds = self.kinds
        s = "".join([kinds[t] for t in self.find(text)])
        return self._lex_literals(text) if _OPEN in s else s

    def _lex_literals(self, text: str) -> str:
        out: list[str] = []
        at, kinds = 0, self.kinds
        while at is not None:
            start, at = at, None
            for m in self.scan.finditer(text, start):
                c = kinds[m.group()]
                if c == _OPEN:
                    c, at = self._literal(text, m.start())
                    out.append(c)
                    break
                out.append(c)
        return "".join(out)

    # -- parsing

    def fits(self, symbol: str, content: str) -> bool:
        """Whether ``symbol`` derives a content without brackets."""
        key = (symbol, content)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > KEEP:
                self.known.clear()
            got = False
            if _ERROR not in content:
                if len(content) > 16 and symbol in ("List", "ClassBody", "TypeBody", "SpaceBody"):
                    parts = self.cut.split(content)
                    got = len(parts) > 1 and all(self.fits(symbol, x) for x in parts)
                    if not got and len(parts) == 1 and symbol == "List" and len(content) > 64:
                        got = self._long_statement(content)
                elif len(content) > 64 and symbol == "Expr":
                    if self.punct[","] in (content[0], content[-1]):
                        self.known[key] = False
                        return False
                    got = self._long_expression(content)
                elif len(content) > 64 and symbol in _ITEMS:
                    got = self._each_item(symbol, content)
                    if not got and self.name == "json":
                        self.known[key] = False  # a comma is nothing else there
                        return False
                if not got:
                    got = recognise(self.grammar, [symbol], [self.alpha.classes[c] for c in self._short(content)])
            self.known[key] = got
        return got

    def _short(self, content: str) -> str:
        """The content with long repetitions shortened.

        In every list of these grammars two equal items in a row stand for any number.
        """
        while len(content) > 64:
            short = self.chains.sub(r"\1\1", self.repeats.sub(r"\1\1", content))
            if len(short) == len(content):
                break
            content = short
        return content

    def _each_item(self, symbol: str, content: str) -> bool:
        """Whether all that stands between the commas of a content is an item of the list by itself."""
        items = content.split(self.punct[","])
        if len(items) > 1 and not items[-1] and (symbol in _ENDS_WITH_COMMA if self.name == "csharp" else self.name != "json"):
            items.pop()
        return len(items) > 1 and all(items) and all(self.fits(symbol, x) for x in set(items))

    def _long_statement(self, content: str) -> bool:
        """Whether a content is one declaration whose items are declarations by themselves, or one expression."""
        body = content.rstrip(self.N) if self.newlines else content
        body = body.removesuffix(self.punct[";"])
        if self.newlines and body[:1] in [self.special[w] for w in ("var", "let", "const")]:
            items = body[1:].split(self.punct[","])
            return len(items) > 1 and all(items) and all(self.fits("List", body[0] + x) for x in set(items))
        return body != content and self.fits("Expr", body)

    def _long_expression(self, content: str) -> bool:
        """Whether an expression is made of smaller ones at its commas, its first assignment or its plain operators."""
        if self.newlines and self.punct[","] in content:
            return all(x and self.fits("Expr", x) for x in set(content.split(self.punct[","])))
        left, equals, right = content.partition(self.punct["="])
        if equals:
            return self.fits("Operand", left) and self.fits("Expr", right)
        parts = self.links.split(content)
        return len(parts) > 1 and all(x and self.fits("Operand", x) for x in set(parts))

    def _role(self, bracket: str, content: str) -> str:
        """The character that stands for a group."""
        known = self.group[bracket]
        got = known.get(content)
        if got is None:
            inner = content.replace(self.N, "") if self.newlines and bracket != "{" else content
            roles = frozenset(role for role, symbol in self.roles[bracket].items() if self.fits(symbol, inner))
            if not roles:
                got = _ERROR
            else:
                key = bracket, roles
                if key not in self.by_roles:
                    c = chr(_GROUPS[bracket] + sum(b == bracket for b, _ in self.by_roles))
                    self.by_roles[key], self.alpha.classes[c] = c, roles
                got = self.by_roles[key]
            if len(known) > KEEP:
                known.clear()
            known[content] = got
        return got

    def _collapse(self, s: str) -> str:
        """The tokens of a text with every group as one character; an error where a group is none or brackets don't match."""
        if _ERROR in s:
            return _ERROR
        if self.newlines and self.N in s:
            s = self.idle.sub("", self.idle.sub("", s))
        out: list[str] = []
        above: list[tuple[list[str], str]] = []
        at = 0
        for m in _BRACKET.finditer(s):
            i = m.start()
            c = s[i]
            if at < i:
                out.append(s[at:i])
            at = i + 1
            if c in _CLOSE:
                above.append((out, c))
                out = []
                continue
            if not above or _CLOSE[above[-1][1]] != c:
                return _ERROR
            inner = "".join(out)
            out, bracket = above.pop()
            role = self._role(bracket, inner)
            if role == _ERROR:
                return _ERROR
            out.append(role)
        out.append(s[at:])
        return _ERROR if above else "".join(out)

    def valid(self, text: str) -> bool:
        if text[:1] == "\ufeff":
            text = text[1:]
        if self.newlines and text[:2] == "#!":
            text = text[text.find("\n") :] if "\n" in text else ""
        if self.name == "csharp" and text[:1] == "#":
            text = "\n" + text
        s = self._collapse(self.lex(text))
        if _ERROR in s:
            return False
        return any(self._whole(start, s) for start in self.starts)

    def _whole(self, start: str, s: str) -> bool:
        if start != "Unit" or len(s) < 16:
            return self.fits(start, s)
        # a C# file: usings and the namespace first, then members in pieces
        parts = self.cut.split(s)
        for k in range(min(len(parts), 40), 0, -1):
            if self.special["using"] in parts[k - 1][:2] or self.special["namespace"] == parts[k - 1][0]:
                if self.fits("Unit", "".join(parts[:k])) and all(self.fits("SpaceBody", x) for x in parts[k:]):
                    return True
                break
        return self.fits("Unit", s)


class Tsx(Dialect):
    """TypeScript with JSX: tags and the text between them are lexed by a stack of modes."""

    _TAG = re.compile(r"\s+|//[^\n]*|/\*[\s\S]*?\*/|[^\W\d][\w$]*|\$[\w$]*|\"[^\"]*\"|'[^']*'|/|>|.")
    _TEXT = re.compile(r"[^<{]+")
    #: Type arguments of an element's name.
    _GIVEN = re.compile(r"<[^<>(){};]*(?:<[^<>(){};]*>[^<>(){};]*)*>")

    def _setup(self):
        super()._setup()
        a = self.alpha
        self.open, self.close, self.selfclose, self.end, self.text = a.add("JOPEN"), a.add("JCLOSE"), a.add("JSELF"), a.add("JEND"), a.add("JTEXT")
        self.match = re.compile(_JS_TOKEN).match
        self.start = re.compile(r"<(?=[A-Za-z_$>])(?!\w+\s*(?:,|extends\b|=))")
        p = self.punct
        self.operand_follows = set(p[x] for x in ("=", "=>", "?", ":", ",", "&&", "|", "&", "!", ";")) | set("([{}") | {self.special[w] for w in ("return", "default", "case", "yield", "await")} | {self.N}

    def lex(self, text: str) -> str:
        if "<" not in text:
            return super().lex(text)
        return self._walk(text, 0, False)[0]

    def _hole_end(self, text, at, never=""):
        end = self._walk(text, at, True)[1]
        return end, end and end - 1

    def _walk(self, text: str, at: int, hole: bool) -> tuple[str, int | None]:
        """The characters from ``at`` on and their end: of the text, or of the hole whose brace is there (None if open)."""
        out: list[str] = []
        n, kinds = len(text), self.kinds
        #: modes: a number is the depth of braces of script code, "tag" and "text" belong to the innermost element
        modes: list = [0]
        tags: list[str] = []
        match = self.match
        if hole:
            m = match(text, at)
            out.append(kinds[m.group()])
            at = m.end()
            modes.append(1)
        while at < n and not (hole and len(modes) == 1):
            mode = modes[-1]
            if mode == "text":
                m = self._TEXT.match(text, at)
                if m:
                    out.append(self.text)
                    if ">" in m.group() or "}" in m.group():
                        out.append(_ERROR)
                    at = m.end()
                elif text[at] == "{":
                    out.append("{")
                    modes.append(1)
                    at += 1
                else:
                    m = re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, at)
                    if m:
                        if not tags or tags.pop() != m.group(1):
                            out.append(_ERROR)
                        out.append(self.close + "".join(self._name(m.group(1))) + self.end)
                        modes.pop()
                        at = m.end()
                    else:
                        at = self._open(text, at, out, modes, tags)
                continue
            if mode == "tag":
                m = self._TAG.match(text, at)
                t = m.group()
                at = m.end()
                if t == ">":
                    out.append(self.end)
                    modes[-1] = "text"
                elif t == "/":
                    if text[at : at + 1] == ">":
                        out.append(self.selfclose)
                        at += 1
                        tags.pop()
                        modes.pop()
                    else:
                        out.append(_ERROR)
                elif t == "{":
                    out.append("{")
                    modes.append(1)
                elif t[0] in "\"'":
                    out.append(self.STR if len(t) > 1 else _ERROR)
                elif not t.isspace() and t[:2] not in ("//", "/*"):
                    out.append(_ERROR if kinds[t] == _OPEN else kinds[t])
                continue
            m = match(text, at)
            if m is None:
                at += 1
                continue
            t = m.group()
            if t[0] == "<" and self.start.match(text, at):
                last = next((x for x in reversed(out) if x and x != self.N), ";")[-1:]
                if last in self.operand_follows or not out:
                    at = self._open(text, at, out, modes, tags)
                    continue
            at = m.end()
            if kinds[t] == _OPEN:
                c, at = self._literal(text, m.start())
                out.append(c)
                continue
            if t[0] == "{" and mode:
                modes[-1] += 1
            elif t == "}" and mode:
                modes[-1] -= 1
                if modes[-1] == 0:
                    modes.pop()
            out.append(kinds[t])
        if len(modes) > 1:
            out.append(_ERROR)
            at = None
        return "".join(out), at

    def _name(self, name: str):
        for part in re.findall(r"[\w$]+|[.:-]", name):
            yield self.kinds[part] if part in ".:-" else (self.special.get(part) or self.ID)

    def _open(self, text, at, out, modes, tags) -> int:
        m = re.compile(r"<\s*([\w$.:-]*)").match(text, at)
        out.append(self.open + "".join(self._name(m.group(1))))
        tags.append(m.group(1))
        modes.append("tag")
        given = self._GIVEN.match(text, m.end())
        return given.end() if given and m.group(1) else m.end()


_dialects: dict[str, list[Dialect]] = {}
_LANGUAGE = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "cs": "csharp", "json": "json"}


def dialects(language: str) -> list[Dialect]:
    """The grammars a language is tried with, built once per worker."""
    if language not in _dialects:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))  # literals in literals
        if language == "tsx":
            own = [Tsx("tsx", _JS_TOKEN, _RESERVED_JS, _WORDS_JS, True)]
        elif language == "csharp":
            own = [Dialect("csharp", _CS_TOKEN, _RESERVED_CS, _WORDS_CS, False)]
            for w in _PREDEF_CS:
                own[0].special[w] = own[0].alpha.add("PREDEF", "NAME")
        elif language == "json":
            own = [Dialect("json", _JSON_TOKEN, ["true", "false", "null"], [], False)]
        else:
            own = [Dialect(name, _JS_TOKEN, _RESERVED_JS, _WORDS_JS, True) for name in (("module", "classic") if language == "javascript" else (language,))]
        _dialects[language] = own
    return _dialects[language]


_CONDITION = re.compile(r"(?m)^[ \t]*#[ \t]*(if|elif|else|endif)\b[^\n]*")


def branches(text: str, last: bool) -> str:
    """A C# text with the first (or the last) branch of every condition of the preprocessor, and blanks for the others.

    What is nested in a branch that is left out goes with it.
    """
    out, at, taken = [], 0, []  # per open condition whether its present branch is kept
    spans = [(m.start(), m.end(), m.group(1)) for m in _CONDITION.finditer(text)]
    after, ends = [], {}  # directive -> whether another branch of its condition follows
    for i, (_, _, kind) in enumerate(spans):
        if kind in ("elif", "else", "endif") and after:
            ends[after.pop()] = kind == "endif"
        if kind != "endif":
            after.append(i)
    for i, (s, e, kind) in enumerate(spans):
        out.append(text[at:s] if all(taken) else "\n")
        at = e
        if kind == "if":
            taken.append(ends.get(i, True) if last else True)
        elif taken:
            taken.pop()
            if kind != "endif":
                taken.append(ends.get(i, True) if last else False)
    out.append(text[at:] if all(taken) else "\n")
    return "".join(out)


def is_valid(text: str, language: str) -> bool:
    """Whether any dialect of the language accepts the whole text: for JavaScript modules and classic scripts, for C#
    the text with all branches of its conditions, with the first ones or with the last ones."""
    own = dialects(language)
    if any(d.valid(text) for d in own):
        return True
    return language == "csharp" and bool(_CONDITION.search(text)) and any(own[0].valid(branches(text, last)) for last in (False, True))


def claimed_language(path: Column) -> Column:
    """The language that the ending of a path claims, null for endings without a grammar here."""
    ext = F.lower(F.regexp_extract(F.trim(path), r"\.(tsx?|js|cs|json)$", 1))
    out = F.lit(None).cast("string")
    for e, language in _LANGUAGE.items():
        out = F.when(ext == e, language).otherwise(out)
    return out


def check_syntax(docs: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, source, language, valid) of every document whose path claims one of the languages.

    Null, empty and blank texts have nothing to parse: their ``valid`` is null. Repeated paths are
    checked each by itself. No shuffle.
    """
    tune(docs.sparkSession)
    source = F.col("source") if "source" in docs.columns else F.lit(None)
    rows = docs.select(F.col(path_col).cast("string").alias("path"), source.cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), claimed_language(F.col(path_col)).alias("language")).filter(F.col("language").isNotNull())

    def run(batches):
        for b in batches:
            path, source, text, language = b.columns
            ok = [is_valid(t, lang) if t and not t.isspace() else None for t, lang in zip(text.to_pylist(), language.to_pylist())]
            yield pa.RecordBatch.from_arrays([path, source, language, pa.array(ok, pa.bool_())], names=["path", "source", "language", "valid"])

    return widen(rows).mapInArrow(run, "path string, source string, language string, valid boolean")


def failure_rates(checked: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per repository and language: files with text, files that don't parse, and their rate.

    ``files`` is (path, language), a row a path: where it names a language for a path, the file counts
    there; else under the language of its ending.
    """
    c = checked.filter(F.col("valid").isNotNull())
    if files is not None:
        said = files.select("path", F.nullif(F.lower(F.trim("language")), F.lit("")).alias("said"))
        c = c.join(said, "path", "left").withColumn("language", F.coalesce("said", "language"))
    return c.groupBy("source", "language").agg(F.count("*").alias("files"), F.sum((~F.col("valid")).cast("long")).alias("invalid")).withColumn("rate", F.col("invalid") / F.col("files"))
