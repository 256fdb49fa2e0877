"""A generalised LL recogniser over a graph-structured stack.

Grammars are written in EBNF text; any context-free grammar works, left recursion and ambiguity
included. A stack node is a nonterminal and the position where it begins; it holds its return edges
and the positions where it has ended, so that a nonterminal is recognised once for each position, no
matter how many derivations run through it. All start symbols given are tried in one run.
"""

from __future__ import annotations

import re
from functools import lru_cache

_TOKEN = re.compile(r"'[^']*'|[A-Za-z_]\w*|[=|()?*+;]|\S")


class Grammar:
    """Rules ``Name = symbols | symbols ;`` with ( ) ? * +. 'quoted' and ALL-CAPITAL words are terminals."""

    def __init__(self, text: str):
        self.rules: dict[str, list[tuple]] = {}
        self._n = 0
        toks = _TOKEN.findall(re.sub(r"#[^\n]*", "", text))
        at = 0
        while at < len(toks):
            name = toks[at]
            if toks[at + 1] != "=":
                raise ValueError(f"'=' expected after {name}")
            alts, at = self._alternatives(toks, at + 2)
            self.rules.setdefault(name, []).extend(alts)
            at += 1  # the ;
        self.names = list(self.rules)
        number = {n: i for i, n in enumerate(self.names)}
        for alts in self.rules.values():
            for alt in alts:
                for s in alt:
                    if s not in number and not (s.isupper() or s.startswith("'")):
                        raise ValueError(f"no rule for {s}")
        #: alternatives as tuples: a terminal is a string, a nonterminal an int
        self.alts = [[tuple(number.get(s, s.strip("'")) for s in alt) for alt in self.rules[n]] for n in self.names]
        self.number = number
        self._first_sets()
        self._viable: dict = {}

    def _alternatives(self, toks, at):
        alts, seq = [], []
        while True:
            t = toks[at]
            if t in ("|", ";", ")"):
                alts.append(tuple(seq))
                seq = []
                if t != "|":
                    return alts, at
                at += 1
                continue
            if t == "(":
                inner, at = self._alternatives(toks, at + 1)
                sym = self._new(inner)
            else:
                sym = t
            at += 1
            while toks[at] in ("?", "*", "+"):
                if toks[at] == "?":
                    sym = self._new([(sym,), ()])
                else:
                    many = self._new([])
                    self.rules[many] += [(many, sym), ()]
                    sym = many if toks[at] == "*" else self._new([(sym, many)])
                at += 1
            seq.append(sym)

    def _new(self, alts):
        self._n += 1
        name = f"_x{self._n}"
        self.rules[name] = list(alts)
        return name

    def _first_sets(self):
        nullable, first = [False] * len(self.alts), [set() for _ in self.alts]
        changed = True
        while changed:
            changed = False
            for i, alts in enumerate(self.alts):
                for alt in alts:
                    f, null = self._first_of(alt, nullable, first)
                    if not f <= first[i] or (null and not nullable[i]):
                        first[i] |= f
                        nullable[i] |= null
                        changed = True
        self.first = [[self._first_of(alt, nullable, first) for alt in alts] for alts in self.alts]

    @staticmethod
    def _first_of(alt, nullable, first):
        out: set = set()
        for s in alt:
            if isinstance(s, str):
                out.add(s)
                return out, False
            out |= first[s]
            if not nullable[s]:
                return out, False
        return out, True

    def viable(self, nt: int, classes: frozenset) -> tuple:
        """Alternatives of a nonterminal that can go on with a token of these classes."""
        key = (nt, classes)
        got = self._viable.get(key)
        if got is None:
            got = self._viable[key] = tuple(alt for alt, (f, null) in zip(self.alts[nt], self.first[nt]) if null or not f.isdisjoint(classes))
        return got


_END: frozenset = frozenset()


def recognise(g: Grammar, starts: list[str], classes: list[frozenset]) -> bool:
    """Whether any start symbol derives the whole sequence; a token is the set of terminals it can be."""
    n = len(classes)
    nodes: dict[tuple[int, int], tuple[set, set]] = {}
    seen: set = set()
    todo: list = []

    def enter(nt, i):
        node = nodes[nt, i] = (set(), set())
        for alt in g.viable(nt, classes[i] if i < n else _END):
            todo.append((alt, 0, nt, i, i))
        return node

    roots = [g.number[s] for s in starts]
    for r in roots:
        if (r, 0) not in nodes:
            enter(r, 0)
    while todo:
        alt, dot, nt, begin, i = todo.pop()
        size = len(alt)
        while True:
            if dot == size:
                edges, ends = nodes[nt, begin]
                if i not in ends:
                    ends.add(i)
                    for a, d, u, b in edges:
                        key = (a, d, u, b, i)
                        if key not in seen:
                            seen.add(key)
                            todo.append(key)
                break
            s = alt[dot]
            if s.__class__ is str:
                if i < n and s in classes[i]:
                    i += 1
                    dot += 1
                    continue
                break
            node = nodes.get((s, i)) or enter(s, i)
            edge = (alt, dot + 1, nt, begin)
            if edge not in node[0]:
                node[0].add(edge)
                for k in node[1]:
                    key = (alt, dot + 1, nt, begin, k)
                    if key not in seen:
                        seen.add(key)
                        todo.append(key)
            break
    return any(n in nodes[r, 0][1] for r in roots)


@lru_cache(maxsize=8)
def compiled(text: str) -> Grammar:
    return Grammar(text)
