"""Grammar files (EBNF) compiled to minimal automata. A grammar is small metadata on the driver; the table runs inside column expressions.

Notation: `name ::= expression`, with "text" and 'text', [classes] of characters, ranges and #xHHHH (after ^: all others), grouping, |, ?, *, +, and comments (a line that begins with #, or /* */).
Only symbols that don't contain themselves are read, so the language is regular; others raise ValueError.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LAST = 0x10FFFF
_TOKEN = re.compile(r"""\s*(?:(?P<define>[A-Za-z_][\w.-]*)\s*::=|(?P<name>[A-Za-z_][\w.-]*)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<set>\[(?:[^\]\\]|\\.)*\])|(?P<code>\#x[0-9A-Fa-f]+)|(?P<mark>[()|?*+]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
#: A set of characters: sorted ranges of code points.
Ranges = tuple[tuple[int, int], ...]


#: The line form that weft.functions.codecs writes: spaces may stand between tokens, names end at a space, comma, semicolon, full stop or quote.
LIGHT_TEXT = r"""
root   ::= line+
line   ::= gap* name gap+ kind (gap* ";" fact?)* gap* "."
kind   ::= "a" gap* name
fact   ::= gap* name gap* value (gap* "," gap* value)*
value  ::= name | '"' [^"]* '"'
name   ::= ":" [^ \t\n;,."]+
gap    ::= [ \t\n]
"""
#: The compact form that extractors write, as its grammar states it. Names hold the letters that Turtle allows, percent codes and escapes.
COMPACT_TEXT = r"""
root       ::= sentence+
sentence   ::= gap? name gap? facts gap? "."
facts      ::= property values (gap? ";" gap? (property gap? values)?)*
values     ::= value (gap? "," gap? value)*
property   ::= name | "a"
value      ::= name | gap? '"' [ \t!#-\[\]-~]* '"' gap?
name       ::= ":" local+
local      ::= (start | ":" | [0-9] | code) ((inner | "." | ":" | code)* (inner | ":" | code))?
start      ::= letter | "_"
inner      ::= start | "-" | [0-9] | #x00B7 | [#x0300-#x036F] | [#x203F-#x2040]
letter     ::= [A-Z] | [a-z] | [#x00C0-#x00D6] | [#x00D8-#x00F6] | [#x00F8-#x02FF] | [#x0370-#x037D] | [#x037F-#x1FFF] | [#x200C-#x200D] | [#x2070-#x218F] | [#x2C00-#x2FEF] | [#x3001-#xD7FF] | [#xF900-#xFDCF] | [#xFDF0-#xFFFD] | [#x10000-#xEFFFF]
code       ::= "%" hex hex | "\\" [_~.\-!$&'()*+,;=/?#@%]
hex        ::= [0-9] | [A-F] | [a-f]
gap        ::= [ \t\n]
"""


def _tokens(text: str) -> list[tuple[str, str]]:
    text = re.sub(r"/\*.*?\*/", " ", text, flags=re.S)
    text = "\n".join(x for x in text.splitlines() if not re.match(r"\s*#(?!x[0-9A-Fa-f])", x)).strip()
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no grammar token at {text[at : at + 30]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _characters(body: str) -> list[str | int]:
    """The characters of a text or a class; an escaped one as its code point, so that it marks nothing."""
    out = []
    for m in re.finditer(r"#x([0-9A-Fa-f]+)|\\(.)|(.)", body, re.S):
        out.append(int(m[1], 16) if m[1] else ord(_ESCAPES.get(m[2], m[2])) if m[2] else m[3])
    return out


def _class(body: str) -> Ranges:
    chars = _characters(body)
    negative = chars[:1] == ["^"]
    chars, ranges, i = chars[negative:], [], 0
    code = lambda c: c if isinstance(c, int) else ord(c)
    while i < len(chars):
        if i + 2 < len(chars) and chars[i + 1] == "-":
            ranges.append((code(chars[i]), code(chars[i + 2])))
            i += 3
        else:
            ranges.append((code(chars[i]),) * 2)
            i += 1
    if negative:
        inside, ranges, start = sorted(ranges), [], 0
        for lo, hi in inside:
            if start < lo:
                ranges.append((start, lo - 1))
            start = max(start, hi + 1)
        if start <= LAST:
            ranges.append((start, LAST))
    return tuple(ranges)


class _Builder:
    """A nondeterministic automaton: edges by state, over ranges, or empty."""

    def __init__(self, rules: dict[str, list]):
        self.rules, self.edges, self.empty, self.open = rules, [], [], []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, node: tuple, start: int) -> int:
        """The end state of node, begun at start."""
        kind, *rest = node
        if kind == "set":
            end = self.state()
            self.edges[start].append((rest[0], end))
            return end
        if kind == "all":
            for part in rest[0]:
                start = self.add(part, start)
            return start
        if kind == "any":
            end = self.state()
            for part in rest[0]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(part, begin)].append(end)
            return end
        if kind == "name":
            if rest[0] in self.open:
                raise ValueError(f"{rest[0]} contains itself: not a regular grammar")
            if rest[0] not in self.rules:
                raise ValueError(f"{rest[0]} is not defined")
            self.open.append(rest[0])
            end = self.add(self.rules[rest[0]], start)
            self.open.pop()
            return end
        begin, end = self.state(), self.state()
        self.empty[start].append(begin)
        last = self.add(rest[0], begin)
        self.empty[last].append(end)
        if kind in "?*":
            self.empty[begin].append(end)
        if kind in "*+":
            self.empty[last].append(begin)
        return end


def _rules(text: str) -> dict[str, tuple]:
    tokens, rules, at = _tokens(text), {}, 0

    def alternatives() -> tuple:
        nonlocal at
        parts = [sequence()]
        while at < len(tokens) and tokens[at] == ("mark", "|"):
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("any", parts)

    def sequence() -> tuple:
        nonlocal at
        parts = []
        while at < len(tokens) and tokens[at][0] != "define" and tokens[at] not in (("mark", "|"), ("mark", ")")):
            kind, value = tokens[at]
            at += 1
            if kind == "name":
                one = ("name", value)
            elif kind == "text":
                one = ("all", [("set", ((c if isinstance(c, int) else ord(c),) * 2,)) for c in _characters(value[1:-1])])
            elif kind == "set":
                one = ("set", _class(value[1:-1]))
            elif kind == "code":
                one = ("set", ((int(value[2:], 16),) * 2,))
            elif value == "(":
                one = alternatives()
                if at >= len(tokens) or tokens[at] != ("mark", ")"):
                    raise ValueError("a group is not closed")
                at += 1
            else:
                raise ValueError(f"{value} follows nothing")
            while at < len(tokens) and tokens[at][0] == "mark" and tokens[at][1] in "?*+":
                one = (tokens[at][1], one)
                at += 1
            parts.append(one)
        return ("all", parts)

    while at < len(tokens):
        if tokens[at][0] != "define":
            raise ValueError(f"{tokens[at][1]} stands outside a rule")
        name, at = tokens[at][1], at + 1
        rules[name] = alternatives()
    return rules


@dataclass(frozen=True)
class Grammar:
    """A minimal automaton. starts: where each class of characters begins; table: by state and class the next state, or -1; accepting: by state. State 0 is the first, and from
    every state some text leads to acceptance; so a text that meets no -1 is the beginning of a sentence."""

    starts: tuple[int, ...]
    table: tuple[tuple[int, ...], ...]
    accepting: tuple[bool, ...]

    @staticmethod
    def read(text: str, root: str = "root") -> Grammar:
        build = _Builder(_rules(text))
        first = build.state()
        final = build.add(("name", root), first)
        starts = sorted({0} | {x for edges in build.edges for ranges, _ in edges for lo, hi in ranges for x in (lo, hi + 1) if x <= LAST})

        def closed(states: set[int]) -> frozenset[int]:
            todo, seen = list(states), set(states)
            while todo:
                for x in build.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(seen)

        number, rows = {closed({first}): 0}, []
        for state in (queue := [closed({first})]):  # grows as states are met
            by = [set() for _ in starts]
            for s in state:
                for ranges, end in build.edges[s]:
                    for lo, hi in ranges:
                        for c in range(bisect_right(starts, lo) - 1, bisect_right(starts, hi)):
                            by[c].add(end)
            row = []
            for found in by:
                then = closed(found) if found else None
                if then is not None and then not in number:
                    number[then] = len(number)
                    queue.append(then)
                row.append(-1 if then is None else number[then])
            rows.append(row)
        return _minimal(starts, rows, [final in s for s in queue])

    def walk(self, text: str) -> tuple[bool, bool, int | None]:
        """Whether text is the beginning of a sentence, whether it is one, and after how many characters it fails."""
        state = 0
        for i, c in enumerate(text):
            state = self.table[state][bisect_right(self.starts, ord(c)) - 1]
            if state < 0:
                return False, False, i
        return True, self.accepting[state], None

    @cached_property
    def _arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.starts), np.array(self.table), np.array(self.accepting)

    def walks(self, texts: pd.Series) -> pd.DataFrame:
        """walk() of many texts (prefix, full, failed), a character of all of them at a time. A null text is none: false, false, 0."""
        starts, table, accepting = self._arrays
        given = texts.notna().to_numpy()
        own = [t if g else "" for t, g in zip(texts, given, strict=True)]
        lengths = np.array([len(t) for t in own], np.int64)
        kinds = np.searchsorted(starts, np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32), "right") - 1
        begin, state, failed = np.cumsum(lengths) - lengths, np.zeros(len(own), np.int64), np.full(len(own), -1, np.int64)
        alive, i = np.flatnonzero(lengths > 0), 0
        while len(alive):
            state[alive] = then = table[state[alive], kinds[begin[alive] + i]]
            failed[alive[then < 0]] = i
            i += 1
            alive = alive[(then >= 0) & (lengths[alive] > i)]
        failed[~given] = 0
        ok = failed < 0
        return pd.DataFrame({"prefix": ok, "full": ok & accepting[np.maximum(state, 0)], "failed": pd.Series(failed, dtype="Int32").mask(ok)})

    def run(self, text: Column) -> Column:
        """walk() as a column: struct<prefix: boolean, full: boolean, failed: int>. A null text is none: false, false, 0."""
        return F.pandas_udf(self.walks, "prefix boolean, full boolean, failed int")(text)


def _minimal(starts: list[int], rows: list[list[int]], accepting: list[bool]) -> Grammar:
    """Without states that lead nowhere, equal states as one, and equal classes of neighbouring characters as one."""
    alive, grew = {s for s, a in enumerate(accepting) if a}, True
    while grew:
        more = {s for s, row in enumerate(rows) if s not in alive and any(x in alive for x in row)}
        grew, alive = bool(more), alive | more
    if 0 not in alive:
        raise ValueError("the grammar has no sentence")
    rows = [[x if x in alive else -1 for x in row] for row in rows]
    block = {s: int(accepting[s]) for s in alive} | {-1: -1}
    while True:
        kinds: dict[tuple, int] = {}
        then = {s: kinds.setdefault((block[s], *(block[x] for x in rows[s])), len(kinds)) for s in sorted(alive)} | {-1: -1}
        if len(set(then.values())) == len(set(block.values())):
            break
        block = then
    order = sorted(set(then.values()) - {-1}, key=lambda b: (b != then[0], b))
    number = {b: i for i, b in enumerate(order)} | {-1: -1}
    head = {number[then[s]]: s for s in sorted(alive, reverse=True)}
    table = [[number[then[x]] for x in rows[head[i]]] for i in range(len(order))]
    keep = [c for c in range(len(starts)) if not c or any(row[c] != row[c - 1] for row in table)]
    return Grammar(tuple(starts[c] for c in keep), tuple(tuple(row[c] for c in keep) for row in table), tuple(accepting[head[i]] for i in range(len(order))))


LIGHT, COMPACT = Grammar.read(LIGHT_TEXT), Grammar.read(COMPACT_TEXT)
