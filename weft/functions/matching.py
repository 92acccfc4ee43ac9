"""Replacement of many strings in one pass: an automaton with failure links, leftmost matches first and of these the longest."""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Automaton:
    """Finds strings in a text. States are places in the tree of all strings; depth: how much of them a state has seen."""

    def __init__(self, strings: tuple[str, ...]):
        self.next, self.fail, self.depth, self.ends = [{}], [0], [0], [-1]
        for i, string in enumerate(strings):
            at = 0
            for c in string:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.depth.append(self.depth[at] + 1)
                    self.ends.append(-1)
                at = self.next[at][c]
            if at and self.ends[at] < 0:  # of equal strings the first counts; the empty one is none
                self.ends[at] = i
        #: The nearest state on the way of failure links that ends a string, itself included; 0 if there is none.
        self.found = [0] * len(self.next)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            self.found[at] = at if self.ends[at] >= 0 else self.found[self.fail[at]]
            for c, then in self.next[at].items():
                if at:
                    back = self.fail[at]
                    while back and c not in self.next[back]:
                        back = self.fail[back]
                    self.fail[then] = self.next[back].get(c, 0)
                todo.append(then)

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, string) of the matches, none over another."""
        out, at, i, best = [], 0, 0, None
        while True:
            if best and (i == len(text) or i - self.depth[at] > best[0]):  # nothing that begins as early can go on
                out.append(best)
                at, i, best = 0, best[1], None
            if i == len(text):
                return out
            while at and text[i] not in self.next[at]:
                at = self.fail[at]
            at, i = self.next[at].get(text[i], 0), i + 1
            if hit := self.found[at]:
                start = i - self.depth[hit]
                if best is None or start <= best[0]:
                    best = (start, i, self.ends[hit])


#: Rows of a batch that are Python strings at a time; the rest of it stays in Arrow.
_AT_ONCE = 64


@lru_cache(maxsize=_AT_ONCE)
def _automaton(strings: tuple[str, ...]) -> Automaton:
    return Automaton(strings)


def replaced(text: str, find: list[str], put: list[str]) -> str:
    """text with each match of a string of find replaced by what stands at its place in put; what is put is not looked at again."""
    out, at = [], 0
    for start, end, i in _automaton(tuple(find)).matches(text):
        out += [text[at:start], put[i]]
        at = end
    return "".join(out) + text[at:]


def replace_each(text: Column, pairs: Column) -> Column:
    """replaced() as a column. pairs: array<struct<find, put>>; nulls in it are left out, a null text stays null, null pairs change nothing."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, find: pa.Array, put: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), _AT_ONCE):
            rows = zip(*(c.slice(at, _AT_ONCE).to_pylist() for c in (texts, find, put)), strict=True)
            out.append(pa.array([t if t is None or f is None else replaced(t, f, p) for t, f, p in rows], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    whole = F.filter(pairs, lambda x: x["find"].isNotNull() & x["put"].isNotNull())
    return run(text, F.transform(whole, lambda x: x["find"]), F.transform(whole, lambda x: x["put"]))
