"""A reader for the part of Turtle that SHACL shapes use: prefixes, 'a', ';' and ',' lists, blank nodes, collections, literals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'#[^\n]*|"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|<[^>]*>|\^\^|@[A-Za-z-]+|[\[\]();,]|[^\s\[\]();,"<>]+|\s+')
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
Triple = tuple[str, str, str]


def tokens(text: str) -> list[str]:
    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t.isspace() or t[0] == "#":
            continue
        if len(t) > 1 and t[-1] == "." and t[0] not in '"<' and not t[:-1].endswith("."):
            out += [t[:-1], "."]
        else:
            out.append(t)
    return out


class _Reader:
    def __init__(self, text: str):
        self.all, self.at, self.prefixes, self.out, self.blank = tokens(text), 0, {}, [], 0

    def next(self) -> str:
        self.at += 1
        return self.all[self.at - 1]

    def peek(self) -> str:
        return self.all[self.at] if self.at < len(self.all) else ""

    def fresh(self) -> str:
        self.blank += 1
        return f"_:b{self.blank}"

    def term(self) -> str:
        t = self.next()
        if t == "[":
            node = self.fresh()
            self.properties(node, "]")
            self.next()
            return node
        if t == "(":
            items = []
            while self.peek() != ")":
                items.append(self.term())
            self.next()
            head = f"{RDF}nil"
            for x in reversed(items):
                node = self.fresh()
                self.out += [(node, f"{RDF}first", x), (node, f"{RDF}rest", head)]
                head = node
            return head
        if t[0] == '"':
            body = re.sub(r"\\(.)", r"\1", t[3:-3] if t.startswith('"""') else t[1:-1])
            if self.peek() == "^^":
                self.next()
                self.term()
            elif self.peek().startswith("@") and self.peek() not in ("@prefix", "@base"):
                self.next()
            return body
        if t[0] == "<":
            return t[1:-1]
        if t == "a":
            return f"{RDF}type"
        name, colon, local = t.partition(":")
        return self.prefixes.get(name, f"{name}:") + local if colon else t

    def properties(self, subject: str, end: str) -> None:
        while self.peek() not in (end, ""):
            p = self.term()
            while True:
                self.out.append((subject, p, self.term()))
                if self.peek() != ",":
                    break
                self.next()
            while self.peek() == ";":
                self.next()

    def read(self) -> list[Triple]:
        while self.peek():
            if self.peek().lower() in ("@prefix", "prefix"):
                dotted = self.next()[0] == "@"
                name = self.next().rstrip(":")
                self.prefixes[name] = self.next()[1:-1]
                if dotted:
                    self.next()
                continue
            self.properties(self.term(), ".")
            self.next()
        return self.out


def parse(text: str) -> list[Triple]:
    """Triples of full IRIs, blank nodes and plain literal values."""
    return _Reader(text).read()


def triples_in(documents: Column) -> Column:
    """The triples of Turtle documents, a document a row: array<struct<s, p, o>>. Blank nodes are named within their document; a null document has none. Documents are read in Python, batch by
    batch, so one has to fit a worker's memory, the table may be of any size."""

    @F.pandas_udf("array<struct<s:string,p:string,o:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"s": s, "p": p, "o": o} for s, p, o in parse(t)] if t is not None else [] for t in texts], dtype=object)

    return run(documents)
