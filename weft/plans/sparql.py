"""SPARQL text over quads as one DataFrame plan.

SELECT, ASK and CONSTRUCT, and the updates INSERT/DELETE ... WHERE and DROP GRAPH, with FROM, GRAPH, OPTIONAL, UNION, MINUS, FILTER,
[NOT] EXISTS, BIND, VALUES, sub-selects, paths (`|`, `/`, `^`, `*`, `+`), aggregates, HAVING, ORDER BY, LIMIT and OFFSET.

Each variable is a string column. Without FROM all graphs are read as one; equal triples of several graphs count once. Patterns on one
subject with fixed predicates become one scan and one grouping by subject instead of a join each. Names without a declared prefix stay as
they are written. RAND() is a hash of the row, so reruns agree. An unbound variable joins with nothing. Patterns that share no
variable would be a product: ValueError, as for any other text outside this subset.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import closure
from weft.sources.quads import TYPE

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<lang>@[A-Za-z-]+)
    |(?P<num>\d+(?:\.\d+)?)|(?P<name>(?:[A-Za-z_][\w-]*)?:(?:[\w%-]|\.(?=\w))*)|(?P<word>[A-Za-z_]\w*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}().;,*+/|^=<>!-])""",
    re.X,
)
_AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE")
_NUMERIC = ("YEAR", "STRLEN", "RAND")
Term = tuple


@dataclass
class Query:
    form: str
    distinct: bool = False
    columns: list[tuple[Term, str]] | None = None
    template: list[tuple[Term | None, Term, Term, Term]] = field(default_factory=list)
    graphs: list[str] = field(default_factory=list)
    where: list = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    having: Term | None = None
    order: list[tuple[Term, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class _Parser:
    def __init__(self, text: str, type_name: str):
        self.tokens, self.i, self.prefixes, self.type_name = [], 0, {}, type_name
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no SPARQL here: {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()

    def peek(self) -> str:
        kind, value = self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")
        return value.upper() if kind == "word" else value

    def kind(self) -> str:
        return self.tokens[self.i][0] if self.i < len(self.tokens) else "end"

    def take(self, *wanted: str) -> bool:
        if all(self.i + n < len(self.tokens) and self.tokens[self.i + n][1].upper() == w for n, w in enumerate(wanted)):
            self.i += len(wanted)
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise ValueError(f"{wanted} expected, {self.peek() or 'the end'} found")

    def next(self) -> str:
        value = self.tokens[self.i][1] if self.i < len(self.tokens) else ""
        self.i += 1
        return value

    def term(self) -> Term:
        kind, value = self.kind(), self.next()
        if kind == "var":
            return ("var", value[1:])
        if kind == "iri":
            return ("iri", value[1:-1])
        if kind == "name":
            prefix, _, local = value.partition(":")
            return ("iri", self.prefixes[prefix] + local if prefix in self.prefixes else value)
        if kind == "num":
            return ("num", float(value))
        if kind == "str":
            if self.kind() == "lang":
                self.i += 1
            elif self.take("^^"):
                self.term()
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[1:-1]))
        if value in ("a", "true", "false"):
            return ("iri", self.type_name) if value == "a" else ("bool", value == "true")
        raise ValueError(f"a term expected, {value or 'the end'} found")

    def var(self) -> str:
        kind, name = self.term()
        if kind != "var":
            raise ValueError(f"a variable expected, {name} found")
        return name

    def path(self) -> Term:
        if self.kind() == "var":
            return self.term()
        steps, joined = [self.step()], None
        while self.peek() in ("|", "/"):
            sign = self.next()
            if joined not in (None, sign):
                raise ValueError("paths that mix | and / are not supported")
            joined = sign
            steps.append(self.step())
        plain = len(steps) == 1 and steps[0][0::2] == (False, "")
        return ("iri", steps[0][1]) if plain else ("path", joined, steps)

    def step(self) -> tuple[bool, str, str]:
        inverse = self.take("^")
        name = self.term()[1]
        return inverse, name, self.next() if self.peek() in ("*", "+") else ""

    def triples(self) -> list[tuple[Term, Term, Term]]:
        found, subject = [], self.term()
        while True:
            path = self.path()
            found.append((subject, path, self.term()))
            while self.take(","):
                found.append((subject, path, self.term()))
            while self.take(";"):
                pass
            if self.peek() in (".", "}", "{") or self.kind() == "end" or self.peek() in ("FILTER", "OPTIONAL", "BIND", "VALUES", "MINUS", "GRAPH", "UNION"):
                return found
            if self.tokens[self.i - 1][1] != ";":
                raise ValueError(f"; or . expected, {self.peek()} found")

    def body(self) -> list:
        self.need("{")
        found = []
        if self.peek() == "SELECT":
            found.append(("select", self.query()))
            self.need("}")
            return found
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("FILTER"):
                found.append(("filter", self.expression()))
            elif self.take("OPTIONAL"):
                found.append(("optional", self.body()))
            elif self.take("MINUS"):
                found.append(("minus", self.body()))
            elif self.take("GRAPH"):
                found.append(("graph", self.term(), self.body()))
            elif self.take("BIND"):
                self.need("(")
                value = self.expression()
                self.need("AS")
                found.append(("bind", value, self.var()))
                self.need(")")
            elif self.take("VALUES"):
                found.append(self.values())
            elif self.peek() == "{":
                parts = [self.body()]
                while self.take("UNION"):
                    parts.append(self.body())
                found.append(("union", parts))
            else:
                found.append(("triples", self.triples()))
        return found

    def values(self) -> tuple:
        if self.kind() == "var":
            names, many = [self.var()], False
        else:
            self.need("(")
            names, many = [], True
            while not self.take(")"):
                names.append(self.var())
        rows = []
        self.need("{")
        while not self.take("}"):
            if many:
                self.need("(")
            rows.append(tuple(str(self.term()[1]) for _ in names))
            if many:
                self.need(")")
        return "values", names, rows

    def expression(self, least: int = 0) -> Term:
        left = self.primary()
        ranks = {"||": 1, "&&": 2, "=": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "IN": 3, "NOT": 3, "+": 4, "-": 4, "*": 5, "/": 5}
        while ranks.get(sign := self.peek(), 0) > least:
            self.i += 1
            if sign in ("IN", "NOT"):
                if sign == "NOT":
                    self.need("IN")
                inside = ("in", left, self.arguments())
                left = ("!", inside) if sign == "NOT" else inside
            else:
                left = ("op", sign, left, self.expression(ranks[sign]))
        return left

    def arguments(self) -> list[Term]:
        self.need("(")
        found = []
        while not self.take(")"):
            found.append(self.expression())
            self.take(",")
        return found

    def primary(self) -> Term:
        if self.take("NOT", "EXISTS"):
            return ("exists", False, self.body())
        if self.take("EXISTS"):
            return ("exists", True, self.body())
        if self.take("!"):
            return ("!", self.primary())
        if self.take("("):
            inner = self.expression()
            self.need(")")
            return inner
        if self.kind() == "word" and self.i + 1 < len(self.tokens) and self.tokens[self.i + 1][1] == "(":
            name = self.next().upper()
            if name not in _AGGREGATES:
                return ("call", name, self.arguments())
            self.need("(")
            distinct = self.take("DISTINCT")
            inner = None if self.take("*") else self.expression()
            self.need(")")
            return ("aggregate", name, distinct, inner)
        return self.term()

    def quads(self) -> list[tuple[Term | None, Term, Term, Term]]:
        found = []
        self.need("{")
        while not self.take("}"):
            if self.take("GRAPH"):
                graph = self.term()
                found += [(graph, *t[1:]) for t in self.quads()]
            elif not self.take("."):
                found += [(None, *t) for t in self.triples()]
        return found

    def query(self) -> Query:
        while self.peek() in ("PREFIX", "BASE"):
            if self.next().upper() == "PREFIX":
                name = self.next()
                self.prefixes[name[:-1]] = self.next()[1:-1]
            else:
                self.next()
        q = Query(self.next().upper())
        if q.form == "DROP":
            self.need("GRAPH")
            q.graphs.append(self.term()[1])
            return q
        if q.form == "SELECT":
            q.distinct = self.take("DISTINCT")
            if not self.take("*"):
                q.columns = []
                while self.kind() == "var" or self.peek() == "(":
                    if self.take("("):
                        value = self.expression()
                        self.need("AS")
                        q.columns.append((value, self.var()))
                        self.need(")")
                    else:
                        name = self.var()
                        q.columns.append((("var", name), name))
        elif q.form in ("CONSTRUCT", "INSERT", "DELETE"):
            q.template = self.quads()
        elif q.form != "ASK":
            raise ValueError(f"{q.form or 'nothing'} is no supported query form")
        while self.take("FROM"):
            q.graphs.append(self.term()[1])
        self.take("WHERE")
        q.where = self.body()
        if self.take("GROUP"):
            self.need("BY")
            while self.kind() == "var":
                q.group.append(self.var())
        if self.take("HAVING"):
            q.having = self.expression()
        if self.take("ORDER"):
            self.need("BY")
            while self.kind() == "var" or self.peek() in ("ASC", "DESC", "(", "RAND"):
                up = self.peek() != "DESC"
                self.i += self.peek() in ("ASC", "DESC")
                q.order.append((self.primary(), up))
        while self.peek() in ("LIMIT", "OFFSET"):
            key = self.next().upper()
            setattr(q, key.lower(), int(self.next()))
        return q

    def read(self) -> Query:
        q = self.query()
        if self.kind() != "end":
            raise ValueError(f"the end expected, {self.peek()} found")
        return q


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _numeric(e: Term) -> bool:
    if e[0] == "op":
        return e[1] in ("+", "-", "*", "/")
    return e[0] == "num" or (e[0] == "call" and e[1] in _NUMERIC) or (e[0] == "aggregate" and e[1] in ("COUNT", "SUM", "AVG"))


def _has_aggregate(e: Term | None) -> bool:
    return isinstance(e, (tuple, list)) and bool(e) and (e[0] == "aggregate" or any(_has_aggregate(x) for x in e))


class _Plan:
    """Builds the DataFrame of a query. Hidden columns (`#x`: the kind of x) serve CONSTRUCT."""

    def __init__(self, quads: DataFrame, q: Query):
        self.all, self.q = quads, q
        self.kinds = {t[3][1] for t in q.template if t[3][0] == "var"}

    def scope(self, graph: Term | None, graphs: list[str]) -> tuple[DataFrame, bool]:
        """The quads in scope, and whether triples can repeat there."""
        if graph is None:
            return (self.all.where(F.col("g").isin(graphs)) if graphs else self.all), len(graphs) != 1
        return (self.all.where(F.col("g") == graph[1]) if graph[0] == "iri" else self.all), False

    def object_is(self, term: Term) -> Column:
        return (F.col("o") == str(term[1])) & (F.col("k") == "iri" if term[0] == "iri" else F.col("k") != "iri")

    def language(self, name: str, langs: dict[str, str]) -> Column:
        if name not in langs:
            return F.lit(True)
        if "lang" not in self.all.columns:
            raise ValueError("LANG needs quads with a column lang")
        return F.col("lang") == langs[name]

    def bound(self, df: DataFrame, ends: list[tuple[Term, str]], langs: dict[str, str], repeats: bool, also: tuple[str, ...] = ()) -> DataFrame:
        """Solutions of rows whose columns meet the terms."""
        seen: dict[str, str] = {}
        for term, c in ends:
            if term[0] != "var":
                df = df.where(self.object_is(term) if c == "o" else F.col(c) == str(term[1]))
            elif term[1] in seen:
                df = df.where(F.col(c) == F.col(seen[term[1]]))
            else:
                seen[term[1]] = c
                if c == "o":
                    df = df.where(self.language(term[1], langs))
        if repeats:
            df = df.dropDuplicates(["s", "o", "k", *also])
        kinds = [(F.col("k") if c == "o" else F.lit("iri")).alias(f"#{v}") for v, c in seen.items() if v in self.kinds]
        return df.select(*[F.col(c).alias(v) for v, c in seen.items()], *kinds, *([] if seen else [F.lit(True).alias("#met")]))

    def edges(self, path: Term, df: DataFrame, ends: tuple[Term, Term]) -> DataFrame:
        """(s, o, k) pairs that the path connects."""
        def step(inverse: bool, name: str, more: str) -> DataFrame:
            one = df.where(F.col("p") == name).select("s", "o", "k").distinct()
            if more:
                up = closure(one.where("k = 'iri'").select(F.col("s").alias("c"), F.col("o").alias("p"))).select(F.col("c").alias("s"), F.col("a").alias("o"))
                nodes = one.select(F.explode(F.array("s", "o")).alias("s"))
                fixed = [(str(t[1]),) for t in ends if t[0] != "var"]
                if fixed:
                    nodes = nodes.unionByName(df.sparkSession.createDataFrame(fixed, "s string"))
                star = up.unionByName(nodes.select("s", F.col("s").alias("o"))).distinct()
                if more == "+":
                    star = one.select("s", F.col("o").alias("m")).join(star.select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()
                one = star.withColumn("k", F.lit("iri"))
            return one.select(F.col("o").alias("s"), F.col("s").alias("o"), F.lit("iri").alias("k")) if inverse else one

        steps = [step(*s) for s in path[2]]
        if path[1] != "/":
            return reduce(DataFrame.unionByName, steps)
        return reduce(lambda a, b: a.select("s", F.col("o").alias("m")).join(b.select(F.col("s").alias("m"), "o", "k"), "m").select("s", "o", "k"), steps)

    def triple(self, t: tuple[Term, Term, Term], graph: Term | None, graphs: list[str], langs: dict[str, str]) -> DataFrame:
        df, repeats = self.scope(graph, graphs)
        at = [(graph, "g")] if graph and graph[0] == "var" else []
        if t[1][0] == "path":
            if at:
                raise ValueError("paths in GRAPH ?g are not supported")
            return self.bound(self.edges(t[1], df, (t[0], t[2])), [(t[0], "s"), (t[2], "o")], langs, False)
        return self.bound(df, [(t[0], "s"), (t[1], "p"), (t[2], "o"), *at], langs, repeats, ("p",))

    def star(self, ts: list[tuple[Term, Term, Term]], graph: Term | None, graphs: list[str], langs: dict[str, str]) -> DataFrame:
        """Patterns on one subject: one scan, one grouping."""
        df, _ = self.scope(graph, graphs)
        df = df.where(F.col("p").isin(sorted({t[1][1] for t in ts})))
        keys = [F.col("s").alias(ts[0][0][1]), *([F.col("g").alias(graph[1])] if graph and graph[0] == "var" else [])]
        aggs = []
        for i, t in enumerate(ts):
            here = F.col("p") == t[1][1]
            if t[2][0] == "var":
                aggs.append(F.collect_set(F.when(here & self.language(t[2][1], langs), F.struct("o", "k"))).alias(f"#{i}"))
            else:
                aggs.append(F.bool_or(here & self.object_is(t[2])).alias(f"#{i}"))
        out = df.groupBy(*keys).agg(*aggs)
        objects = {i: t[2][1] for i, t in enumerate(ts) if t[2][0] == "var"}
        out = out.where(reduce(Column.__and__, [F.size(_col(f"#{i}")) > 0 if i in objects else _col(f"#{i}") for i in range(len(ts))]))
        out = out.drop(*[f"#{i}" for i in range(len(ts)) if i not in objects])
        for i, name in objects.items():
            out = out.withColumn(f"#{i}", F.explode(_col(f"#{i}"))).withColumn(name, _col(f"#{i}")["o"])
            out = (out.withColumn(f"#{name}", _col(f"#{i}")["k"]) if name in self.kinds else out).drop(f"#{i}")
        if ts[0][0][1] in self.kinds:
            out = out.withColumn(f"#{ts[0][0][1]}", F.lit("iri"))
        return out

    def basic(self, ts: list[tuple[Term, Term, Term]], graph: Term | None, graphs: list[str], langs: dict[str, str]) -> list[DataFrame]:
        stars: dict[str, list] = {}
        parts = []
        for t in ts:
            mine = stars.setdefault(t[0][1], []) if t[0][0] == "var" and t[1][0] == "iri" and t[2] != t[0] else None
            if mine is None or (t[2][0] == "var" and any(t[2] == x[2] for x in mine)):
                parts.append(self.triple(t, graph, graphs, langs))
            else:
                mine.append(t)
        return [self.star(m, graph, graphs, langs) if len(m) > 1 else self.triple(m[0], graph, graphs, langs) for m in stars.values() if m] + parts

    @staticmethod
    def names(df: DataFrame) -> list[str]:
        return [c for c in df.columns if not c.startswith("#")]

    def join(self, left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
        if left is None:
            return right
        shared = [c for c in self.names(left) if c in right.columns]
        if not shared:
            raise ValueError("patterns that share no variable would be a product")
        if how in ("left_semi", "left_anti"):
            return left.join(right.select(*[_col(c) for c in shared]), shared, how)
        return left.join(right.drop(*[c for c in right.columns if c.startswith("#") and c in left.columns]), shared, how)

    def joined(self, left: DataFrame | None, parts: list[DataFrame]) -> DataFrame | None:
        """All parts, each as soon as it shares a variable with those before."""
        parts = list(parts)
        while parts:
            have = set(self.names(left)) if left is not None else None
            part = next((p for p in parts if have is None or have & set(p.columns)), parts[0])
            parts.remove(part)
            left = self.join(left, part)
        return left

    def pattern(self, body: list, graph: Term | None, graphs: list[str]) -> DataFrame:
        langs = {}
        filters = []
        for e in [x[1] for x in body if x[0] == "filter"]:
            if e[0] == "op" and e[1] == "=" and e[2][:2] == ("call", "LANG"):
                langs[e[2][2][0][1]] = e[3][1]
            else:
                filters.append(e)
        if not body and graph and graph[0] == "var":
            return self.all.select(F.col("g").alias(graph[1])).distinct()
        out, waiting, inline = None, [], []

        def flush() -> None:
            nonlocal out, waiting, inline
            ts = [t for kind, t in waiting if kind == "triple"]
            out = self.joined(out, self.basic(ts, graph, graphs, langs) + [df for kind, df in waiting if kind == "part"] + inline)
            waiting, inline = [], []

        for kind, *x in body:
            if kind == "triples":
                waiting += [("triple", t) for t in x[0]]
            elif kind == "graph":
                waiting.append(("part", self.pattern(x[1], x[0], graphs)))
            elif kind == "values":
                schema = ", ".join(f"`{n}` string" for n in x[0])
                inline.append(F.broadcast(self.all.sparkSession.createDataFrame(x[1], schema)))  # as large as the text of the query
            elif kind == "union":
                waiting.append(("part", reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.pattern(b, graph, graphs) for b in x[0]])))
            elif kind == "select":
                waiting.append(("part", _Plan(self.all, x[0]).select(x[0].graphs or graphs)))
            elif kind in ("optional", "minus"):
                flush()
                out = self.join(out, self.pattern(x[0], graph, graphs), "left" if kind == "optional" else "left_anti")
            elif kind == "bind":
                flush()
                out = out.withColumn(x[1], self.value(x[0], out).cast("string"))
        flush()
        for e in filters:
            if e[0] == "exists":
                out = self.join(out, self.pattern(e[2], graph, graphs), "left_semi" if e[1] else "left_anti")
            else:
                out = out.where(self.value(e, out))
        return out

    def value(self, e: Term, df: DataFrame) -> Column:
        kind = e[0]
        if kind == "var":
            return _col(e[1]) if e[1] in df.columns else F.lit(None).cast("string")
        if kind in ("iri", "lit", "num", "bool"):
            return F.lit(e[1])
        if kind == "!":
            return ~self.value(e[1], df)
        if kind == "in":
            return self.value(e[1], df).cast("string").isin(*[str(x[1]) for x in e[2]]) if not any(_numeric(x) for x in e[2]) else self.number(e[1], df).isin(*[x[1] for x in e[2]])
        if kind == "aggregate":
            return self.aggregate(e, df)
        if kind == "call":
            return self.call(e[1], e[2], df)
        if kind != "op":
            raise ValueError(f"{kind} is only supported as a whole FILTER")
        sign, left, right = e[1:]
        if sign in ("&&", "||"):
            a, b = self.value(left, df), self.value(right, df)
            return a & b if sign == "&&" else a | b
        numbers = _numeric(e) or _numeric(left) or _numeric(right)
        a, b = (self.number(x, df) if numbers else self.value(x, df) for x in (left, right))
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[sign] if sign not in ("+", "-", "*", "/") else {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[sign]

    def number(self, e: Term, df: DataFrame) -> Column:
        v = self.value(e, df)
        return v.cast("double") if _numeric(e) else v.cast("string").try_cast("double")

    def call(self, name: str, args: list[Term], df: DataFrame) -> Column:
        if name == "RAND":
            row = F.md5(F.concat_ws("\x1f", *[_col(c) for c in sorted(self.names(df))]))
            return F.conv(F.substring(row, 1, 13), 16, 10).cast("double") / float(1 << 52)
        if name == "BOUND":
            return self.value(args[0], df).isNotNull()
        v = [self.value(a, df) for a in args]
        if name == "REGEX":
            flags = f"(?{args[2][1]})" if len(args) > 2 else ""
            return v[0].rlike(flags + args[1][1])
        simple = {
            "STR": lambda: v[0], "LCASE": lambda: F.lower(v[0]), "UCASE": lambda: F.upper(v[0]), "STRLEN": lambda: F.length(v[0]), "CONCAT": lambda: F.concat(*v), "COALESCE": lambda: F.coalesce(*v),
            "CONTAINS": lambda: F.contains(v[0], v[1]), "STRSTARTS": lambda: F.startswith(v[0], v[1]), "STRENDS": lambda: F.endswith(v[0], v[1]), "IF": lambda: F.when(v[0], v[1]).otherwise(v[2]),
            "YEAR": lambda: F.year(v[0].try_cast("date")), "SUBSTR": lambda: F.substring(v[0], int(args[1][1]), int(args[2][1]) if len(args) > 2 else 1 << 30), "REPLACE": lambda: F.regexp_replace(v[0], args[1][1], args[2][1]),
        }
        if name not in simple:
            raise ValueError(f"{name} is no supported function")
        return simple[name]()

    def aggregate(self, e: Term, df: DataFrame) -> Column:
        _, name, distinct, inner = e
        v = F.lit(1) if inner is None else self.value(inner, df)
        if name == "COUNT":
            if inner is None and distinct:
                return F.count_distinct(F.struct(*[_col(c) for c in self.names(df)]))
            return F.count_distinct(v) if distinct else F.count(v)
        n = self.number(inner, df)
        if name in ("SUM", "AVG"):
            return {("SUM", False): F.sum, ("AVG", False): F.avg, ("SUM", True): F.sum_distinct}[name, distinct](n) if (name, distinct) != ("AVG", True) else F.sum_distinct(n) / F.count_distinct(n)
        if name == "SAMPLE":
            return F.min(v)
        by, plain = (F.min_by, F.min) if name == "MIN" else (F.max_by, F.max)
        return F.when(F.count(n) == F.count(v), by(v, n)).otherwise(plain(v))

    def sort_keys(self, df: DataFrame) -> list[Column]:
        """Numbers by value before other texts."""
        keys = []
        for e, up in self.q.order:
            v = self.value(e, df)
            for k in [v] if _numeric(e) else [v.cast("string").try_cast("double"), v]:
                keys.append((F.asc_nulls_last if up else F.desc_nulls_first)(k))
        return keys

    def select(self, graphs: list[str]) -> DataFrame:
        q = self.q
        df = self.pattern(q.where, None, graphs)
        chosen = q.columns if q.columns is not None else [(("var", c), c) for c in self.names(df)]
        if q.group or _has_aggregate(q.having) or any(_has_aggregate(e) for e, _ in chosen):
            extra = [self.value(e, df).alias(n) for e, n in chosen if _has_aggregate(e)]
            if q.having:
                extra.append(self.value(q.having, df).alias("#having"))
            df = df.groupBy(*[_col(c) for c in q.group]).agg(*extra)
            df = df.where(_col("#having")) if q.having else df
            chosen = [(e if not _has_aggregate(e) else ("var", n), n) for e, n in chosen]
        for e, n in chosen:
            if e != ("var", n) or n not in df.columns:
                df = df.withColumn(n, self.value(e, df))
        wanted = [_col(n) for _, n in chosen]
        if q.distinct:
            df = df.select(*wanted).distinct()
        if q.order:
            df = df.orderBy(*self.sort_keys(df))
        df = df.offset(q.offset) if q.offset else df
        df = df.limit(q.limit) if q.limit is not None else df
        return df.select(*wanted)

    def construct(self, graph: str) -> DataFrame:
        """The template's quads; those without GRAPH go to graph."""
        df = self.pattern(self.q.where, None, self.q.graphs)
        put = lambda t: _col(t[1]) if t[0] == "var" else F.lit(str(t[1]))
        kind = lambda t: F.lit("iri" if t[0] == "iri" else "literal") if t[0] != "var" or f"#{t[1]}" not in df.columns else _col(f"#{t[1]}")
        rows = [F.struct((put(g) if g else F.lit(graph)).alias("g"), put(s).alias("s"), put(p).alias("p"), put(o).alias("o"), kind(o).alias("k")) for g, s, p, o in self.q.template]
        return df.select(F.inline(F.array(*rows))).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()


def query(text: str, quads: DataFrame, type_name: str = TYPE) -> DataFrame:
    """The solutions of a SELECT, the row (ask) of an ASK or the quads of a CONSTRUCT, over quads (g, s, p, o, k and, for LANG, lang).

    `a` stands for type_name.
    """
    q = _Parser(text, type_name).read()
    plan = _Plan(quads, q)
    if q.form == "ASK":
        return plan.pattern(q.where, None, q.graphs).limit(1).agg((F.count("*") > 0).alias("ask"))
    if q.form in ("SELECT", "CONSTRUCT"):
        return plan.select(q.graphs) if q.form == "SELECT" else plan.construct("default")
    raise ValueError(f"{q.form} changes quads: use update()")


def scalar(text: str, quads: DataFrame, type_name: str = TYPE) -> int:
    """The last cell of a SELECT's last row, as a number; for queries that return one."""
    rows = query(text, quads, type_name).tail(1)
    return int(rows[-1][-1]) if rows else 0


def update(text: str, quads: DataFrame, graph: str = "default", type_name: str = TYPE) -> DataFrame:
    """The quads after INSERT ... WHERE, DELETE ... WHERE or DROP GRAPH.

    A deleted triple without GRAPH goes from every graph. Inserted quads get null in columns other than g, s, p, o and k.
    """
    q = _Parser(text, type_name).read()
    if q.form == "DROP":
        return quads.where(F.col("g") != q.graphs[0])
    made = _Plan(quads, q)
    if q.form == "INSERT":
        new = made.construct(graph)
        return quads.unionByName(new.join(quads, ["g", "s", "p", "o", "k"], "left_anti"), allowMissingColumns=True)
    if q.form != "DELETE":
        raise ValueError(f"{q.form} changes nothing: use query()")
    gone, scoped = made.construct(graph), all(t[0] for t in q.template)
    return quads.join(gone, ["g", "s", "p", "o", "k"] if scoped else ["s", "p", "o", "k"], "left_anti")


def apply_rules(bodies: list[str], quads: DataFrame, graph: str, type_name: str = TYPE) -> DataFrame:
    """The quads that CONSTRUCT rules derive, $INFERENCE_NS$ standing for the graph."""
    made = [query(b.replace("$INFERENCE_NS$", f"<{graph}>"), quads, type_name) for b in bodies]
    return reduce(DataFrame.unionByName, made).distinct()
