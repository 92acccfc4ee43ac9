"""SHACL shapes: what a run projects and validates. A shape is small metadata on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from weft.sources.turtle import RDF, XSD, parse

SH = "http://www.w3.org/ns/shacl#"


def local_name(iri: str) -> str:
    """What follows the last # or else the last /."""
    return iri.rsplit("#", 1)[-1] if "#" in iri else iri.rsplit("/", 1)[-1]


def abbreviate(iri: str) -> str:
    """xsd: for datatypes; the local name with dbo: for everything else."""
    return f"xsd:{iri.removeprefix(XSD)}" if iri.startswith(XSD) else f"dbo:{local_name(iri)}"


@dataclass(frozen=True)
class Property:
    uri: str
    range: str | None
    min_count: int
    max_count: int | None
    node_kind: str | None
    or_group: int
    or_branch: int

    @property
    def name(self) -> str:
        return local_name(self.uri)

    @property
    def kind(self) -> str:
        """By the namespace of the range, whichever SHACL term names it; untyped counts as a datatype."""
        return "object" if self.range and not self.range.startswith(XSD) and not self.range.startswith(RDF) else "datatype"


@dataclass(frozen=True)
class Shape:
    uri: str
    target: str
    properties: tuple[Property, ...]

    @property
    def typed(self) -> tuple[Property, ...]:
        return tuple(p for p in self.properties if p.range)

    @staticmethod
    def read(text: str) -> Shape:
        """The first node shape of a Turtle text, with the properties of all branches of its sh:or."""
        triples = parse(text)
        by: dict[tuple[str, str], list[str]] = {}
        for s, p, o in triples:
            by.setdefault((s, p), []).append(o)
        one = lambda s, *names: next((by[s, SH + n][0] for n in names if (s, SH + n) in by), None)
        subject, target = next((s, o) for s, p, o in triples if p == SH + "targetClass")

        def members(head: str) -> list[str]:
            out = []
            while head != f"{RDF}nil" and (head, f"{RDF}first") in by:
                out.append(by[head, f"{RDF}first"][0])
                head = by[head, f"{RDF}rest"][0]
            return out

        def prop(node: str, group: int, branch: int) -> Property:
            count = lambda n: int(x) if (x := one(node, n)) is not None else None
            return Property(one(node, "path"), one(node, "datatype", "class"), count("minCount") or 0, count("maxCount"), one(node, "nodeKind"), group, branch)

        found = [prop(x, 0, 0) for x in by.get((subject, SH + "property"), [])]
        for group, head in enumerate(by.get((subject, SH + "or"), []), 1):
            for branch, member in enumerate(members(head), 1):
                inner = by.get((member, SH + "property"), []) or [member]
                found += [prop(x, group, branch) for x in inner if one(x, "path")]
        return Shape(subject, target, tuple(found))

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each property; a shape has tens, so it may always be broadcast."""
        rows = [(self.uri, local_name(self.target), p.uri, p.name, p.range, p.kind, p.min_count, p.max_count, p.node_kind, p.or_group, p.or_branch) for p in self.properties]
        return spark.createDataFrame(rows, "shape string, target string, prop_uri string, p string, range string, kind string, min_count int, max_count int, node_kind string, or_group int, or_branch int")


@dataclass(frozen=True)
class Rule:
    """A rule file's entry: the SPARQL text of its body, with $INFERENCE_NS$ for the graph it writes."""

    name: str
    body: str


def read_rules(xml: str) -> list[Rule]:
    root = ElementTree.fromstring(xml)
    bodies = [x for x in root.iter() if x.tag.rsplit("}", 1)[-1] == "body"]
    return [Rule(f"rule{i}", (b.text or "").strip()) for i, b in enumerate(bodies, 1)]
