"""RDFS inference against a naive fixpoint, and validation reports."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import inference, scoring
from weft.plans.shape import Shape

FACT = "s string, p string, o string, k string"


def naive(facts):
    known = {f for f in facts if None not in f[:3]}
    while True:
        new = set()
        for s, p, o, k in known:
            for a, rule, b, _ in known:
                if rule == "rdfs:subPropertyOf" and a == p:
                    new.add((s, b, o, k))
                if rule == "rdfs:domain" and a == p:
                    new.add((s, "rdf:type", b, "iri"))
                if rule == "rdfs:range" and a == p and k == "iri":
                    new.add((o, "rdf:type", b, "iri"))
                if rule == "rdfs:subClassOf" and p == "rdf:type" and a == o:
                    new.add((s, "rdf:type", b, "iri"))
        if new <= known:
            return known
        known |= new


def run(spark, facts, ontology):
    got = inference.rdfs(spark.createDataFrame(facts, FACT + ", extra int"), spark.createDataFrame(ontology, FACT)).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("small", [True, False])
def test_fixpoint_on_random_graphs(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(inference, "MAX_BROADCAST", -1)
    r = random.Random(4)
    classes, props, things = [f"C{i}" for i in range(6)], [f"p{i}" for i in range(5)], [f"x{i}" for i in range(12)]
    ontology = [(r.choice(classes), "rdfs:subClassOf", r.choice(classes), "iri") for _ in range(6)] + [(r.choice(props), "rdfs:subPropertyOf", r.choice(props), "iri") for _ in range(4)]
    ontology += [(r.choice(props), f"rdfs:{w}", r.choice(classes), "iri") for w in ("domain", "range") for _ in range(2)]
    facts = [(r.choice(things), r.choice(props), r.choice(things), r.choice(["iri", "literal"]), 1) for _ in range(30)] + [(r.choice(things), "rdf:type", r.choice(classes), "iri", 1) for _ in range(4)]
    facts += [(None, "p0", "x1", "iri", 1), ("x1", "p0", None, "iri", 1), facts[0]]
    assert run(spark, facts, ontology) == naive([f[:4] for f in facts] + ontology)


def test_schema_that_is_itself_inferred_and_cycles(spark):
    ontology = [("kindOf", "rdfs:subPropertyOf", "rdfs:subClassOf", "iri"), ("A", "kindOf", "B", "iri"), ("B", "kindOf", "C", "iri"), ("C", "rdfs:subClassOf", "A", "iri"), ("rdf:type", "rdfs:domain", "Thing", "iri")]
    facts = [("x", "rdf:type", "B", "iri", 0)]
    got = run(spark, facts, ontology)
    assert got == naive([f[:4] for f in facts] + ontology)
    assert ("x", "rdf:type", "A", "iri") in got and ("x", "rdf:type", "Thing", "iri") in got
    assert run(spark, [], []) == set()


SHAPE = Shape.read("""
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix ex: <http://example.org/> .
ex:S a sh:NodeShape ; sh:targetClass ex:Person ;
  sh:property [ sh:path ex:born ; sh:datatype xsd:date ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path ex:home ; sh:class ex:Place ; sh:nodeKind sh:IRI ] ;
  sh:or ( [ sh:property [ sh:path ex:name ; sh:datatype xsd:string ; sh:minCount 1 ] ] [ sh:property [ sh:path ex:nick ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] ] ) .
""")


def test_a_row_for_each_violation(spark):
    facts = [("a", "born", "2000-01-01", "literal"), ("a", "home", "p", "iri"), ("a", "name", "A", "literal"), ("a", "born", "2000-01-01", "literal"),
        ("b", "born", "x", "literal"), ("b", "born", "1999-02-02", "literal"), ("b", "home", "q", "iri"), ("b", "home", "text", "literal"), ("b", "nick", "1", "literal"), ("b", "nick", "2", "literal"),
        ("other", "born", "x", "literal"), ("a", "unknown", None, "literal")]
    types = [("a", "Person"), ("b", "Person"), ("c", "Person"), ("p", "Place"), ("p", "Place"), ("other", "Dog")]
    rows = scoring.report(spark.createDataFrame(facts, FACT), SHAPE, spark.createDataFrame(types, "s string, cls string")).collect()
    assert sorted(tuple(r) for r in rows if r.value is None) == [("b", "born", None, "maxCount"), ("b", "or1", None, "or"), ("c", "born", None, "minCount"), ("c", "or1", None, "or")]
    assert sorted(tuple(r) for r in rows if r.value is not None) == [("b", "born", "x", "datatype"), ("b", "home", "q", "class"), ("b", "home", "text", "class"), ("b", "home", "text", "nodeKind")]
    assert scoring.report(spark.createDataFrame([], FACT), SHAPE, spark.createDataFrame([], "s string, cls string")).collect() == []


def test_values_without_a_class_stay_apart(spark):
    """Facts that ask for no class go to their class's lookup by subject: equal values don't meet in one partition, and results stay."""
    facts = spark.range(4000).selectExpr("concat('n', id) AS s", "inline(array(struct('rdf:type' AS p, 'Person' AS o, 'iri' AS k), struct('home' AS p, concat('p', id) AS o, 'iri' AS k)))")
    types = spark.range(0, 4000, 2).selectExpr("concat('p', id) AS s", "'Place' AS cls")
    classed = scoring._classed(facts, {("home", "Place")}, types, "s")
    assert classed.where("p = 'home' AND classed").count() == 2000 and classed.where("p <> 'home' AND classed IS NOT NULL").count() == 0 and classed.count() == 8000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r[0] for r in classed.where("p <> 'home'").groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 8 and max(sizes) < 1000


def test_long_chains_need_no_further_rounds(spark, monkeypatch):
    """The facts are written as often for a chain of nine classes as for one of two."""
    written = []
    monkeypatch.setattr(inference, "settle", lambda df, real=inference.settle: written.append(df) or real(df))
    for n in (2, 9):
        ontology = [(f"C{i}", "rdfs:subClassOf", f"C{i + 1}", "iri") for i in range(n)] + [("p", "rdfs:subPropertyOf", "q", "iri"), ("q", "rdfs:range", "C0", "iri")]
        facts = [("x", "p", "y", "iri", 0), ("x", "p", "z", "literal", 0)]
        assert run(spark, facts, ontology) == naive([f[:4] for f in facts] + ontology)
    assert len(written) == 8
