"""RDFS inference over facts (s, p, o, k): the schema is closed, then the facts meet it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import closure
from weft.sources.scratch import discard, settle

TYPE = "rdf:type"
#: Statements about classes and properties, by what follows from them.
SCHEMA = ("rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range")
#: Schema statements up to which they are broadcast to the facts; beyond that both are joined by shuffle.
MAX_BROADCAST = 100_000
_FACT = ["s", "p", "o", "k"]


def _entailed(facts: DataFrame, schema: DataFrame, small: bool) -> DataFrame:
    """What the rules make of facts and schema statements (subject, kind, object), in one join: a fact meets the statements about its property, a type fact those about its class too."""
    about = schema.select(F.col("s").alias("about"), F.col("p").alias("rule"), F.col("o").alias("then"))
    by = F.array(F.struct(F.col("p").alias("about"), F.lit(False).alias("as_class")), F.when(F.col("p") == TYPE, F.struct(F.col("o").alias("about"), F.lit(True).alias("as_class"))))
    keyed = facts.select("s", "p", "o", "k", F.inline(F.array_compact(by)))
    met = keyed.join(F.broadcast(about) if small else about, "about")
    is_class = F.col("rule") == "rdfs:subClassOf"
    fits = (is_class == F.col("as_class")) & ((F.col("rule") != "rdfs:range") | (F.col("k") == "iri"))
    new = F.when(F.col("rule") == "rdfs:subPropertyOf", F.struct("s", F.col("then").alias("p"), "o", "k")).otherwise(
        F.struct(F.when(F.col("rule") == "rdfs:range", F.col("o")).otherwise(F.col("s")).alias("s"), F.lit(TYPE).alias("p"), F.col("then").alias("o"), F.lit("iri").alias("k"))
    )
    return met.where(fits).select(F.inline(F.array(new)))


def _closed(schema: DataFrame) -> DataFrame:
    """Statements (s, p, o) with all that they say together of one fact: super-properties and superclasses at any distance, and domains and ranges with those of super-properties and the superclasses of both."""
    sub = F.when(F.col("p") == "rdfs:subPropertyOf", "p").when(F.col("p") == "rdfs:subClassOf", "c")
    edges = schema.where(sub.isNotNull()).select(F.concat(sub, F.col("s")).alias("c"), F.concat(sub, F.col("o")).alias("p"))
    up = settle(closure(edges).where("d > 0").select(F.substring("c", 1, 1).alias("kind"), F.expr("substring(c, 2)").alias("x"), F.expr("substring(a, 2)").alias("y")))
    props, classes = up.where("kind = 'p'").select("x", "y"), up.where("kind = 'c'").select("x", "y")
    ends = schema.where(F.col("p").isin("rdfs:domain", "rdfs:range")).select("s", "p", "o")
    ends = ends.unionByName(ends.join(classes, F.col("o") == F.col("x")).select("s", "p", F.col("y").alias("o")))
    ends = ends.unionByName(ends.join(props, F.col("s") == F.col("y")).select(F.col("x").alias("s"), "p", "o"))
    return up.select(F.col("x").alias("s"), F.when(F.col("kind") == "p", "rdfs:subPropertyOf").otherwise("rdfs:subClassOf").alias("p"), F.col("y").alias("o")).unionByName(ends).distinct()


def rdfs(facts: DataFrame, ontology: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """facts and all that follows: facts of super-properties, types by domain and range, types of superclasses. facts and ontology: (s, p, o, k).

    The schema is closed first, so that one join makes all that follows from a fact, and one shuffle leaves out what is there more than once. Only where the schema speaks of rdf:type or
    makes a property one of its own (a property may be declared below rdfs:subClassOf) do further rounds join what the round before has added, or everything with a schema
    that has grown, until nothing is new; cycles end too. Literals get no types, though a range may ask for one. Rows with nulls are left out."""
    both = facts.select(*_FACT).unionByName(ontology.select(*_FACT)).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
    base = settle(both)
    is_schema = F.col("p").isin(*SCHEMA)

    def statements(every: DataFrame) -> tuple[DataFrame, bool]:
        schema = settle(_closed(every.where(is_schema).select("s", "p", "o").distinct()))
        return schema, schema.count() <= MAX_BROADCAST

    schema, small = statements(base)
    about_type = (F.col("s") == TYPE) & (F.col("p") != "rdfs:subClassOf")
    makes_schema = (F.col("p") == "rdfs:subPropertyOf") & F.col("o").isin(TYPE, *SCHEMA)
    goes_on = not schema.where(about_type | makes_schema).isEmpty()
    made = base.unionByName(_entailed(base, schema, small))
    known = [settle(made.distinct())]
    if not goes_on:
        discard(base)
        return known[0]
    delta = known[0]
    for _ in range(max_rounds):
        every = known[0]
        for one in known[1:]:
            every = every.unionByName(one)
        if not delta.where(is_schema).isEmpty():
            schema, small = statements(every)
            delta = every
        delta = settle(_entailed(delta, schema, small).distinct().join(every, _FACT, "left_anti"))
        if delta.isEmpty():
            discard(delta)
            break
        known.append(delta)
    discard(base)
    out = known[0]
    for one in known[1:]:
        out = out.unionByName(one)
    return out


def types(facts: DataFrame) -> DataFrame:
    """(s, cls) of all type facts."""
    return facts.where(F.col("p") == TYPE).select("s", F.col("o").alias("cls")).distinct()
