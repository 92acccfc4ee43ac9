"""Linearised graphs: the one-line Turtle form, tags and triplet tokens, both ways, as column expressions."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import ascii_only, decode_uri, encode_uri
from weft.plans.grammar import LIGHT, Grammar

def serialize(facts: DataFrame, subject: str = "s") -> DataFrame:
    """Per subject of (s, p, o, k): the line `:S a :Type; :p "literal"; :q :A, :B .`; properties and values sorted, the type first. One grouping: a value that
    follows one of the same property continues its list."""
    value = F.when(F.col("k") == "iri", F.concat(F.lit(":"), F.col("o"))).otherwise(F.concat(F.lit('"'), F.col("o"), F.lit('"')))
    each = F.struct((F.col("p") != "rdf:type").alias("later"), F.col("p").alias("p"), value.alias("v"))
    by = facts.groupBy(subject).agg(F.array_sort(F.collect_set(each)).alias("parts"))
    name = lambda t: F.when(t["later"], F.concat(F.lit(":"), t["p"], F.lit(" "))).otherwise(F.lit("a "))
    text = lambda t, i: F.concat(F.when(i == 0, F.lit(" ")).when(F.get("parts", i - 1)["p"] == t["p"], F.lit(", ")).otherwise(F.lit("; ")), F.when((i > 0) & (F.get("parts", i - 1)["p"] == t["p"]), F.lit("")).otherwise(name(t)), t["v"])
    return by.select(subject, F.concat(F.lit(":"), F.col(subject), F.array_join(F.transform("parts", text), ""), F.lit(" .")).alias("line"))


def statements(facts: DataFrame, subject: str = "s", gap: str = " ", datatypes: bool = False) -> DataFrame:
    """serialize() with a statement for each fact, `:S a :Type . :S :p "literal" .`, gap between them; with datatypes, literals carry their dt."""
    kind = F.when(F.col("dt").isNotNull(), F.concat(F.lit("^^"), F.col("dt"))).otherwise("") if datatypes else F.lit("")
    value = F.when(F.col("k") == "iri", F.concat(F.lit(":"), F.col("o"))).otherwise(F.concat(F.lit('"'), F.col("o"), F.lit('"'), kind))
    name = F.when(F.col("p") == "rdf:type", "a").otherwise(F.concat(F.lit(":"), F.col("p")))
    each = F.struct((F.col("p") != "rdf:type").alias("later"), name.alias("p"), value.alias("v"))
    by = facts.groupBy(subject).agg(F.array_sort(F.collect_set(each)).alias("parts"))
    one = lambda t: F.concat(F.lit(":"), F.col(subject), F.lit(" "), t["p"], F.lit(" "), t["v"], F.lit(" ."))
    return by.select(subject, F.array_join(F.transform("parts", one), gap).alias("line"))


TRIPLES = "array<struct<subj:string,prop:string,val:string>>"


def accepted(line: Column, grammar: Grammar = LIGHT) -> Column:
    """Whether the line is the beginning of a sentence of the grammar, or one."""
    return grammar.run(line)["prefix"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def parse(line: Column) -> Column:
    """(subj, prop, val) triples; type as prop 'type'; objects keep their colon. Empty where no subject and type are found."""
    def one(part: Column) -> Column:
        name = F.regexp_extract(part, "^\\s*:([^\\s\":]+)", 1)
        literal = F.regexp_extract(part, '"([^"]*)"', 1)
        objects = F.transform(F.split(F.regexp_replace(part, "^\\s*:[^\\s\":]+\\s*", ""), ","), lambda x: F.trim(x))
        values = F.when(part.contains('"'), F.array(literal)).otherwise(F.filter(objects, lambda x: x.startswith(":") & (F.length(x) > 1)))
        return _let(name, lambda n: F.when(n == "", F.array().cast("array<struct<prop:string,val:string>>")).otherwise(F.transform(values, lambda v: F.struct(n.alias("prop"), v.alias("val")))))

    def read(text: Column) -> Column:
        subject = F.regexp_extract(text, "^:?(\\S+?)\\s*\\ba\\s*:", 1)
        kind = F.regexp_extract(text, "^:?\\S+?\\s*\\ba\\s*:([^\\s;.]+)", 1)
        rest = _let(F.split(text, ";"), lambda parts: F.flatten(F.transform(F.slice(parts, 2, F.size(parts)), one)))
        pairs = F.concat(F.array(F.struct(F.lit("type").alias("prop"), kind.alias("val"))), rest)
        named = lambda s: F.when((s != "") & (kind != ""), F.transform(pairs, lambda t: F.struct(s.alias("subj"), t["prop"].alias("prop"), t["val"].alias("val")))).otherwise(F.array().cast(TRIPLES))
        return _let(subject, named)

    return _let(F.regexp_replace(F.trim(F.coalesce(line, F.lit(""))), "\\s*\\.\\s*$", ""), read)


def parse_ultra(line: Column) -> Column:
    """(subj, prop, val) triples of the shortest form, `subject a type;prop "literal";...`: a part without a literal names subject and type."""
    parts = F.split(line, ";")
    head = F.split(F.trim(F.get(parts, F.lit(0))), " ")
    first = F.struct(F.get(head, F.lit(0)).alias("subj"), F.lit("type").alias("prop"), F.get(head, F.lit(2)).alias("val"))
    rest = F.filter(F.slice(parts, 2, F.size(parts)), lambda x: x.contains('"'))
    name = lambda x: F.trim(F.replace(F.regexp_replace(x, '"[^"]*"', ""), F.lit("."), F.lit("")))
    facts = F.transform(rest, lambda x: F.struct(first["subj"].alias("subj"), name(x).alias("prop"), F.regexp_extract(x, '"([^"]*)"', 1).alias("val")))
    return F.concat(F.array(first), facts)


def from_set_text(c: Column) -> Column:
    """Sorted members of a set written as {'a', 'b'}."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("'([^']*)'"), F.lit(1))))


def type_and_label_first(lines: Column) -> Column:
    """N-Triples lines of an entity: its first type, its first label, then the others as they stood."""
    one = lambda part: F.slice(F.filter(lines, lambda x: x.contains(part)), 1, 1)
    head = F.concat(one("rdf-syntax-ns#"), one("rdf-schema#label"))
    return F.concat(head, F.filter(lines, lambda x: ~F.array_contains(head, x)))


def to_tags(triples: Column) -> Column:
    each = F.transform(triples, lambda t: F.concat(F.lit("<subj>"), t["subj"], F.lit("<rel>"), t["prop"], F.lit("<obj>"), t["val"], F.lit("<et>")))
    return F.array_join(each, "")


def from_tags(text: Column) -> Column:
    part = lambda x, a, b: F.substring_index(F.substring_index(x, a, -1), b, 1)
    pieces = F.filter(F.split(text, "<et>"), lambda x: x.contains("<obj>"))
    return F.transform(pieces, lambda x: F.struct(part(x, "<subj>", "<rel>").alias("subj"), part(x, "<rel>", "<obj>").alias("prop"), F.substring_index(x, "<obj>", -1).alias("val")))


def from_triplet_tokens(text: Column) -> Column:
    """`<triplet> head <subj> tail <obj> relation`, several tails for a head: (subj, prop, val) triples."""
    pieces = F.split(text, "<triplet>")
    heads = F.slice(pieces, 2, F.size(pieces))

    def one(chunk: Column) -> Column:
        head = F.trim(F.substring_index(chunk, "<subj>", 1))
        tails = F.filter(F.slice(F.split(chunk, "<subj>"), 2, F.length(chunk)), lambda x: x.contains("<obj>"))
        return F.transform(tails, lambda x: F.struct(head.alias("subj"), F.trim(F.substring_index(x, "<obj>", -1)).alias("prop"), F.trim(F.substring_index(x, "<obj>", 1)).alias("val")))

    return F.flatten(F.transform(heads, one))


def to_list(triples: Column) -> Column:
    """[[subj, prop, val], ...] as JSON text."""
    return F.to_json(F.transform(triples, lambda t: F.array(t["subj"], t["prop"], t["val"])))


def from_list(text: Column) -> Column:
    """Triples of [[subj, prop, val], ...]; lists of another length are left out, text that is no JSON gives none."""
    lists = F.filter(F.from_json(text, "array<array<string>>"), lambda t: F.size(t) == 3)
    return F.coalesce(F.transform(lists, lambda t: F.struct(t[0].alias("subj"), t[1].alias("prop"), t[2].alias("val"))), F.array().cast(TRIPLES))


def to_factored(triples: Column) -> Column:
    """[subj, [[prop, [val, ...]], ...]] for each subject as an array of (subj, pairs of (prop, vals)), in order of first use."""
    def by_prop(mine: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(mine, lambda t: t["prop"])), lambda p: F.struct(p.alias("prop"), F.transform(F.filter(mine, lambda t: t["prop"] == p), lambda t: t["val"]).alias("vals")))

    def pairs(s: Column) -> Column:
        return _let(F.filter(triples, lambda t: t["subj"] == s), by_prop)

    return F.transform(F.array_distinct(F.transform(triples, lambda t: t["subj"])), lambda s: F.struct(s.alias("subj"), pairs(s).alias("pairs")))


def from_factored(factored: Column) -> Column:
    one = lambda f, p: F.transform(p["vals"], lambda v: F.struct(f["subj"].alias("subj"), p["prop"].alias("prop"), v.alias("val")))
    return F.flatten(F.transform(factored, lambda f: F.flatten(F.transform(f["pairs"], lambda p: one(f, p)))))


def parse_as(line: Column, syntax: Column) -> Column:
    """Triples of a line in the syntax named: light, ultra, tags, list or tokens; an unknown name gives none."""
    readers = {"light": parse, "ultra": parse_ultra, "tags": from_tags, "list": from_list, "tokens": from_triplet_tokens}
    empty = F.array().cast(TRIPLES)
    chosen = F.coalesce(*[F.when(syntax == name, read(line).cast(TRIPLES)) for name, read in readers.items()], empty)
    return F.when(line.isNull(), empty).otherwise(chosen)


def encode_locals(line: Column) -> Column:
    """Percent-encodes each local name, from a colon to white space, `;` or `,`; a closing period and quoted literals stay."""
    def one(t: Column) -> Column:
        end = F.regexp_extract(t, "\\.?$", 0)
        return F.when(t.startswith(":"), F.concat(F.lit(":"), encode_uri(F.regexp_replace(F.substring(t, 2, 1 << 30), "\\.$", "")), end)).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(line, F.lit('("[^"]*"|:[^\\s;,]+|[^:"]+|.)'), F.lit(1)), one), "")


def syntax_of(dataset: str) -> dict[str, str | bool]:
    """The syntax that a dataset's name tells, DS_<syntax>_<0|1>datatype_<0|1>inLine_<0|1>facto_...; flags that it lacks are off."""
    found = re.match(r"(?:DS_)?([A-Za-z]+)", dataset)
    flags = {name: bool(int(on)) for on, name in re.findall(r"_([01])(datatype|inLine|facto)", dataset)}
    return {"syntax": found[1] if found else "", "datatype": False, "inLine": False, "facto": False} | flags


def syntaxes_of(dataset: Column) -> Column:
    """syntax_of() as a column: struct<syntax, datatype, inLine, facto>."""
    flag = lambda name: (F.element_at(F.regexp_extract_all(dataset, F.lit(f"_([01]){name}"), F.lit(1)), -1) == "1").alias(name)
    off = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    found = [off(F.when(dataset.rlike(f"_[01]{n}"), flag(n)), n) for n in ("datatype", "inLine", "facto")]
    return F.struct(F.coalesce(F.regexp_extract(dataset, "^(?:DS_)?([A-Za-z]+)", 1), F.lit("")).alias("syntax"), *found)


def _bleu(predicted: str | None, references: list[str | None]) -> float:
    """char_bleu() of one value: n-grams are counted once for each side, so it is linear in the texts."""
    bare = lambda t: t.replace(" ", "")
    others = [bare(r) for r in references if r is not None]
    own = bare(predicted or "")
    if not own or not others:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        count = lambda t: Counter(t[i : i + n] for i in range(len(t) - n + 1))  # noqa: B023, E731
        most: Counter[str] = Counter()
        for r in others:
            most |= count(r)
        mine = count(own)
        hits = sum((mine & most).values())
        if not hits:
            return 0.0
        logs += math.log(hits / sum(mine.values())) / 4
    nearest = min((abs(len(r) - len(own)), len(r)) for r in others)[1]
    return math.exp(min(0.0, 1 - nearest / len(own)) + logs)


def char_bleus(predicted: Column, references: Column) -> Column:
    """char_bleu() of each value of an array."""

    def run(values: pd.Series, golds: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else [_bleu(x, [] if g is None else list(g)) for x in v] for v, g in zip(values, golds, strict=True)], dtype=object)

    return F.pandas_udf(run, "array<double>")(predicted, references)


def char_bleu(predicted: Column, references: Column) -> Column:
    """BLEU over characters but spaces, up to 4-grams, against an array of references, from 0 to 1: clipped precisions without smoothing (0 if one is 0),
    brevity against the reference nearest in length. A null value gives 0."""
    return F.get(char_bleus(F.array(predicted), references), F.lit(0))


def parse_statements(line: Column) -> Column:
    """(subj, prop, val) triples of the form with a statement for each fact (statements()); a statement without an object gives the value NULL."""
    def one(part: Column) -> Column:
        subject, prop = F.regexp_extract(part, "^\\s*:?(\\S+)", 1), F.regexp_extract(part, "^\\s*:?\\S+\\s+:?([^\\s:\"]+)", 1)
        value = F.trim(F.regexp_replace(part, "^\\s*:?\\S+\\s+:?[^\\s:\"]+\\s*", ""))
        literal = F.regexp_extract(value, '^"([^"]*)"', 1)
        val = F.when(value == "", F.lit("NULL")).when(value.startswith('"'), literal).when(prop == "a", F.regexp_replace(value, "^:", "")).otherwise(value)
        return F.struct(subject.alias("subj"), F.when(prop == "a", F.lit("type")).otherwise(prop).alias("prop"), val.alias("val"))

    pieces = F.filter(F.split(F.regexp_replace(F.trim(line), "\\s*\\.\\s*$", ""), "\\s+\\.\\s+"), lambda x: F.trim(x) != "")
    return F.coalesce(F.filter(F.transform(pieces, one), lambda t: t["prop"] != ""), F.array().cast(TRIPLES))


def accepted_after_decoding(line: Column, times: int = 2, grammar: Grammar = LIGHT) -> Column:
    """Whether the line, or what up to `times` percent-decodings make of it, is in the grammar; characters beyond ASCII don't count."""
    found, text = accepted(ascii_only(line), grammar), line
    for _ in range(times):
        text = decode_uri(text)
        found = found | accepted(ascii_only(text), grammar)
    return found


def from_typed_tokens(text: Column) -> Column:
    """`<triplet> head <type> tail <type> relation`, in which tags like <per> or <loc> name the types: (subj, subj_type, prop, val, val_type) rows."""
    pieces = F.split(text, "<triplet>")

    def one(chunk: Column) -> Column:
        tags = F.regexp_extract_all(chunk, F.lit("<([a-z]+)>"), F.lit(1))
        words = F.transform(F.split(chunk, "<[a-z]+>"), lambda x: F.trim(x))
        rest = F.sequence(F.lit(0), F.floor((F.size(tags) - 2) / 2).cast("int"))
        each = F.transform(rest, lambda i: F.struct(F.get(words, F.lit(0)).alias("subj"), F.get(tags, F.lit(0)).alias("subj_type"), F.get(words, 2 * i + 2).alias("prop"), F.get(words, 2 * i + 1).alias("val"), F.get(tags, 2 * i + 1).alias("val_type")))
        return F.when(F.size(tags) >= 2, each).otherwise(F.array().cast("array<struct<subj:string,subj_type:string,prop:string,val:string,val_type:string>>"))

    return F.flatten(F.transform(F.slice(pieces, 2, F.size(pieces)), one))
