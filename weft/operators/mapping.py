"""Foreign extractions and records brought to a shape's properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators.graph import of_class

#: Relations of a generic extractor and the properties that they stand for.
RELATIONS = {"place of birth": "birthPlace", "place of death": "deathPlace", "country of citizenship": "nationality", "date of birth": "birthDate", "date of death": "deathDate"}


def map_relations(triples: DataFrame, relations: dict[str, str] = RELATIONS, key: str = "ex") -> DataFrame:
    """(key, subj, prop, val) from extracted (key, subj, rel, obj). Dates give the date and the year; a place that has a country in the same
    example gives the country too. Names are decoded with _ for spaces; relations without a property are left out; no repeats."""
    name = lambda c: text.decode_uri(F.replace(c, F.lit(" "), F.lit("_")))
    pairs = F.create_map(*[F.lit(x) for kv in relations.items() for x in kv])
    rows = triples.select(key, name(F.col("subj")).alias("subj"), F.col("rel"), F.col("obj"), F.element_at(pairs, F.col("rel")).alias("prop"))
    fact = lambda p, v: F.struct(p.alias("prop"), v.alias("val"))
    day = F.get(text.dates_in(F.replace("obj", F.lit("_"), F.lit(" "))), F.lit(0))
    dated = rows.where(F.col("prop").contains("Date")).withColumn("day", day).where("day IS NOT NULL")
    dated = dated.select(key, "subj", F.inline(F.array(fact(F.col("prop"), F.col("day")), fact(F.replace("prop", F.lit("Date"), F.lit("Year")), F.substring("day", 1, 4)))))
    placed = rows.where(~F.col("prop").contains("Date")).select(key, "subj", "prop", name(F.col("obj")).alias("val"))
    country = rows.where(F.col("rel") == "country").select(key, F.col("subj").alias("val"), name(F.col("obj")).alias("of"))
    hop = placed.join(country, [key, "val"]).select(key, "subj", "prop", F.col("of").alias("val"))
    return dated.unionByName(placed).unionByName(hop).distinct()


def import_attributes(records: DataFrame, dates: dict[str, str], places: dict[str, str], quads: DataFrame, cls: str, key: str = "s") -> DataFrame:
    """(s, p, o) from records with a map column attrs. A date attribute counts only if its text holds exactly one date; of a place attribute what stands
    before the first comma, if the graph has an entity of class cls under that label."""
    parts = lambda kinds: F.array(*[F.struct(F.lit(p).alias("p"), F.element_at("attrs", a).alias("t")) for a, p in kinds.items()])
    found = records.select(F.col(key).alias("s"), F.inline(parts(dates))).withColumn("d", text.dates_in(F.col("t")))
    days = found.where(F.size("d") == 1).select("s", "p", F.get("d", F.lit(0)).alias("o"))
    known = quads.where(F.col("p") == "label").select("s", "o").join(of_class(quads, cls), "s", "left_semi").select("o").distinct()
    named = records.select(F.col(key).alias("s"), F.inline(parts(places))).select("s", "p", F.trim(F.substring_index("t", ",", 1)).alias("o"))
    return days.unionByName(named.join(known, "o", "left_semi").select("s", "p", "o"))
