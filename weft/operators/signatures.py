"""Property frequencies and property signatures (the exact set of properties that an entity realises)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def property_frequency(facts: DataFrame, entity: str = "s", prop: str = "p") -> DataFrame:
    """Per property: entities that realise it, and their share of all entities. One pass: each entity's set of properties, with a mark that counts the entities."""
    own = facts.groupBy(entity).agg(F.collect_set(prop).alias("ps"))
    counts = own.select(F.explode(F.concat("ps", F.array(F.lit(None).cast("string")))).alias("p")).groupBy("p").agg(F.count("*").alias("nb"))
    whole = counts.agg(F.collect_list(F.struct("p", "nb")).alias("each"), F.max(F.when(F.col("p").isNull(), F.col("nb"))).alias("total"))  # a shape's properties are few
    return whole.select("total", F.inline("each")).where("p IS NOT NULL").select("p", "nb", F.round(F.col("nb") / F.col("total"), 6).alias("freq"))


def entity_signatures(facts: DataFrame, entities: DataFrame | None = None, entity: str = "s", prop: str = "p") -> DataFrame:
    """Per entity its sorted property set; entities without facts have the empty one if a table of entities is given. One shuffle by entity."""
    own = facts.groupBy(entity).agg(F.array_sort(F.collect_set(prop)).alias("sig"))
    if entities is None:
        return own
    return entities.join(own, entity, "left").select(entity, F.coalesce("sig", F.array().cast("array<string>")).alias("sig"))


def signature_counts(signatures: DataFrame) -> DataFrame:
    """Per signature (as text): entities, their share, and the number of properties."""
    by = signatures.groupBy(F.array_join("sig", ",").alias("signature")).agg(F.count("*").alias("nb"), F.first(F.size("sig")).alias("n_props"))
    total = by.agg(F.sum("nb").alias("total"))
    return by.join(F.broadcast(total)).select("signature", "nb", "n_props", F.round(F.col("nb") / F.col("total"), 6).alias("freq"))


def cumulative(counts: DataFrame) -> DataFrame:
    """In descending order of count, then of signature: the running share, and one minus it. Signatures are placed among those of their own count; what stands before is
    added up over the different counts, which are few (their number grows with the square root of the entities')."""
    by = counts.groupBy("nb").agg(F.sum("nb").alias("__n"))
    above = by.select("nb", (F.sum("__n").over(W.Window.orderBy(F.col("nb").desc())) - F.col("__n")).alias("__above"), F.sum("__n").over(W.Window.partitionBy()).alias("__all"))
    place = F.row_number().over(W.Window.partitionBy("nb").orderBy("signature"))
    run = (F.col("__above") + F.col("__place") * F.col("nb")) / F.col("__all")
    return counts.withColumn("__place", place).join(above, "nb").select("signature", "nb", F.round(run, 6).alias("freq_cumul"), F.round(1 - run, 6).alias("inv_freq_cumul"))


def power_set(signatures: DataFrame, props: list[str], include_full: bool = True) -> DataFrame:
    """All signatures over up to 16 properties as bit masks, with the entities of each; 0 where none has it."""
    if len(props) > 16:
        raise ValueError("more than 16 properties")
    mask = sum((F.when(F.array_contains("sig", p), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(props)), F.lit(0))
    by = signatures.groupBy(mask.alias("mask")).agg(F.count("*").alias("nb"))
    every = signatures.sparkSession.range(0, (1 << len(props)) - (not include_full)).select(F.col("id").cast("int").alias("mask"))
    return every.join(by, "mask", "left").select("mask", F.bit_count("mask").alias("n_props"), F.coalesce("nb", F.lit(0)).alias("nb"))


def one_hot(signatures: DataFrame, props: list[str]) -> DataFrame:
    """Signature counts with a 0/1 column for each property."""
    flags = [F.array_contains("sig", p).cast("int").alias(p) for p in props]
    return signatures.select(*flags).groupBy(*props).agg(F.count("*").alias("nb"))


def prune_properties(facts: DataFrame, least: int, members: DataFrame | None = None) -> DataFrame:
    """Properties of a shape worth keeping: used by `least` entities at least, of the class's members (s) if those are given."""
    scoped = facts if members is None else facts.join(members.select("s").distinct(), "s", "left_semi")
    return property_frequency(scoped).where(F.col("nb") >= least).select("p", "nb")


def sampled_patterns(signatures: DataFrame, sample: DataFrame, entity: str = "s") -> DataFrame:
    """signature_counts() of the entities of a sample."""
    return signature_counts(signatures.join(sample.select(entity).distinct(), entity, "left_semi"))


def tallies(facts: DataFrame, entity: str = "s", prop: str = "p", first_is_zero: bool = False) -> DataFrame:
    """Properties by rarity, the rarest first (place), and signatures alike: kind (property or pattern), name, nb. first_is_zero: the first sighting of a name doesn't count."""
    own = entity_signatures(facts, None, entity, prop)
    each = own.select(F.inline(F.concat(F.transform("sig", lambda p: F.struct(F.lit("property").alias("kind"), p.alias("name"))), F.array(F.struct(F.lit("pattern").alias("kind"), F.array_join("sig", ",").alias("name"))))))
    by = each.groupBy("kind", "name").agg((F.count("*") - int(first_is_zero)).alias("nb"))
    return by.withColumn("place", F.row_number().over(W.Window.partitionBy("kind").orderBy("nb", "name")))


def property_numbers(facts: DataFrame, entity: str = "s", prop: str = "p", cls: str | None = None) -> DataFrame:
    """Per entity (of a class, if one is named) the number of its different properties; an entity that isn't there has no row."""
    known = facts if cls is None else facts.join(facts.where((F.col(prop) == "rdf:type") & (F.col("o") == cls)).select(entity).distinct(), entity, "left_semi")
    return known.groupBy(entity).agg(F.count_distinct(prop).alias("n_props"))
