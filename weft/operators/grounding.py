"""Grounding: is the value of a fact expressed in a text? Native CASE expressions, after an equi-join on the entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.matching import replace_each
from weft.functions.text import dates_in, folds_into
from weft.sources.scratch import settle

#: Candidate pairs up to which they are broadcast to the texts; beyond that both are joined by shuffle.
MAX_BROADCAST = 100_000


def contains_ci(text: Column, value: Column) -> Column:
    return F.contains(F.lower(text), F.lower(value))


def in_text(value: Column, kind: Column, prop: Column, text: Column) -> Column:
    """Years as substrings, dates among the dates of the text, labels by all their words, strings but for case and accents; numbers never."""
    words = F.filter(F.split(F.lower(value), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    label = F.forall(words, lambda w: F.contains(F.lower(text), w))
    found = (
        F.when(kind.endswith("Year"), F.contains(text, value))
        .when(kind == "xsd:date", F.array_contains(dates_in(text), value))
        .when(prop == "label", label)
        .when(F.contains(kind, F.lit("string")), contains_ci(text, value) | folds_into(text, value))
        .otherwise(F.lit(False))
    )
    return F.coalesce((value != "") & found, F.lit(False))


def in_markdown(value: Column, md: Column) -> Column:
    """Objects: a link with the value as target."""
    return F.coalesce(F.contains(md, F.concat(F.lit("](:"), F.regexp_replace(value, "^:", ""), F.lit(")"))), F.lit(False))


def in_plain(value: Column, text: Column) -> Column:
    """Objects in plain text: _ as space, but for case."""
    return F.coalesce(contains_ci(text, F.replace(F.regexp_replace(value, "^:", ""), F.lit("_"), F.lit(" "))), F.lit(False))


def wikicheck(facts: DataFrame, texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """Facts (s, p, o) of shape properties (p, range) that the text of their entity (s, text and perhaps md, its markdown) expresses. Objects (a range that is
    neither a datatype nor text) count as found where the markdown links to them, or without markdown where the text has their name. The shape is
    broadcast; facts and texts meet on the entity."""
    typed = facts.join(F.broadcast(kinds), "p")
    is_object = ~F.col("range").startswith("xsd:") & ~F.col("range").startswith("rdf:")
    linked = in_markdown(F.col("o"), F.col("md")) if "md" in texts.columns else in_plain(F.col("o"), F.col("text"))
    found = F.when(is_object, linked).otherwise(in_text(F.col("o"), F.col("range"), F.col("p"), F.col("text")))
    return typed.join(texts, "s").withColumn("found", found).select("s", "p", "o", "found")


def in_plain_text(facts: DataFrame, texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """wikicheck() against plain text only, for any property: one without a range is found where the text contains its value but for case."""
    typed = facts.join(F.broadcast(kinds), "p", "left")
    is_object = F.col("o").startswith(":") | (~F.col("range").startswith("xsd:") & ~F.col("range").startswith("rdf:"))
    known = F.when(is_object, in_plain(F.col("o"), F.col("text"))).otherwise(in_text(F.col("o"), F.col("range"), F.col("p"), F.col("text")))
    loose = F.coalesce(contains_ci(F.col("text"), F.col("o")), F.lit(False))
    found = F.when(F.col("range").isNull() & ~F.col("o").startswith(":"), loose).otherwise(known)
    return typed.join(texts, "s").withColumn("found", found).select("s", "p", "o", "found")


def rate(checked: DataFrame, entity: str = "s") -> DataFrame:
    """Per entity the percentage of its facts that are found; type facts don't count."""
    by = checked.where(F.col("p") != "rdf:type").groupBy(entity).agg(F.count("*").alias("n"), F.count_if("found").alias("n_found"))
    return by.select(entity, "n", "n_found", F.round(100 * F.col("n_found") / F.col("n"), 2).alias("rate"))


def contained(values: DataFrame, texts: DataFrame, key: str = "s", n: int = 5, chars: int = 4) -> DataFrame:
    """(value id, text key) where the text contains the value, entity unknown. The pairs meet on what a text must hold whole if it contains the value: the words
    after the value's first one, n at most and without its last; of a value of one or two words, its first characters. These keys alone are
    joined; then the substring test decides on the candidates' texts."""
    v = values.where(F.col("value") != "").withColumn("w", F.split("value", "\\s+")).withColumn("words", F.least(F.lit(n), F.size("w") - 2))
    v = v.withColumn("m", F.when(F.col("words") > 0, F.col("words")).otherwise(-F.least(F.lit(chars), F.length("value"))))
    v = v.withColumn("h", F.when(F.col("m") > 0, F.xxhash64(F.slice("w", 2, F.greatest("m", F.lit(0))))).otherwise(F.xxhash64(F.substring("value", F.lit(1), F.greatest(-F.col("m"), F.lit(0))))))
    sizes = [r.m for r in v.select("m").distinct().collect()]  # n + chars at most
    t = texts.select(F.col(key).alias("t_key"), "text").where("text IS NOT NULL").withColumn("t_id", F.xxhash64("t_key", "text"))

    def grams(m: int) -> Column:
        first = F.when(F.size("w") >= m, F.sequence(F.lit(0), F.size("w") - m)) if m > 0 else F.when(F.length("text") >= -m, F.sequence(F.lit(0), F.length("text") + m))
        each = (lambda i: F.xxhash64(F.slice("w", i + 1, m))) if m > 0 else (lambda i: F.xxhash64(F.substring("text", i + 1, F.lit(-m))))
        return F.struct(F.lit(m).alias("m"), F.coalesce(F.array_distinct(F.transform(first, each)), F.array().cast("array<long>")).alias("hs"))

    if not sizes:
        return v.join(t, F.lit(False)).select("item", F.col("t_key").alias(key))
    held = t.withColumn("w", F.split("text", "\\s+")).select("t_id", F.inline(F.array(*[grams(m) for m in sorted(sizes)]))).select("t_id", "m", F.explode("hs").alias("h"))
    pairs = settle(held.join(v.select("item", "value", "m", "h"), ["m", "h"]).select("t_id", "item", "value").distinct())
    pairs = F.broadcast(pairs) if pairs.count() <= MAX_BROADCAST else pairs
    return t.join(pairs, "t_id").where(F.contains("text", "value")).select("item", F.col("t_key").alias(key)).distinct()


def tag(text: Column, values: Column, mask: str | None = None) -> Column:
    """Replaces values by $prop$ (or a mask) in one pass over the text: leftmost first, of those the longest, and never within what a replacement has put there. A value of several
    properties gets the least one; empty values and nulls are left out. values: array<struct<val, prop>>."""
    into = (lambda x: F.lit(mask)) if mask is not None else (lambda x: F.concat(F.lit("$"), x["prop"], F.lit("$")))
    ordered = F.array_sort(F.transform(values, lambda x: F.struct(x["val"].alias("val"), x["prop"].alias("prop"))))
    return replace_each(text, F.transform(ordered, lambda x: F.struct(x["val"].alias("find"), into(x).alias("put"))))


def fill(template: Column, values: Column) -> Column:
    """Puts values in the place of $prop$, in one pass: a value that looks like a placeholder stays as it is. Of several values of a property the first counts."""
    return replace_each(template, F.transform(values, lambda x: F.struct(F.concat(F.lit("$"), x["prop"], F.lit("$")).alias("find"), x["val"].alias("put"))))
