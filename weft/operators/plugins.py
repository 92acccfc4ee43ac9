"""Where callers put their own models: scorers of facts and extractors of facts, with plain stand-ins that need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (entity, property, value, text) to a score from 0 to 1; a pandas_udf over four columns fits.
Scorer = Callable[[Column, Column, Column, Column], Column]
#: Batches of (s, text) to batches of (s, line), a linearised graph a row; for mapInPandas.
Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))


def overlap(entity: Column, prop: Column, value: Column, text: Column) -> Column:
    """Stand-in scorer: the share of the value's words that the text holds; 0 without words or text."""
    wanted = words(value)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, words(text))), F.size(wanted)), F.lit(0.0))


def score(facts: DataFrame, texts: DataFrame, scorer: Scorer = overlap, name: str = "score", least: float = 0.0) -> DataFrame:
    """Facts (s, p, o) with the score that their entity's text (s, text) gives them; 0 without a text and where it does not exceed least."""
    given = F.coalesce(scorer(F.col("s"), F.col("p"), F.col("o"), F.col("text")).cast("double"), F.lit(0.0))
    return facts.join(texts.select("s", "text"), "s", "left").withColumn(name, F.when(given > least, given).otherwise(0.0)).drop("text")


def extract(texts: DataFrame, extractor: Extractor) -> DataFrame:
    """What a caller's extractor says of each text (s, text): rows (s, line)."""
    return texts.select("s", "text").mapInPandas(extractor, "s string, line string")


def extract_by_rules(texts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Stand-in extractor: facts (s, p, o), o being each distinct first group of the property's pattern in the text (s, text)."""
    def facts(p: str, pattern: str) -> Column:
        values = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
        return F.transform(values, lambda v: F.struct(F.lit(p).alias("p"), v.alias("o")))

    return texts.where("text IS NOT NULL").select("s", F.inline(F.concat(*[facts(*r) for r in rules.items()])))
