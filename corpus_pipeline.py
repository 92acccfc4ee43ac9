"""From raw documents to shards of a training mix: five stages, each one an operator of weft.llm.

Every stage takes the documents that the one before kept and returns rows with the columns of documents, but for the last, which
says where each document goes. Decisions are made for rows, not for ids: the operators get a key of id and text in the place of the id, so rows that
share an id, or have none, are judged by their own texts. Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontaminate, jaccard, langid, mixing, shards
from weft.llm.base import discard, load, materialize

N_SHARDS, SHARE, WEIGHTS = 40, 1.5, (5.0, 2.0, 1.0)
#: Keys up to which a list of decisions is broadcast (16 bytes each); beyond that it is joined by shuffle.
MAX_BROADCAST = 1_000_000
KEY = "key"


def _small(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder, and broadcast if it has few rows."""
    df = materialize(df, name)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """docs with columns c0, c1, ... and a key of id and text; where each column stands, and the columns under their own names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    return plain.withColumn(KEY, F.xxhash64(at["doc_id"], at["text"])), at, [F.col(c).alias(n) for n, c in at.items()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly."""
    plain, at, own = _plain(docs)
    model = langid.fit(docs)
    told = langid.predict(plain, model, id_col=at["doc_id"], text=at["text"], keep=tuple(c for c in at.values() if c != at["doc_id"]))
    return told.where(~F.col("rejected")).select(*own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row: that with the smallest id (null last), then with the smallest key, then any of those that are equal in id and text."""
    keyed, at, own = _plain(docs)
    classes = jaccard.join(keyed, doc_id=KEY, text=at["text"]).select(F.col("doc_id").alias(KEY), "class_id").distinct()
    about = materialize(classes.join(keyed.select(KEY, F.col(at["doc_id"]).alias("id")).distinct(), KEY), "classes")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", KEY))
    winners = _small(about.groupBy("class_id").agg(first.alias("w"), F.count("*").alias("n")).where("n > 1").select("class_id", F.col(f"w.{KEY}").alias("winner")), "winners")
    losers = _small(about.join(winners, "class_id").where(F.col(KEY) != F.col("winner")).select(KEY).distinct(), "losers")
    again = _small(keyed.groupBy(KEY).count().where("count > 1").select(KEY), "repeated")
    kept = keyed.join(losers, KEY, "left_anti")
    row = F.struct(*at.values())
    once = kept.join(again, KEY, "left_semi").groupBy(KEY).agg(F.min_by(row, F.xxhash64(*at.values())).alias("r")).select("r.*")
    return kept.join(again, KEY, "left_anti").select(*at.values()).unionByName(once).select(*own)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed, at, own = _plain(docs)
    found = decontaminate.leaks(keyed, load(spark, sf_dir, "benchmark"), doc_id=KEY, text=at["text"])
    leaked = _small(found.select(F.col("doc_id").alias(KEY)).distinct(), "leaked")
    return keyed.join(leaked, KEY, "left_anti").select(*own)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded up or down so that the words of each source stay at its target."""
    plain, at, own = _plain(docs)
    named = {"id_col": at["doc_id"], "text": at["text"], "source": at["source"]}
    copies = _small(mixing.Mix(plain, SHARE, WEIGHTS, **named).copies().where("copies > 0").select(F.col("key").alias("of"), "copies"), "copies")
    joined = plain.withColumn("of", mixing.row_key(**named)).join(copies, "of")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*own)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the slot of each document."""
    return shards.kd_shards(docs, N_SHARDS).select("doc_id", "size", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]
#: Compression, hashing and pseudorandom draws have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, was = load(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
            if was is not None:
                discard(was)
            was = docs
    return docs
