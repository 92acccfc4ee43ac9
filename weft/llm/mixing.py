"""Mixing sources to target weights by sampling blocks of tokens.

The words of each source stand one after another (by bucket of the hash of id and text, then that hash) and are cut into
blocks of block_len words; a block may hold the end of one document and the start of the next. The mix is
a fixed number of output shards of equally many slots. For each shard the counts of its slots by source are
drawn from the multinomial law, given what each source still has to give (so that the counts of all
shards add up to the targets). The slots of a source are numbered through all shards; slot k takes the
block that a pseudorandom permutation of the source's block numbers gives k, starting again with
another permutation when all are used up. Slots and blocks are joined on (source, block).

A target above cap times its source's size is cut to that, and the excess is shared by weight among the
others until none is above. As no block is taken more than cap times, no document is either.

Nulls: a null text has no words; null sources form one source that sorts last; ids may be null.
Repeated rows are rows of their own. Sources without words get target 0. An empty table gives no rows.
All draws depend on the seed, the ids and the texts, not on how the table is split: reruns agree. Rows equal in id,
source and text share a bucket; which of them is taken from is left open, as they are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weft.llm.base import materialize
from weft.llm.hashing import mix

BLOCK_LEN, N_SHARDS, SEED, CAP = 32, 64, 7, 2
#: Rows for each bucket in which the places of a source's documents are added up, and buckets whose sums are added up at once.
BUCKET_ROWS, SUMS = 1_000, 1_000
#: Rounds of the permutation.
ROUNDS = 4
#: One copy of a document, in the units in which copies are added up.
COPY = 1 << 20


def n_words(text: Column) -> Column:
    """The number of runs without whitespace."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of total by weight, none above cap times its size."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in over]
    return out


def draw(slots: list[int], n_shards: int = N_SHARDS, seed: int = SEED) -> np.ndarray:
    """Counts of slots by output shard and source. Each shard's are multinomial in the slots that the sources have left, given that no source gives more than it has."""
    left, rng, rows = np.array(slots, np.int64), np.random.Generator(np.random.PCG64(seed)), []
    for i in range(n_shards):
        n, got = int(left.sum()) // (n_shards - i), np.zeros_like(left)
        while (more := n - int(got.sum())) > 0:
            rest = left - got
            got += np.minimum(rng.multinomial(more, rest / rest.sum()), rest)
        rows.append(got)
        left = left - got
    return np.array(rows, np.int64).reshape(n_shards, len(slots))


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: a Feistel network over the next power of four, walked until it is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        h, m, y = half[todo], mask[todo], x[todo]
        left, right = y >> h, y & m
        for i in range(ROUNDS):
            left, right = right, left ^ (mix(right * np.uint64(2 * ROUNDS) + np.uint64(i) + mix(key[todo])) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def place(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: doc_id, source, size, the hash h of id and text, and the row's number rid; written to the shared folder."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(id_col, text).alias("h"))
    return materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "sizes")


def row_key(id_col: str = "doc_id", text: str = "text", source: str = "source") -> Column:
    """A hash of a document's source, id and text."""
    return F.xxhash64(source, F.xxhash64(id_col, text))


def pieces(rows: DataFrame, n_buckets: int, block_len: int) -> DataFrame:
    """The words of each row by block of its source: rid, ix, block, words. rows: rid, ix, doc_id, size, h."""
    rows = rows.where(F.col("size") > 0).withColumn("b", F.pmod("h", F.lit(n_buckets)))
    sums = rows.groupBy("ix", "b").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("bb", F.expr(f"b div {SUMS}"))
    above = sums.groupBy("ix", "bb").agg(F.sum("n").alias("n"))
    above = above.select("ix", "bb", (F.sum("n").over(W.Window.partitionBy("ix").orderBy("bb")) - F.col("n")).alias("above"))
    within = sums.select("ix", "bb", "b", (F.sum("n").over(W.Window.partitionBy("ix", "bb").orderBy("b")) - F.col("n")).alias("base"))
    base = within.join(above, ["ix", "bb"]).select("ix", "b", (F.col("above") + F.col("base")).alias("base"))
    own = W.Window.partitionBy("ix", "b").orderBy("h", "doc_id", "size", "rid")
    start = F.col("base") + F.sum("size").over(own) - F.col("size")
    at = rows.join(base, ["ix", "b"]).select("rid", "ix", "size", start.alias("start"))
    n = F.lit(block_len)
    first, last = F.expr(f"start div {block_len}"), F.expr(f"(start + size - 1) div {block_len}")
    each = at.select("rid", "ix", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * n) - F.greatest(F.col("start"), F.col("block") * n)
    return each.select("rid", "ix", "block", words.alias("words"))


def plan_slots(spark: SparkSession, n_blocks: list[int], counts: np.ndarray, seed: int = SEED) -> DataFrame:
    """One row for each slot of each output shard: shard, ix (of the source), slot (of the source) and the block that it takes."""
    begin = np.concatenate([[0], np.cumsum(counts.sum(0))])
    shard_end = np.cumsum(counts, axis=0)  # by shard, within each source
    blocks = np.array(n_blocks, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy()
            ix = np.searchsorted(begin, x, "right") - 1
            slot = x - begin[ix]
            shard = np.zeros(len(x), np.int32)
            for i in np.unique(ix):
                of = ix == i
                shard[of] = np.searchsorted(shard_end[:, i], slot[of], "right")
            n = blocks[ix]
            key = ((slot // n) * len(blocks) + ix).astype(np.uint64) + (np.uint64(seed) << np.uint64(40))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ix.astype(np.int32)), pa.array(slot), pa.array(permute(slot % n, n, key))], ["shard", "ix", "slot", "block"])

    return spark.range(0, int(begin[-1])).mapInArrow(run, "shard int, ix int, slot long, block long")


class Mix:
    """A drawn mix. rows: doc_id, source, size, rid, ix, source_size, target of every document; slots and blocks: the two sides of the join."""

    def __init__(self, docs: DataFrame, share: float, weights: tuple[float, ...], block_len: int = BLOCK_LEN, n_shards: int = N_SHARDS, cap: int = CAP, seed: int = SEED, **columns):
        spark = docs.sparkSession
        rows = place(docs, **columns)
        by = rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()  # a row for each source
        by.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [r.s for r in by]
        self.targets = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(by))], share * sum(sizes), cap)
        n_blocks = [-(-s // block_len) for s in sizes]
        slots = [round(t * b / s) if s else 0 for t, b, s in zip(self.targets, n_blocks, sizes, strict=True)]
        self.counts = draw(slots, n_shards, seed) if by else np.zeros((n_shards, 0), np.int64)
        about = spark.createDataFrame([(r.source, i, r.s, t) for i, (r, t) in enumerate(zip(by, self.targets, strict=True))], "source string, ix int, source_size long, target double")
        self.rows = rows.join(F.broadcast(about), rows.source.eqNullSafe(about.source)).drop(about.source)
        self.seed, self.n_buckets = seed, max(1, sum(r.n for r in by) // BUCKET_ROWS)
        self.blocks = pieces(self.rows, self.n_buckets, block_len)
        self.slots = plan_slots(spark, n_blocks, self.counts, seed)

    def taken(self) -> DataFrame:
        """rows, with taken: the words that the mix takes of each."""
        drawn = self.slots.join(self.blocks, ["ix", "block"])
        by = drawn.groupBy("rid").agg(F.sum("words").alias("taken"))
        return self.rows.join(by, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))

    def copies(self) -> DataFrame:
        """The mix in whole documents: key (that of row_key()) and copies, for rows with words. A document of which the mix takes x times its words
        gets floor(x) or floor(x) + 1 copies, x on average: the fractions are added up in each bucket of a source, in the order of size and
        from a start drawn by the seed, and a document gets one more copy when the sum passes a whole number in it."""
        by = self.taken().where("size > 0").groupBy("source", "ix", "h").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
        by = by.select("source", "ix", "h", "s", F.pmod("h", F.lit(self.n_buckets)).alias("b"), F.expr(f"t * {COPY} div s").alias("x"))
        own = W.Window.partitionBy("ix", "b").orderBy("s", "h").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
        part = F.col("x") % COPY
        start = F.pmod(F.xxhash64(F.lit(self.seed), "ix", "b"), F.lit(COPY))
        ends = by.select("source", "h", "x", part.alias("part"), (start + F.sum(part).over(own)).alias("end"))
        return ends.select(F.xxhash64("source", "h").alias("key"), F.expr(f"int(x div {COPY} + end div {COPY} - (end - part) div {COPY})").alias("copies"))
