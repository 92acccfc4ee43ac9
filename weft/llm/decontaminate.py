"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

A benchmark item leaks into a document that holds at least the share ``threshold`` of the item's shingles (five
consecutive words). Items are short and documents long, so their Jaccard similarity is tiny and falls with the document's size: an item of q shingles
whose share t stands in a document of up to u has a similarity of t * q / (u + q - t * q) only. So both sides are partitioned by
size (powers of two), and the number of MinHash values is set for each pair of partitions.

1. Sketch. The hash space is cut into bins; a document's MinHash values are the least hash of each bin (one-permutation MinHash), each a band of its
   own. With u / b shingles to a bin, a shared shingle is its bin's least with probability p(u / b) = (1 - exp(-u / b)) / (u / b). Each pair of partitions gets the
   least power of two of bins with which a document at the threshold shows none of the ceil(t * q) shared ones with probability MISS at most. The values for larger
   items are among those for smaller ones; each is sent once, with the largest items' partition that it serves.
2. Search. Items are indexed by all their shingles; a document is a candidate for an item when one of its values is among them.
3. Verification. Of the candidate pairs, the shared shingles are counted exactly.

Words are lower-case runs of characters that are no ASCII punctuation, whitespace or control character; a
shingle is known by the 64-bit hash of its five words. Items of fewer than five words have no
shingle and never leak; null and empty texts have none either. Rows that share a document's or an item's id count
as one with the larger share. Empty tables give no rows. Columns beside id and text are ignored.

The items' shingles and the candidate pairs are broadcast while they have up to MAX_BROADCAST rows; beyond that the joins shuffle: keys and hashes in the
search, the texts once for the verification.
"""

from __future__ import annotations

from math import ceil, exp, floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.base import materialize

SHINGLE_WORDS, THRESHOLD, MISS = 5, 0.8, 1e-4
MAX_BROADCAST = 1_000_000
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def shingle_hashes(words: Column, n: int = SHINGLE_WORDS) -> Column:
    """The hash of each n consecutive words, in order and with repeats; none if there are fewer words."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))
    return F.when(F.size(words) >= n, each).otherwise(F.array().cast("array<long>"))


def load_bits(q: int, threshold: float, miss: float = MISS) -> int:
    """The binary logarithm of the shingles that a bin may hold, for items of q shingles or more."""
    shared = ceil(threshold * q - 1e-9)
    shown = 1 - miss ** (1 / shared)  # what p has to be
    low, high = 1e-12, 1e12  # p falls from 1 to 0
    for _ in range(200):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if -(exp(-middle) - 1) / middle >= shown else (low, middle)
    return floor(log2(low))


def bin_shift(size: Column, load: int) -> Column:
    """What a hash (without its last bit) is shifted by to give its bin, when a bin holds 2^load hashes at most on average in documents as large as their partition allows."""
    partition = F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    return F.lit(63) - F.greatest(F.lit(0), F.least(F.lit(62), partition - F.lit(load)))


def sketch(hashes: Column, shift: Column) -> Column:
    """The least of each bin, of sorted distinct hashes."""
    place = lambda h: F.call_function("shiftrightunsigned", F.shiftrightunsigned(h, 1), shift)
    return F.filter(hashes, lambda h, i: (i == 0) | (place(h) != place(F.get(hashes, i - 1))))


def _small(df: DataFrame, name: str) -> DataFrame:
    df = materialize(df, name)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """Per document and item that leaks into it: doc_id, item_id, n_shared, n_shingles, containment."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).withColumn("doc", F.xxhash64("doc_id", "t"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).withColumn("item", F.xxhash64("item_id", "t"))
    worded = lambda df, *keep: df.select(*keep, word_array(F.col("t")).alias("words"))  # noqa: E731  a step of its own: a lambda must not cut the text for each shingle
    hashes = F.sort_array(F.array_distinct(shingle_hashes(F.col("words"))))

    wanted = worded(items, "item_id", "item").select("item_id", "item", hashes.alias("hashes")).withColumn("n", F.size("hashes")).where("n > 0").dropDuplicates(["item"])
    index = _small(wanted.select("item_id", "item", "n", F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("of"), F.explode("hashes").alias("h")), "items")
    partitions = sorted(r.of for r in index.select("of").distinct().collect())  # of item sizes: powers of two

    held = worded(docs, "doc").select("doc", hashes.alias("v"))
    held = held.select("doc", "v", *[bin_shift(F.size("v"), load_bits(1 << i, threshold)).alias(f"shift{i}") for i in partitions])
    before = "v"
    for i in partitions:  # larger items need fewer bins, and the least of a bin is the least of a smaller one within it
        held = held.select("*", sketch(F.col(before), F.col(f"shift{i}")).alias(f"v{i}"))
        before = f"v{i}"
    each = [F.struct(F.lit(i).alias("level"), (F.array_except(f"v{i}", f"v{j}") if j else F.col(f"v{i}")).alias("values")) for i, j in zip(partitions, [*partitions[1:], 0])]
    sketches = F.array(*each) if each else F.array().cast("array<struct<level: int, values: array<long>>>")
    values = held.select("doc", F.inline(sketches)).select("doc", "level", F.explode("values").alias("h"))
    pairs = _small(values.join(index.select("of", "h", "item"), "h").where("of <= level").select("doc", "item").distinct(), "candidates")

    of_pairs = worded(docs.join(pairs, "doc"), "doc_id", "doc", "item").select("doc_id", "doc", "item", hashes.alias("hashes"))
    each = of_pairs.select("doc_id", "doc", "item", F.explode(F.concat("hashes", F.array().cast("array<long>"))).alias("h"))  # concat() keeps the optimizer from deriving a filter that would compute the hashes twice
    shared = each.join(index.select("item_id", "item", "n", "h"), ["item", "h"]).groupBy("doc_id", "doc", "item_id", "item", "n").agg(F.count_distinct("h").alias("shared"))
    good = shared.where(F.col("shared") >= F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("containment"), "shared", "n")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.shared").cast("long").alias("n_shared"), F.col("b.n").cast("long").alias("n_shingles"), F.col("b.containment").alias("containment"))
