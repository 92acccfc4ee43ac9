"""Exact top-k inner products on a bit-sliced index.

Every attribute is quantised to an integer and stored as bit slices: slice j of attribute d is a bitmap that
has a bit for each row of an index block whose value has bit j set; the top slice is the sign (two's
complement). A query adds up slices with bitmap arithmetic: each of its components is a sum of signed powers of two
(non-adjacent form), each power adds or subtracts the attribute's slices shifted by it, and carry-save
adders bring three numbers to two with five bitmap operations for all slices at once; one ripple-carry
addition is left at the end. The k largest rows are then chosen from the most significant slice of the sum downward, as
bitmaps: rows sure to be in, and rows still tied. Rows tied on all slices are boundary rows; the smallest
ids among them fill what is left, so ties are exact.

The index is written as blocks of BLOCK_ROWS rows, the queries are packed into blocks of up to QUERY_ROWS. An index block
and a chunk of CHUNK query blocks meet in one group, which is bounded in size, whatever the table's; so a block is sent once for tens of thousands of queries (more
often only where there are fewer index blocks than tasks to keep busy). Of every pair of blocks only the best k are kept; a window by query merges them.

Vectors that are null, empty, or have null or non-finite components (or such that no 64-bit integer holds when scaled) take no part; vectors are compared with
those of their own length. Sums have as many slices as they need, so the order is exact at any size; a score that no 64-bit integer holds is told as the nearest one that does.
Repeated rows are candidates each, a query repeated with the same vector is asked
once, with another vector it is another query, and rows that share the query's id are not its candidates. With fewer than k candidates all are returned; an empty table gives
no rows. Columns beside the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weft.llm.base import materialize

BLOCK_ROWS, QUERY_ROWS = 16384, 4096
#: Query blocks to begin with, so that a small table is not searched in one task.
QUERY_BLOCKS = 32
#: Query blocks that meet an index block in one task.
CHUNK = 16


def quantise(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, null if the vector can take no part."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) >= F.lit(2.0**63)))
    return F.when(vector.isNotNull() & ~bad & (F.size(vector) > 0), F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def naf(value: int) -> list[tuple[int, int]]:
    """(power, sign) of the non-adjacent form."""
    out, p = [], 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            out.append((p, sign))
            value -= sign
        value >>= 1
        p += 1
    return out


def slices(values: np.ndarray, bits: int) -> np.ndarray:
    """(attributes, bits, words) bitmaps of a (rows, attributes) array."""
    n, d = values.shape
    out = np.zeros((d, bits, -(-n // 64)), np.uint64)
    for j in range(bits):
        packed = np.packbits(((values >> j) & 1).astype(np.uint8), axis=0, bitorder="little")
        raw = np.zeros((out.shape[2] * 8, d), np.uint8)
        raw[: len(packed)] = packed
        out[:, j] = np.ascontiguousarray(raw.T).view(np.uint64)
    return out


def add_up(query: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    """Bit slices (width, words) of the sum of query[d] * attribute d, modulo 2^width."""
    bits, words = index.shape[1:]
    total, carry, term, shared = (np.zeros((width, words), np.uint64) for _ in range(4))
    ones = 0
    for d, value in enumerate(query.tolist()):
        for power, sign in naf(value):
            # the attribute's slices from `power` up, its sign repeated above; subtracted as the complement plus one
            x = index[d]
            top = min(width, power + bits)
            if sign > 0:
                term[:power] = 0
                term[power:top] = x[: top - power]
                term[top:] = x[-1]
            else:
                term[:power] = ~np.uint64(0)
                np.invert(x[: top - power], out=term[power:top])
                term[top:] = ~x[-1]
                ones += 1
            np.bitwise_and(total, carry, out=shared)
            np.bitwise_xor(total, carry, out=total)
            np.bitwise_and(total, term, out=carry)
            np.bitwise_or(shared, carry, out=shared)
            np.bitwise_xor(total, term, out=total)
            carry[1:] = shared[:-1]
            carry[0] = 0
    for extra in (None, ones):  # the carries, then the ones that the complements lack
        c = np.zeros(words, np.uint64)
        for j in range(width):
            y = carry[j] if extra is None else np.full(words, ~np.uint64(0) if extra >> j & 1 else 0, np.uint64)
            both = total[j] ^ y
            c, total[j] = (total[j] & y) | (c & both), both ^ c
    return total


def select(total: np.ndarray, take: np.ndarray, k: int) -> np.ndarray:
    """The rows with the k largest values, of those in the bitmap take; the first rows of a tie at the boundary."""
    sure, tied = np.zeros_like(take), take.copy()
    left = k
    for j in range(len(total) - 1, -1, -1):
        high = tied & (~total[j] if j == len(total) - 1 else total[j])  # the top slice is the sign
        n = int(np.bitwise_count(high).sum())
        if n > left:
            tied = high
        else:
            sure |= high
            tied = tied & ~high
            left -= n
            if left == 0:
                return rows_of(sure)
    return np.concatenate([rows_of(sure), rows_of(tied)[:left]])


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def values_at(total: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The numbers that the slices hold for these rows; the nearest 64-bit ones."""
    bits = (total[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
    if len(total) > 64:
        exact = [sum((-b if j == len(total) - 1 else b) << j for j, b in enumerate(column)) for column in bits.T.tolist()]
        return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in exact], np.int64)
    weights = np.left_shift(np.int64(1), np.arange(len(total), dtype=np.int64))
    weights[-1] = -weights[-1]
    return (bits.astype(np.int64) * weights[:, None]).sum(0)


def _blocks(rows: DataFrame, size: int, sliced: bool, name: str) -> DataFrame:
    """Rows (block, n, dims, bits, ids, which, data), each of `size` vectors at most, in the order of their ids."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: np.ndarray, which: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(ids, kind="stable")
            ids, which, values = ids[order], which[order], values[order]
            for i in range(0, len(ids), size):
                v = values[i : i + size]
                bits = max(1, int(max(v.max(initial=0), -1 - v.min(initial=0))).bit_length()) + 1
                data = slices(v, bits) if sliced else v.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([len(v)], pa.int32()), pa.array([v.shape[1]], pa.int32()), pa.array([bits], pa.int32()), pa.array([ids[i : i + size].tobytes()], pa.binary()), pa.array([which[i : i + size].tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["n", "dims", "bits", "ids", "which", "data"])

        held: dict[int, list] = {}
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            ids, which, ends = batch.column(0).to_numpy(), batch.column(2).to_numpy(), np.cumsum(lengths)
            for n in np.unique(lengths):
                of = np.flatnonzero(lengths == n)
                at = (ends[of] - n)[:, None] + np.arange(n)
                held.setdefault(int(n), []).append((ids[of], which[of], flat[at].astype(np.int64)))
            for n, parts in held.items():
                if sum(len(p[0]) for p in parts) >= 4 * size:
                    yield from out(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                    held[n] = []
        for parts in held.values():
            if parts:
                yield from out(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    made = rows.select("id", "q", F.xxhash64("q").alias("which")).mapInArrow(build, "n int, dims int, bits int, ids binary, which binary, data binary")
    return materialize(made.withColumn("uid", F.monotonically_increasing_id()), name)


def _numbered(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks numbered from 0; there is one for thousands of vectors, and only their ids and counts are gathered."""
    ids = sorted(r.uid for r in blocks.select("uid").collect())
    table = blocks.sparkSession.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "uid long, block int")
    return blocks.join(F.broadcast(table), "uid").drop("uid")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantise(F.col(vector), scale).alias("q"), is_query.alias("asks")).where(F.col("q").isNotNull() & F.col("id").isNotNull())
    n = rows.count()
    parts = max(1, -(-n // BLOCK_ROWS))
    index = _numbered(_blocks(rows.repartitionByRange(parts, "id"), BLOCK_ROWS, True, "index"), "index")
    queries = rows.where("asks").dropDuplicates(["id", "q"])
    n_queries = queries.count()
    query_rows = max(64, min(QUERY_ROWS, -(-n_queries // QUERY_BLOCKS)))
    asking = _blocks(queries.repartitionByRange(max(1, n_queries // (4 * query_rows)), "id"), query_rows, False, "queries")
    asking = _numbered(asking, "queries").select(F.col("ids").alias("q_ids"), F.col("which").alias("q_which"), F.col("data").alias("q_data"), F.col("dims").alias("q_dims"), F.col("block").alias("q"))
    n_blocks, n_asking = index.count(), asking.count()
    # a block of the index is sent once for each chunk of query blocks: as many chunks as memory asks for, or as keep QUERY_BLOCKS tasks busy
    chunks = max(1, -(-n_asking // CHUNK), min(n_asking, -(-QUERY_BLOCKS // max(1, n_blocks))))
    index = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asking = asking.withColumn("chunk", (F.col("q") % chunks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1)))))

    def search(block: dict, asked: dict) -> list[np.ndarray]:
        """query_id, which, vec_id, score: the best rows of a block for each query of a query block."""
        ids = np.frombuffer(block["ids"], np.int64)
        bits, dims, words = block["bits"], block["dims"], -(-block["n"] // 64)
        data = np.frombuffer(block["data"], np.uint64).reshape(dims, bits, words)
        everyone = np.zeros(words * 64, np.uint8)
        everyone[: block["n"]] = 1
        take = np.packbits(everyone, bitorder="little").view(np.uint64)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for a, w, v in zip(np.frombuffer(asked["q_ids"], np.int64), np.frombuffer(asked["q_which"], np.int64), np.frombuffer(asked["q_data"], np.int64).reshape(-1, dims), strict=True):
            width = sum(map(abs, v.tolist())).bit_length() + bits + 1
            total = add_up(v, data, width)
            mine = take.copy()
            for own in np.arange(np.searchsorted(ids, a, "left"), np.searchsorted(ids, a, "right")):
                mine[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
            best = select(total, mine, k)
            for column, x in zip(out, (np.full(len(best), a), np.full(len(best), w), ids[best], values_at(total, best)), strict=True):
                column.append(x)
        return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        found = [search(r, q) for r in blocks.to_pylist() for q in asked.to_pylist() if r["dims"] == q["q_dims"]]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "which", "vec_id", "score"])

    found = index.select("block", "chunk", "n", "dims", "bits", "ids", "data").groupBy("block", "chunk").cogroup(asking.drop("q").groupBy("block", "chunk")).applyInArrow(run, "query_id long, which long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(W.Window.partitionBy("query_id", "which").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
