"""Packing documents into sequences of a fixed number of tokens by cutting-stock patterns.

A document's ids, with an end id after them, are cut into pieces of capacity ids; the shorter rest, if any, is its tail. The driver gets the histogram
of tails, capacity numbers whatever the size of the corpus, and solves it by column generation (weft/llm/cutting.py): patterns of lengths that fill sequences,
and how often to use each. Documents are ranked within their length, by a sum over partitions and a row number within a partition, so that no task
gets a length as a whole. A pattern's sequences take ranks in turn: from the rank alone follow sequence and offset. The tails that no pattern takes
stand one after another, long ones first, and are cut at every capacity ids; the last few ids are cut at powers of two.
So only sequences of patterns that have padding are padded, and cut_cost says how many ids of padding a cut is worth.

Sequences are padded to capacity, except where their length is a power of two. Each id lies in exactly one piece.
Nulls: a null text is an empty one, its only id is the end id; ids of documents may be null or repeated, and rows that repeat are documents of their own. A document
may be of any length; its ids are held by one worker at a time. Columns besides id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weft.llm import cutting
from weft.llm.base import bound_batches, materialize, pack, unpack
from weft.llm.tokens import word_ids

CAPACITY, END, CUT_COST = 2048, 1, 4.0
#: Ids of a batch of pieces.
BATCH_IDS = 1 << 20
_PIECES = "start long, length int, doc_tokens long, ids binary"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, separable: bool = True, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document, whole ones and tail: rid, doc_id, start, length, doc_tokens, ids (packed); written to the shared folder."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path, separable)
        for batch in batches:
            ids, counts = encode(batch.column("text"))
            ends = np.cumsum(counts)
            whole = np.insert(ids, ends, end).astype("<u4")  # the end id after each document
            size = counts + 1
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(size[doc] - start, capacity)
            at = (np.cumsum(size) - size)[doc] + start
            blobs = [pack(whole[a : a + k]) for a, k in zip(at, length, strict=True)]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(size[doc]), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids"])

    found = bound_batches(docs).mapInArrow(run, f"doc_id {kind}, {_PIECES}")
    return materialize(found.withColumn("rid", F.monotonically_increasing_id()), "pieces")


def ranked(rows: DataFrame) -> DataFrame:
    """rid, length, and the rank of each piece among those of its length, from 0. Pieces are counted by the task that wrote them."""
    rows = rows.select("rid", "length", F.shiftright("rid", 33).alias("part"))
    sums = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = sums.select("length", "part", (F.sum("n").over(W.Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    own = rows.withColumn("k", F.row_number().over(W.Window.partitionBy("length", "part").orderBy("rid")) - 1)
    return own.join(base, ["length", "part"]).select("rid", "length", (F.col("base") + F.col("k")).alias("rank"))


class Plan:
    """Where the piece of a length and rank goes. lengths, counts: the histogram of pieces, whole ones included."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, cut_cost: float = CUT_COST):
        self.capacity = capacity
        lengths, counts = lengths[np.argsort(lengths)], counts[np.argsort(lengths)]
        tails = lengths < capacity
        patterns, left = cutting.plan(lengths[tails], counts[tails], capacity, cut_cost)
        used, entries, first = dict.fromkeys(map(int, lengths), 0), [], 0
        for bag, n in patterns:
            offset = 0
            for length, a in sorted(bag.items(), reverse=True):
                entries.append((length, used[length], first, a, offset))
                used[length] += n * a
                offset += length * a
            first += n
        self.cut_from, stream = first, 0
        for length, n in sorted(zip(lengths[tails].tolist(), left.tolist(), strict=True), reverse=True):
            if n:
                entries.append((length, used[length], stream, 0, 0))  # no pieces a sequence: cut
                stream += length * n
        self.cut_ids, self.bounds = stream, [0]
        rest = stream % capacity
        for bit in reversed(range(capacity.bit_length())):
            if rest >> bit & 1:
                self.bounds.append(self.bounds[-1] + (1 << bit))
        entries.append((capacity, 0, first + stream // capacity + len(self.bounds) - 1, 1, 0))
        table = np.array(sorted(entries), np.int64).reshape(-1, 5)
        self.key = (table[:, 0] << 44) + table[:, 1]
        self.begin, self.base, self.each, self.offset = table[:, 1], table[:, 2], table[:, 3], table[:, 4]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Parts of pieces: the piece's number here, where the part begins in it, its length, its sequence and its offset there."""
        e = np.searchsorted(self.key, (length.astype(np.int64) << 44) + rank, "right") - 1
        k = rank - self.begin[e]
        out = [np.arange(len(e)), np.zeros(len(e), np.int64), length.astype(np.int64), self.base[e] + k // np.maximum(self.each[e], 1), self.offset[e] + k % np.maximum(self.each[e], 1) * length]
        cut = np.flatnonzero(self.each[e] == 0)
        rows = [self._cut(int(i), int(self.base[e[i]] + k[i] * length[i]), int(length[i])) for i in cut]
        keep = self.each[e] != 0
        more = np.array([r for found in rows for r in found], np.int64).reshape(-1, 5).T
        return tuple(np.concatenate([a[keep], b]) for a, b in zip(out, more, strict=True))

    def _cut(self, i: int, at: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
        whole, done = self.cut_ids // self.capacity, 0
        while done < length:
            s = at + done
            if s < whole * self.capacity:
                seq, start, stop = s // self.capacity, s // self.capacity * self.capacity, (s // self.capacity + 1) * self.capacity
            else:
                j = int(np.searchsorted(self.bounds, s - whole * self.capacity, "right")) - 1
                seq, start, stop = whole + j, whole * self.capacity + self.bounds[j], whole * self.capacity + self.bounds[j + 1]
            n = min(stop - s, length - done)
            yield i, done, n, self.cut_from + seq, s - start
            done += n


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, cut_cost: float = CUT_COST, **options) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, and its ids (little-endian 32-bit numbers)."""
    rows = pieces(docs, path, capacity, end, **options)
    hist = rows.groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    plan = Plan(np.array([r.length for r in hist], np.int64), np.array([r.n for r in hist], np.int64), capacity, cut_cost)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, *parts = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(i)), *map(pa.array, parts)], ["rid", "skip", "n", "sequence_id", "offset"])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, skip, n = batch.column("ids"), batch.column("skip").to_numpy(), batch.column("n").to_numpy()
            for at in range(0, batch.num_rows, BATCH_IDS // capacity):
                some = range(at, min(at + BATCH_IDS // capacity, batch.num_rows))
                cut = [unpack(blobs[i].as_py(), "<u4")[0][skip[i] : skip[i] + n[i]].tobytes() for i in some]
                own = batch.slice(at, len(some))
                start = own.column("start").to_numpy() + own.column("skip").to_numpy()
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(start), own.column("n"), own.column("doc_tokens"), own.column("sequence_id"), own.column("offset"), pa.array(cut, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    where = ranked(rows).mapInArrow(place, "rid long, skip long, n long, sequence_id long, offset long")
    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.drop("length").join(where, "rid").select("doc_id", "start", "doc_tokens", "ids", "skip", "n", "sequence_id", "offset")
    return joined.mapInArrow(ids, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
