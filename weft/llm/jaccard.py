"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles (five consecutive words); two texts are linked when the Jaccard similarity of
their sets is ``threshold`` or more. Texts with equal sets are one node, so copies are never paired.

1. Each node gets N_HASHES MinHash values. BANDS bands of ROWS values each bring nodes with an equal band together; a pair at
   the threshold shares no band with probability (1 - 0.8^5)^40, about 1e-7.
2. Pairs that share a band are compared value by value, STEP at a time: after m of n values agree, the
   posterior probability that the similarity reaches the threshold (uniform prior) is a binomial tail; a pair is dropped as soon as that is
   below TOLERANCE. What is left connects the nodes into candidate groups: only spanning edges are sent. The nodes of a band that has more than BLOCK
   of them are all connected to its smallest, without a comparison: their pairs wait for step 3, so this step stays linear.
3. The shingle sets of each group meet (a group of more than BLOCK nodes or BLOCK_SHINGLES shingles as pairs of blocks). Pairs are pruned
   the same way, the rest verified exactly: |A and B| / |A or B| on the sets themselves. Links are counted, not sent;
   spanning edges of verified links make the classes.

Returned per row: doc_id, class_id (the smallest id of the connected class) and n_links (rows of linked
texts, copies included).

Words are runs of ASCII letters and digits and bytes above 0x7F, A-Z lowered, known by 64-bit hashes. A text of one to four words has
one shingle of all its words. Null texts and texts without a word are a class of their own without links.
Rows without an id get class null and take no part. Rows that repeat an id are rows of their own. An empty table gives no
rows. Columns beside id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.base import bound_batches, components, discard, materialize, pack, power_of_two, runs, unpack
from weft.llm.hashing import FOLD, mix, prefix, ranges, words

SHINGLE_WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-7
BANDS, ROWS = 40, 5
N_HASHES, STEP = BANDS * ROWS, 40
#: Nodes of a group compared in one block, shingles of a block on average, bytes of text read at once, entries and bytes of a bucket on average.
BLOCK, BLOCK_SHINGLES, TEXT_BYTES, BUCKET_ENTRIES, BUCKET_BYTES = 1024, 1 << 19, 1 << 20, 1 << 18, 8 << 20
#: Nodes in groups up to which their ids are broadcast to the texts; beyond that both are joined by shuffle.
MAX_BROADCAST = 200_000
_rng = np.random.Generator(np.random.PCG64(11))
_A, _C = (_rng.integers(0, 1 << 32, N_HASHES, np.uint32) | np.uint32(1) for _ in range(2))
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all texts one after another, and where each text's begin (and the last's end)."""
    raw = np.frombuffer(b"".join(texts).translate(FOLD), np.uint8)
    breaks = np.cumsum([0, *map(len, texts)])
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    hashes, _, before = words(raw, breaks)
    counts = np.diff(before)
    grams = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(texts)), grams)
    start = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + before[row]
    values = mix(ranges(prefix(hashes), start, start + np.minimum(n, counts[row])))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(texts)))])


def set_ids(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A number for each set that has a member, equal for equal sets."""
    some = np.flatnonzero(np.diff(begin) > 0)
    out = np.zeros(len(begin) - 1, np.uint64)
    if len(some):
        out[some] = mix(np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), begin[some]) + np.diff(begin)[some].astype(np.uint64))
    return out.view(np.int64)


def signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash values of non-empty sets: (sets, N_HASHES)."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin) - 1, N_HASHES), np.uint32)
    for i in range(N_HASHES):
        out[:, i] = np.minimum.reduceat((short ^ _C[i]) * _A[i], begin[:-1])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    return mix((signature.reshape(-1, BANDS, ROWS).astype(np.uint64) * _BAND).sum(2, np.uint64) + np.arange(BANDS, dtype=np.uint64))


def low_bytes(signature: np.ndarray) -> np.ndarray:
    """A byte of each MinHash value, for comparing."""
    return ((signature * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the least agreeing ones with which a pair may still reach the threshold."""
    p, out = threshold + (1 - threshold) / 256, {}  # unequal values agree in their byte by chance
    for n in range(STEP, N_HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):  # P(p' >= p | m of n) = P(Binomial(n + 1, p) <= m)
            tail += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def prune(low: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that may still reach the threshold."""
    same = np.zeros(len(a), np.int32)
    for n, m in least.items():
        same = same + (low[a, n - STEP : n] == low[b, n - STEP : n]).sum(1)
        keep = same >= m
        a, b, same = a[keep], b[keep], same[keep]
    return a, b


def pairs_in(sizes: np.ndarray, starts: np.ndarray, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within groups, a bounded number at a time."""
    for s in np.unique(sizes[sizes > 1]):
        first = starts[sizes == s]
        for i in range(1, int(s)):  # places that are i apart
            left = (first[:, None] + np.arange(s - i)).ravel()
            for j in range(0, len(left), at_once):
                yield left[j : j + at_once], left[j : j + at_once] + i


def connect(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the edges (a, b): per node a but the smallest of its component, that as b. Large-star and small-star rounds,
    each one written to the shared folder, until all are stars."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, name)
    while True:
        n = e.agg(F.count("*"), F.count_distinct("a")).first()
        if n[0] == n[1] and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0:
            return e
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        was, e = e, materialize(small.where("a <> b").distinct(), name)
        discard(was)


def _batched(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows [i, j) of the batch with their texts, a bounded number of bytes at a time."""
    texts, size, i = [], 0, 0
    for j, x in enumerate(batch.column(column)):
        texts.append(memoryview(x.as_buffer()).tobytes() if x.is_valid else b"")
        size += len(texts[-1])
        if size >= TEXT_BYTES:
            yield i, j + 1, texts
            texts, size, i = [], 0, j + 1
    if texts:
        yield i, batch.num_rows, texts


def nodes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, node (null without shingles), its number of shingles, and the node's bands and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in _batched(batch, "t"):
                values, begin = shingle_sets(texts)
                some = np.diff(begin) > 0
                own = set_ids(values, begin)
                keys, low = [None] * len(texts), [None] * len(texts)
                if some.any():
                    s = signatures(values, np.append(begin[:-1][some], begin[-1]))
                    k, b = band_keys(s), low_bytes(s)
                    for at, x, y in zip(np.flatnonzero(some), k, b, strict=True):
                        keys[at], low[at] = x.tobytes(), y.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own, pa.int64(), mask=~some), pa.array(np.diff(begin)), pa.array(keys, pa.binary()), pa.array(low, pa.binary())], ["doc_id", "node", "shingles", "bands", "low"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, node long, shingles long, bands binary, low binary")


def band_members(reps: DataFrame, n_buckets: int) -> DataFrame:
    """Per band key that more than one node has: key, node, and to_node: the smallest node, if the key has more than BLOCK."""
    shift = np.uint64(64 - n_buckets.bit_length() + 1)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.uint64)
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            order = np.argsort(key)
            key, node = key[order], node[order]
            bucket = (key >> shift).astype(np.int64) if n_buckets > 1 else np.zeros(len(key), np.int64)
            head, ends = runs(bucket)
            data = [pack(key[i:j], node[i:j]) for i, j in zip(head, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[head]), pa.array(data, pa.binary())], ["bucket", "data"])

    def gather(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), "<u8", "<i8") for x in table.column("data")]
        key, node = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        head, ends = runs(key)
        size = np.repeat(ends - head, ends - head)
        shared, least = size > 1, np.repeat(node[head], ends - head)
        return pa.table({"key": pa.array(key[shared].view(np.int64)), "node": pa.array(node[shared]), "to_node": pa.array(least[shared], mask=size[shared] <= BLOCK)})

    return reps.select("node", "bands").mapInArrow(scatter, "bucket long, data binary").groupBy("bucket").applyInArrow(gather, "key long, node long, to_node long")


def candidate_edges(members: DataFrame, reps: DataFrame, n_buckets: int, threshold: float) -> DataFrame:
    """Spanning edges of the pairs that share a band and survive the pruning."""
    least = least_matches(threshold)

    def run(table: pa.Table) -> pa.Table:
        key, node = table.column("key").to_numpy(), table.column("node").to_numpy()
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, N_HASHES)
        names, node = np.unique(node, return_inverse=True)
        order = np.lexsort((node, key))
        key, node, low = key[order], node[order], low[order]
        starts, ends = runs(key)
        label = np.arange(len(names))
        for a, b in pairs_in(ends - starts, starts):
            apart = label[node[a]] != label[node[b]]
            a, b = prune(low, a[apart], b[apart], least)
            if len(a):
                label = components(len(names), np.concatenate([np.arange(len(names)), node[a]]), np.concatenate([label, node[b]]))
        some = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": pa.array(names[some]), "b": pa.array(names[label[some]])})

    joined = members.join(reps.select("node", "low"), "node").withColumn("bucket", F.pmod("key", F.lit(n_buckets)))
    return joined.groupBy("bucket").applyInArrow(run, "a long, b long")


def verify(table: pa.Table, least: dict[int, int], threshold: float) -> pa.Table:
    """Exact links within the cells of a bucket: per node, its links (rows) and the smallest node that it is connected to."""
    comp, left, right, block, node, copies = (table.column(c).to_numpy() for c in ("comp", "i", "j", "block", "node", "copies"))
    low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, N_HASHES)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
    order = np.lexsort((node, right, left, comp))
    cell = np.flatnonzero(np.append(True, (np.diff(comp[order]) != 0) | (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)))
    out: list[list[np.ndarray]] = [[], [], []]
    for begin, end in zip(cell, np.append(cell[1:], len(order)), strict=True):
        own = order[begin:end]
        own = own[np.append(True, np.diff(node[own]) != 0)]  # rows that repeat an id bring a node twice
        n = len(own)
        across = left[own[0]] != right[own[0]]
        side = block[own] == left[own[0]]
        a, b = [], []
        for x, y in pairs_in(np.array([n]), np.array([0])):
            if across:
                keep = side[x] != side[y]
                x, y = x[keep], y[keep]
            x, y = prune(low[own], x, y, least)
            if len(x):
                shared = intersections([sets[i] for i in own], x, y)
                size = np.array([len(sets[i]) for i in own])
                good = shared >= threshold * (size[x] + size[y] - shared) - 1e-9
                a.append(x[good])
                b.append(y[good])
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        if len(a):
            links = np.bincount(a, copies[own][b], n) + np.bincount(b, copies[own][a], n)
            label = components(n, a, b)
            some = np.flatnonzero(links > 0)
            for c, z in zip(out, (node[own][some], links[some].astype(np.int64), node[own][label[some]]), strict=True):
                c.append(z)
    return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["node", "links", "label"])


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members that the sets a[i] and b[i] share."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], True)) for x, y in zip(a, b, strict=True)], np.int64)
    used = np.unique(np.concatenate([a, b]))
    column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)[1]
    row = np.repeat(used, [len(sets[i]) for i in used])
    out = np.zeros(len(a), np.int64)
    width = 4096
    for start in range(0, int(column.max()) + 1, width):  # some columns of the membership matrix at a time
        of = (column >= start) & (column < start + width)
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[row[of], column[of] - start] = 1
        out += np.rint((matrix @ matrix.T)[a, b]).astype(np.int64)
    return out


def join(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, class_id, n_links."""
    rows = materialize(nodes(bound_batches(docs), doc_id, text), "nodes")
    known = rows.where("doc_id IS NOT NULL AND node IS NOT NULL")
    by = known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    low = known.join(by.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"]).dropDuplicates(["node"])
    reps = materialize(low.join(by, "node").select("node", "rep", "copies", "shingles", "bands", "low"), "reps")
    n = reps.count()
    members = materialize(band_members(reps, power_of_two(n * BANDS / BUCKET_ENTRIES)), "members")
    edges = candidate_edges(members.where("to_node IS NULL").select("key", "node"), reps, power_of_two(members.count() * N_HASHES / BUCKET_BYTES), threshold)
    groups = connect(edges.unionByName(members.where("node > to_node").select(F.col("node").alias("a"), F.col("to_node").alias("b"))), "groups")
    least = least_matches(threshold)

    ends = groups.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(groups.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
    ends = ends.join(reps.select("node", "rep", "copies", "shingles"), "node")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    at = materialize(ends.drop("shingles").join(ends.groupBy("comp").agg(blocks.alias("blocks")), "comp"), "grouped")
    total = at.count()
    if total <= MAX_BROADCAST:
        at = F.broadcast(at)

    def load_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in _batched(batch, "t"):
                values, begin = shingle_sets(texts)
                own = set_ids(values, begin)
                part = batch.slice(i, j - i)
                of = np.flatnonzero((own == part.column("node").to_numpy()) & (np.diff(begin) > 0))
                if len(of):
                    sets = [values[begin[x] : begin[x + 1]] for x in of]
                    sig = low_bytes(signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)])))
                    kept = part.take(pa.array(of))
                    yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("node", "comp", "blocks", "copies")] + [pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "comp", "blocks", "copies", "low", "shingles"])

    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("binary").alias("t")).join(at, "rep").select("node", "comp", "blocks", "copies", "t")
    sets = texts.mapInArrow(load_sets, "node long, comp long, blocks int, copies long, low binary, shingles binary")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    n_cells = power_of_two(total / 1024)
    sets = sets.withColumn("cell", F.pmod(F.xxhash64("comp", "i", "j"), F.lit(n_cells))).drop("other", "blocks")
    found = materialize(sets.groupBy("cell").applyInArrow(lambda t: verify(t, least, threshold), "node long, links long, label long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    stars = connect(found.select(F.col("node").alias("a"), F.col("label").alias("b")), "classes")
    label = stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    about = reps.select("node", "rep", "copies").join(links, "node", "left").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least_id = about.groupBy("label").agg(F.min("rep").alias("class_id"))
    about = about.join(least_id, "label").select("node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(about, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
