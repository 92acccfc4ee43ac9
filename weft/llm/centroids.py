"""Clustering around centroids, every assignment exact: a float32 screening with rounding-error intervals comes first.

Vectors become integers floor(scale * x). A round assigns each vector to the nearest centroid (squared Euclidean distance, ties to
the smaller number) and moves each centroid that has vectors to the floor of their mean; centroids without any stay.

Screening: |q - c|^2 = |q|^2 + (|c|^2 - 2 q.c), and the first part is the same for all centroids. The products q.c of a batch come
from one float32 matrix product. Whatever order its sums are taken in, a product is off by g |q| |c| at most, with
g = (d + 4) u / (1 - (d + 4) u) for d components and u = 2^-24: d roundings of products and sums, and one of each input. So
each centroid has an interval for its distance. Centroids whose interval begins above the end of another one are out; where one is
left, it is the nearest. The others, those whose intervals overlap, are computed again with exact integers: 64-bit where no square sum can leave
them, else Python's. All inputs are whole numbers, so nothing underflows; vectors that might overflow float32 skip the screening.

The driver holds the centroids: k * dims whole numbers, whatever the number of vectors. Each task sends its sums by cluster and
component, split into parts of 32 bits so that sums of any size are exact; no vector is shuffled, and no task gets a cluster.

Vectors that are null, have another number of components than dims, or hold null or non-finite components (also after scaling) take no part and
get no row. Rows that share an id, null ids included, are rows of their own. The first centroids are k rows with the smallest hashes of seed and id (null ids last;
equal ids by their components); with fewer rows there are fewer centroids. Distances and inertias that no 64-bit integer holds are given as the
largest one that does. An empty table gives no rows. Only the id and the vector column are read, other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.base import bound_batches

#: Components below this, and so many of them, keep squared distances within 64 bits: (2 * 2^26)^2 * 2^8 = 2^62.
SMALL, SMALL_DIMS = 1 << 26, 1 << 8
#: Rows screened at once, and the norm product from which float32 might overflow.
ROWS, HUGE = 4096, 2.0**120
#: Square sums above this count as this.
OVER = 1 << 1000
LARGEST = (1 << 63) - 1
LIMB = 1 << 32
_SUMS = "cluster int, dim int, limb int, part long"


def quantise(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that take part, and their whole-number components as doubles."""
    column = column.cast(pa.list_(pa.float64())) if column.type.value_type != pa.float64() else column
    starts, width = column.offsets.to_numpy()[:-1].astype(np.int64), np.diff(column.offsets.to_numpy())
    ok = np.flatnonzero((width == dims) & column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(flat[starts[ok][:, None] + np.arange(dims)] * float(scale))
    fine = np.isfinite(x).all(axis=1)
    return ok[fine], x[fine]


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole-number doubles as exact integers."""
    return x.astype(np.int64) if not x.size or np.abs(x).max() < SMALL else np.array([[int(v) for v in row] for row in x], object)


class Nearest:
    """Exact nearest centroids for batches of vectors. centroids: rows of Python integers."""

    def __init__(self, centroids: list[list[int]]):
        self.k, d = len(centroids), len(centroids[0])
        self.big = np.array(centroids, object).reshape(self.k, d)
        self.small = d <= SMALL_DIMS and all(abs(v) < SMALL for row in centroids for v in row)
        self.ints = self.big.astype(np.int64) if self.small else self.big
        self.doubles = self.big.astype(np.float64)
        self.squares = np.array([float(min(sum(v * v for v in row), OVER)) for row in centroids])
        self.norms = np.sqrt(self.squares)
        with np.errstate(over="ignore"):
            self.singles = np.ascontiguousarray(self.doubles.astype(np.float32).T)
        u = (d + 4) * 2.0**-24
        #: Twice the bound on a product's error, a little more for the rounding of norms.
        self.slack = 2 * u / (1 - u) * (1 + 1e-9)
        #: Vectors looked at with exact integers, and the centroids looked at for them.
        self.overlaps = self.recomputed = 0

    def _distance(self, q: np.ndarray, ix: np.ndarray) -> np.ndarray:
        """Exact squared distances between rows of doubles and the centroids numbered ix."""
        if self.small and (not q.size or np.abs(q).max() < SMALL):
            gap = q.astype(np.int64) - self.ints[ix]
            return np.einsum("ij,ij->i", gap, gap)
        gap = np.array([[int(v) for v in row] for row in q], object).reshape(q.shape) - self.big[ix]
        return (gap * gap).sum(axis=1)

    def __call__(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each row of whole-number doubles. Distances are Python integers where 64 bits may not do."""
        norms = np.sqrt((q * q).sum(axis=1)) if np.abs(q).max(initial=0) < HUGE else np.full(len(q), np.inf)
        fits = norms * self.norms.max() < HUGE
        near = np.ones((len(q), self.k), bool)
        at = np.flatnonzero(fits)
        if len(at) and self.squares.max() < HUGE:
            product = (q[at].astype(np.float32) @ self.singles).astype(np.float64)
            score = self.squares - 2 * product
            off = self.slack * norms[at, None] * self.norms + 2.0**-50 * (self.squares + 2 * np.abs(product)) + 1
            near[at] = score - off <= (score + off).min(axis=1)[:, None]
        many = np.flatnonzero(near.sum(axis=1) > 1)
        cluster = near.argmax(axis=1)
        if len(many):
            row, ix = np.nonzero(near[many])
            self.overlaps, self.recomputed = self.overlaps + len(many), self.recomputed + len(row)
            exact = self._distance(q[many[row]], ix)
            order = np.lexsort((ix, exact, row)) if exact.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], exact[i], ix[i])))
            head = np.append(True, row[order][1:] != row[order][:-1])
            cluster[many] = ix[order][head]
        return cluster, self._distance(q, cluster)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """value as parts times powers of 2^32; all but the last are not negative."""
    at = 0
    while True:
        if -LIMB <= value < LIMB:
            yield at, value
            return
        value, low = divmod(value, LIMB)
        yield at, low
        at += 1


def _sums(q: np.ndarray, cluster: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """By cluster: rows and the exact sums of their components."""
    out = {}
    for c in np.unique(cluster):
        mine = _whole(q[cluster == c])
        out[int(c)] = (len(mine), [int(v) for v in mine.sum(axis=0)])
    return out


def _batches(found: list[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        a = list(zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(a, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "dim", "limb", "part"])


class Centroids:
    """A clustering of df[vector]. centroids: lists of integers by number; counts and inertia follow from a pass of their own."""

    def __init__(self, df: DataFrame, k: int, rounds: int, dims: int, scale: float, seed: str = "2", id_col: str = "vec_id", vector: str = "embedding"):
        self.rows = bound_batches(df.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("x")))
        self.dims, self.scale = dims, scale
        self.centroids = self._first(k, seed)
        for _ in range(rounds if self.centroids else 0):
            for c, (n, *sums) in self._total(with_sums=True).items():
                self.centroids[c] = [s // n for s in sums]

    def _first(self, k: int, seed: str) -> list[list[int]]:
        dims, scale = self.dims, self.scale

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok, q = quantise(batch.column("x"), dims, scale)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(ok)), pa.array(list(q), pa.list_(pa.float64()))], ["vec_id", "q"])

        kind = self.rows.schema["vec_id"].dataType.simpleString()
        kept = self.rows.mapInArrow(keep, f"vec_id {kind}, q array<double>")
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        return [[int(v) for v in r.q] for r in kept.orderBy(key.asc_nulls_last(), "q").limit(k).select("q").collect()]  # k rows

    def _total(self, with_sums: bool) -> dict[int, list[int]]:
        """By cluster, exactly: rows and the sums of components, or (with_sums=False) rows and the sum of distances."""
        dims, scale, centroids = self.dims, self.scale, self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nearest, total = Nearest(centroids), {}
            for batch in batches:
                _, x = quantise(batch.column("x"), dims, scale)
                for at in range(0, len(x), ROWS):
                    q = x[at : at + ROWS]
                    cluster, distance = nearest(q)
                    if with_sums:
                        found = {c: [n, *s] for c, (n, s) in _sums(q, cluster).items()}
                    else:
                        found = {int(c): [int((cluster == c).sum()), sum(int(v) for v in distance[cluster == c])] for c in np.unique(cluster)}
                    for c, values in found.items():
                        total[c] = [a + b for a, b in zip(total[c], values, strict=True)] if c in total else values
            yield from _batches([(c, dim, limb, part) for c, values in total.items() for dim, v in enumerate(values) for limb, part in _limbs(v)])

        found = self.rows.select("x").mapInArrow(run, _SUMS).groupBy("cluster", "dim", "limb").agg(F.sum("part").alias("part")).collect()  # centroids * dims * a few
        out = {c: [0] * ((dims if with_sums else 1) + 1) for c in {r.cluster for r in found}}
        for r in found:
            out[r.cluster][r.dim] += r.part * LIMB**r.limb
        return out

    def assigned(self) -> DataFrame:
        """A row for each vector that takes part: vec_id, cluster, distance."""
        dims, scale, centroids = self.dims, self.scale, self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nearest = Nearest(centroids) if centroids else None
            for batch in batches:
                ok, x = quantise(batch.column("x"), dims, scale)
                for at in range(0, len(x), ROWS):
                    cluster, distance = nearest(x[at : at + ROWS])
                    told = distance if distance.dtype != object else np.array([min(int(v), LARGEST) for v in distance], np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(ok[at : at + ROWS])), pa.array(cluster.astype(np.int32)), pa.array(told)], ["vec_id", "cluster", "distance"])

        kind = self.rows.schema["vec_id"].dataType.simpleString()
        return self.rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")

    def described(self) -> DataFrame:
        """A row for each centroid: cluster, vectors, centroid (components in decimal), cluster_inertia and inertia."""
        total = self._total(with_sums=False) if self.centroids else {}
        whole = min(sum(s for _, s in total.values()), LARGEST)
        rows = [(c, *((total[c][0], min(total[c][1], LARGEST)) if c in total else (0, 0)), ",".join(map(str, x)), whole) for c, x in enumerate(self.centroids)]
        return self.rows.sparkSession.createDataFrame(rows, "cluster int, vectors long, cluster_inertia long, centroid string, inertia long")


def cluster(df: DataFrame, k: int, rounds: int, dims: int, scale: float, **columns) -> DataFrame:
    """vec_id, cluster, distance and what described() tells of the cluster. The centroids, k rows, are broadcast."""
    found = Centroids(df, k, rounds, dims, scale, **columns)
    return found.assigned().join(F.broadcast(found.described()), "cluster")
