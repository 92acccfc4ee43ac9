import hashlib
import math
import random

import numpy as np
from conftest import same_rows
from pyspark.sql import functions as F

from weft.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<double>, cluster string, x string, dim int"


def brute(rows, k, rounds, dims, scale, seed="2"):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [q for _, q in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, x)), n) for n, x in enumerate(c)) for _, q in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(c)):
            if mine := [q for (_, q), (_, m) in zip(kept, near) if m == n]:
                c[n] = [sum(col) // len(mine) for col in zip(*mine)]
    near, top = assign(), (1 << 63) - 1
    whole = min(sum(d for d, _ in near), top)
    return sorted(((-1 if i is None else i), n, min(d, top), min(sum(e for e, m in near if m == n), top), whole, ",".join(map(str, c[n]))) for (i, _), (d, n) in zip(kept, near))


def rows_of(df):
    return sorted(((-1 if r.vec_id is None else r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in df.collect())


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "c", "x", 0) for i, v in rows], SCHEMA).repartition(parts)


def check(spark, rows, k=5, rounds=4, dims=4, scale=256):
    assert rows_of(centroids.cluster(table(spark, rows), k, rounds, dims, scale)) == brute(rows, k, rounds, dims, scale)


def test_random_repeated_and_odd_vectors(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(150)]
    rows += [(i, [0.5, 0.25, 0.0, -1.0]) for i in range(200, 320)]  # one common vector
    rows += [(400, None), (401, []), (402, [1.0] * 3), (403, [1.0] * 5), (404, [1.0, None, 0.0, 0.0]), (405, [1.0, float("nan"), 0.0, 0.0]), (406, [float("inf"), 0.0, 0.0, 0.0]), (407, [1e308, 1e308, 0.0, 0.0])]
    rows += [(7, [0.1, 0.2, 0.3, 0.4]), (7, [0.1, 0.2, 0.3, 0.4]), (None, [2.0, 2.0, 2.0, 2.0])]
    check(spark, rows)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(40)]  # first centroids repeat, so that some never get a vector
    check(spark, rows, k=8)
    check(spark, [(i, [0.0, 0.0, float(i % 3 - 1), 0.0]) for i in range(30)], k=3, rounds=1)


def test_vectors_of_any_size(spark):
    big = [(i, [s * (i + 1) * 1e9, -s * i * 3e8, 1.0, 7e15 * (i % 3)]) for i, s in enumerate([1, -1] * 20)]
    check(spark, big, k=4)
    check(spark, big + [(100, [1e200, -1e200, 3.0, 0.0]), (101, [1e200, 1e199, 0.0, 0.0]), (102, [1e60] * 4)], k=6)


def test_fewer_rows_than_centroids_and_none(spark):
    check(spark, [(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.5, 2.0, 3.0, 4.0])])
    check(spark, [])
    check(spark, [(1, None)])


def test_screening_keeps_every_nearest_centroid():
    """Centroids that differ by less than float32 can tell: the intervals overlap and exact integers decide."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 20), 1 << 20, 64)
    c = [[int(v) for v in base + rng.integers(-2, 3, 64)] for _ in range(20)]
    c[11] = list(c[4])  # a tie
    q = (base + rng.integers(-3, 4, (300, 64))).astype(np.float64)
    near = centroids.Nearest(c)
    got, distance = near(q)
    want = [min((sum((int(a) - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c)) for v in q]
    assert [(int(d), int(n)) for d, n in zip(distance, got)] == want
    assert near.overlaps > 0
    far = centroids.Nearest([[n * 1000] * 64 for n in range(20)])
    far(rng.integers(0, 20_000, (300, 64)).astype(np.float64))
    assert far.recomputed < 60  # screening decides nearly all


def test_query_agrees_with_sql_and_any_partitioning(spark, duck, sf_dir):
    got = queries.op12_interval_centroids(spark, sf_dir)
    same_rows(got.toPandas(), duck.sql(queries.ORACLE["op12_interval_centroids"]).df())
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    again = centroids.cluster(df.repartition(13), k=40, rounds=5, dims=64, scale=256)
    assert again.select("vec_id", "cluster", "distance").exceptAll(got.select("vec_id", "cluster", "distance")).count() == 0
    assert again.agg(F.countDistinct("inertia")).first()[0] == 1
