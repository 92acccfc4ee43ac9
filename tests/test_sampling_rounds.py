"""Greedy samples, against the loops that they stand for."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import sampling


def order(s):
    return hashlib.md5(f"42:{s}".encode()).hexdigest(), s


def greedy(facts, quota, total, repeats):
    by, own = {}, {}
    for s, p in facts:
        by.setdefault(p, set()).add(s)
        own.setdefault(s, set()).add(p)
    met, out, have = set(), [], dict.fromkeys(by, 0)
    for i, p in enumerate(sorted(by, key=lambda p: (len(by[p]), p))):
        found = 0
        for s in sorted(by[p], key=order):
            if found >= repeats:
                continue
            if s in met:
                found += 1
                continue
            met.add(s)
            if have[p] <= quota and len(out) < total:
                out.append((s, i, p))
                for q in own[s]:
                    have[q] += 1
    return sorted(out)


@pytest.mark.parametrize("quota,total,repeats", [(5, 40, 3), (0, 1000, 1), (1000, 1000, 1000), (8, 12, 2)])
def test_exposure_is_the_greedy_loop(spark, quota, total, repeats):
    r = random.Random(quota)
    facts = [(f"e{r.randrange(80)}", f"p{min(r.randrange(9), r.randrange(9))}") for _ in range(300)]
    df = spark.createDataFrame(facts + [(None, "p1"), ("e1", None)], "s string, p string").withColumn("n", F.lit(1))
    got = sampling.exposure(df, quota, total, repeats).collect()
    assert sorted((x.s, x["round"], x.p) for x in got) == greedy(facts, quota, total, repeats)


def test_exposure_of_orders_is_the_greedy_loop(spark):
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select(F.concat(F.lit("order/"), "l_orderkey").alias("s"), F.concat("l_returnflag", "l_linestatus").alias("p"))
    facts = [(r.s, r.p) for r in lines.collect()]
    got = sampling.exposure(lines, 1000, 4800, 100).collect()
    assert sorted((x.s, x["round"], x.p) for x in got) == greedy(facts, 1000, 4800, 100)
    assert sampling.exposure(lines.limit(0)).count() == 0


def test_capped_reuse_is_the_loop_however_uses_are_counted(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    pairs = lines.groupBy(F.col("l_suppkey").alias("template"), F.col("l_partkey").alias("filler")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid"))
    rows = sorted((r.uid, r.template, r.filler) for r in pairs.collect())
    got = sorted((r.uid, r.template, r.filler) for r in sampling.capped_reuse(pairs, 3).collect())
    for only_kept in (True, False):
        used, out = {}, []
        for u, a, b in rows:
            kept = used.get(("a", a), 0) < 3 or used.get(("b", b), 0) < 3
            if kept:
                out.append((u, a, b))
            if kept or not only_kept:
                used["a", a], used["b", b] = used.get(("a", a), 0) + 1, used.get(("b", b), 0) + 1
        assert got == sorted(out)
