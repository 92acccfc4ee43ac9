"""Sharding by a k-d tree over the documents' metadata.

The documents are points in a box of metadata (size, id, language, source), each dimension scaled to
0..1. Starting from one node that has to become all shards, each node is split across the dimension in
which its points spread widest, at the weighted median: the value below which lies the share of bytes
that its left half of the shards has to hold. A leaf is one shard; all have nearly the same bytes.

The nodes of a level are split at once: histograms that Spark adds up narrow each node's cut, and the driver sees only
these (about MOST_BINS numbers a round). Nodes and cuts are tables that are joined to the rows. A node of few rows (a 4096th of all, but
LOCAL_ROWS at least and MOST_LOCAL_ROWS at most), and of an eighth of the shards at most, is split to its leaves in one task, at exact medians.

Groups are equal texts. All rows of a group are the same point (that of the group's smallest id, language and source), and a cut goes beside a group unless the
group holds more than GROUP_SLACK of a shard's bytes. So copies share a shard, but for groups too large for it and those at a cut of that size: a group
that holds most rows is split like any other rows, by a hash of id and metadata.

Nulls: a null text has 0 bytes; null metadata takes the value 0 of its dimension. Rows that are equal throughout are told apart by their place, so they can be
split too. An empty table gives no rows. Columns beside those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.base import discard, materialize

#: Bins of a histogram, and of all histograms of a round.
BINS, MOST_BINS = 1 << 10, 1 << 20
#: Rows of a node that is split in one task, and the share of all shards that it may have (one over this): the first levels are split by histograms at every size.
LOCAL_ROWS, MOST_LOCAL_ROWS, LOCAL_SHARE = 1 << 14, 1 << 20, 8
#: A cut is fine enough when the bytes that it leaves undecided are this share of a shard's; a group up to the second share is not cut.
TOLERANCE, GROUP_SLACK = 0.002, 0.02
ROW_BYTES = 16
#: Rows for each bucket in which places in a shard are numbered, and groups of copies whose list is broadcast.
BUCKET_ROWS, MAX_BROADCAST = 50_000, 200_000
#: Hashes have so many bits that a double holds them.
HASH = 52


def _hash(*columns: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - HASH)


def points(docs: DataFrame, id_col: str = "doc_id", text: str = "text", labels: tuple[str, ...] = ("lang", "source")) -> tuple[DataFrame, list[str]]:
    """Per row: doc_id, size, crc, group (of its text), tie, uid and the dimensions d0, d1, ... in 0..1; written to the shared folder."""
    has = [c for c in labels if c in docs.columns]
    t = F.col(text)
    names = [f"l{i}" for i in range(len(has))]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("crc"),
        _hash(t).alias("group"),
        _hash(id_col, text, *has).alias("tie"),
        *[(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) / F.lit(2.0**32)).alias(n) for n, c in zip(names, has, strict=True)],
    )
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "points")
    copies = rows.groupBy("group").agg(F.count("*").alias("n"), F.min("doc_id").alias("g_id"), *[F.min(n).alias(f"g_{n}") for n in names]).where("n > 1").drop("n")
    copies = materialize(copies, "copies")
    copies = F.broadcast(copies) if copies.count() <= MAX_BROADCAST else copies
    rows = rows.join(copies, "group", "left")
    log = F.log(F.col("size").cast("double"))
    low = rows.agg(F.min(log), F.max(log), F.min("doc_id"), F.max("doc_id")).first()
    b = [float(x) if x is not None else 0.0 for x in low]
    unit = lambda value, i: F.coalesce((value - F.lit(b[i])) / F.lit(max(b[i + 1] - b[i], 1e-12)), F.lit(0.0))
    dims = [unit(log, 0), unit(F.coalesce("g_id", "doc_id").cast("double"), 2), *[F.coalesce(f"g_{n}", n) for n in names]]
    return rows.select("doc_id", "size", "crc", "group", "tie", "uid", *[d.alias(f"d{i}") for i, d in enumerate(dims)]), [f"d{i}" for i in range(len(dims))]


class _Node:
    """Shards [first, first + n), and how far the search for its cut has come. Rows are ordered by the node's dimension, then by group, tie and place (the four
    levels); a cut has the values fixed of the levels before its own, and rows below `low` there lie left."""

    def __init__(self, key: int, first: int, n: int):
        self.key, self.first, self.n = key, first, n
        self.dim, self.goal, self.below = 0, 0.0, 0.0
        self.fixed: list[float] = []
        self.low, self.high, self.done = 0.0, 1.0, False

    def row(self) -> tuple:
        return (self.key, self.dim, len(self.fixed), *(self.fixed + [0.0] * 3)[:3], float(self.low), float(self.high))

    def children(self) -> list[_Node]:
        """Half of the shards each; the lower half goes left."""
        half = self.n // 2
        return [_Node(2 * self.key + 1, self.first, half), _Node(2 * self.key + 2, self.first + half, self.n - half)]


_CUT = "node long, dim int, level int, v0 double, v1 double, v2 double, low double, high double"


def _joined(rows: DataFrame, nodes: list[_Node], how: str) -> DataFrame:
    """rows with the cuts of their nodes; a cut is a few numbers for MOST_LOCAL_ROWS rows or more, or for a shard."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([n.row() for n in nodes], _CUT)), "node", how)


def _levels(dims: list[str]) -> list[Column]:
    return [F.element_at(F.array(*dims), F.col("dim") + 1), *[F.col(c).cast("double") for c in ("group", "tie", "uid")]]


def _narrow(rows: DataFrame, nodes: list[_Node], dims: list[str], slack: float, group_slack: float) -> None:
    """One histogram for every open node: the bin in which its goal lies is what is left of its search."""
    bins = max(16, min(BINS, MOST_BINS // len(nodes)))
    x = _levels(dims)
    at = F.when(F.col("level") == 0, x[0]).when(F.col("level") == 1, x[1]).when(F.col("level") == 2, x[2]).otherwise(x[3])
    fixed = [(F.col("level") <= i) | (x[i] == F.col(f"v{i}")) for i in range(3)]
    of = _joined(rows, nodes, "inner").where(fixed[0] & fixed[1] & fixed[2]).withColumn("x", at).where("x >= low AND x < high")
    of = of.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins).cast("int")))
    got: dict[int, list] = {}
    for r in of.groupBy("node", "bin").agg(F.sum("size").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        got.setdefault(r.node, []).append(r)
    for n in nodes:
        for r in sorted(got.get(n.key, []), key=lambda r: r.bin):
            if n.below + r.s <= n.goal:
                n.below += r.s
                continue
            level, after = len(n.fixed), float(np.nextafter(r.hi, np.inf))
            if r.s <= slack or r.lo == r.hi and (level == 3 or level == 1 and r.s <= group_slack):
                n.done, n.low = True, after if n.below + r.s / 2 <= n.goal else r.lo
            elif r.lo == r.hi:
                n.fixed.append(r.lo)
                n.low, n.high = 0.0, 2.0**53
            else:
                n.low, n.high = r.lo, after
            break
        else:
            n.low, n.done = n.high, True


def _finish(nodes: dict[int, tuple[int, int]], dims: list[str], group_slack: float):
    """A function that splits the rows of a node (its first shard and its shards are in nodes) to the leaves."""

    def run(table: pa.Table) -> pa.Table:
        c = {k: table.column(k).to_numpy() for k in ("size", "group", "tie", "uid", *dims)}
        first, n = nodes[table.column("node")[0].as_py()]
        shard = np.empty(table.num_rows, np.int32)
        todo = [(np.arange(table.num_rows), first, n)]
        while todo:
            at, first, n = todo.pop()
            if n == 1 or not len(at):
                shard[at] = first
                continue
            dim = max(dims, key=lambda d: np.ptp(c[d][at]))
            at = at[np.lexsort((c["uid"][at], c["tie"][at], c["group"][at], c[dim][at]))]
            ends = np.cumsum(c["size"][at])
            goal = ends[-1] * (n // 2) / n
            below = lambda k: ends[k - 1] if k else 0  # noqa: B023, E731
            k = int(np.searchsorted(ends, goal))
            k = min((k, k + 1), key=lambda k: abs(below(k) - goal))
            group = c["group"][at]
            if 0 < k < len(at) and group[k - 1] == group[k]:
                other = np.flatnonzero(group != group[k])
                i = int(np.searchsorted(other, k))
                begin, end = (int(other[i - 1]) + 1 if i else 0), (int(other[i]) if i < len(other) else len(at))
                if below(end) - below(begin) <= group_slack:
                    k = min((begin, end), key=lambda k: abs(below(k) - goal))
            todo += [(at[:k], first, n // 2), (at[k:], first + n // 2, n - n // 2)]
        return table.append_column("shard", pa.array(shard, pa.int32()))

    return run


def assign(rows: DataFrame, dims: list[str], n_shards: int) -> DataFrame:
    """Adds shard, 0 to n_shards - 1."""
    whole = rows.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    share = (whole.s or 0) / n_shards
    local_rows = max(LOCAL_ROWS, min(MOST_LOCAL_ROWS, whole.n >> 12))
    settled: dict[int, tuple[int, int]] = {}
    live, rows = [_Node(0, 0, n_shards)], rows.withColumn("node", F.col("uid").bitwiseAND(F.lit(0)))  # no constant, or joins on it would lose their key
    moved = None
    while live:
        of = rows if len(settled) == 0 else _joined(rows, live, "left_semi")
        spread = {r.node: r for r in of.groupBy("node").agg(F.sum("size").alias("all"), F.count("*").alias("n"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]).collect()}
        open_ = []
        for n in live:
            r = spread.get(n.key)
            if n.n == 1 or r is None or r.n <= local_rows and n.n * LOCAL_SHARE <= n_shards:
                settled[n.key] = (n.first, n.n)
                continue
            n.dim = max(range(len(dims)), key=lambda i: r[f"hi_{dims[i]}"] - r[f"lo_{dims[i]}"])
            n.goal = r["all"] * (n.n // 2) / n.n
            n.low, n.high = r[f"lo_{dims[n.dim]}"], float(np.nextafter(r[f"hi_{dims[n.dim]}"], np.inf))
            open_.append(n)
        live = open_
        while open_ := [n for n in open_ if not n.done]:
            _narrow(rows, open_, dims, TOLERANCE * share, GROUP_SLACK * share)
        if live:
            x, low = _levels(dims), F.col("low")
            left = F.when(F.col("level") == 3, x[3] < low)
            for i in (2, 1, 0):
                left = left.when(F.col("level") == i, x[i] < low)
            for i in (2, 1, 0):  # the first level that differs from a fixed value decides
                left = F.when((F.col("level") > i) & (x[i] != F.col(f"v{i}")), x[i] < F.col(f"v{i}")).otherwise(left)
            node = F.when(F.col("level").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 1).otherwise(2))
            was, rows = moved, _joined(rows, live, "left").withColumn("node", node).select(*rows.columns)
            moved = rows = materialize(rows, "nodes")
            if was is not None:
                discard(was)
        live = [c for n in live for c in n.children()]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, shard int"
    single = {k: v[0] for k, v in settled.items() if v[1] == 1}
    several = {k: v for k, v in settled.items() if v[1] > 1}
    table = rows.sparkSession.createDataFrame([(k, s) for k, s in single.items()], "node long, shard int")
    told = rows.join(F.broadcast(table), "node").select(*rows.columns, "shard")
    rest = rows.join(F.broadcast(table), "node", "left_anti").groupBy("node").applyInArrow(_finish(several, dims, GROUP_SLACK * share), schema)
    return told.unionByName(rest) if single and several else told if single else rest


def number(rows: DataFrame, group: str = "shard", order: str = "tie") -> DataFrame:
    """Adds slot, from 0 without gaps in each group. A group is cut into buckets by the order's value, so no task sorts a whole group."""
    from pyspark.sql import Window as W

    n = rows.count()
    buckets = max(1, n // BUCKET_ROWS)
    rows = rows.withColumn("__b", F.floor(F.col(order) / F.lit((1 << HASH) // buckets + 1)).cast("int"))
    counts = rows.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    base = counts.select(group, "__b", (F.sum("__n").over(W.partitionBy(group).orderBy("__b")) - F.col("__n")).alias("__base"))
    place = F.row_number().over(W.partitionBy(group, "__b").orderBy(order, "uid"))
    return rows.withColumn("__r", place).join(base, [group, "__b"]).withColumn("slot", (F.col("__base") + F.col("__r") - 1).cast("long")).drop("__b", "__r", "__base")


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, **columns) -> DataFrame:
    """Per row: doc_id, size, crc, group, tie, the dimensions, shard and slot. Give the number of shards, or the bytes that a leaf may hold."""
    rows, dims = points(docs, **columns)
    rows = materialize(rows, "placed")
    if n_shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        n_shards = max(1, -(-total // (target_bytes or 1 << 30)))
    return number(materialize(assign(rows, dims, n_shards), "shards"))
