"""Graph patterns over quads: semi, anti and optional joins, rule inference, closures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.sources.scratch import discard, settle


def in_graphs(quads: DataFrame, *graphs: str) -> DataFrame:
    return quads.where(F.col("g").isin(list(graphs)))


def of_class(quads: DataFrame, cls: str) -> DataFrame:
    """The distinct entities of a class."""
    return quads.where((F.col("p") == "rdf:type") & (F.col("o") == cls)).select("s").distinct()


def exists(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """FILTER EXISTS with the given columns bound."""
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def missing(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """FILTER NOT EXISTS with the given columns bound: on ('s',) if the pattern leaves the rest open, on ('s', 'p', 'o') if not."""
    return left.join(right.select(*on), list(on), "left_anti")


def lookup(quads: DataFrame, entities: DataFrame, *props: str) -> DataFrame:
    """Facts of a batch of entities (s) and properties: one join, whatever the number of entities."""
    return exists(quads.where(F.col("p").isin(list(props))), entities, "s").select("s", "p", "o")


def known_classes(names: DataFrame, quads: DataFrame) -> DataFrame:
    """ASK for each class name (cls): whether any entity has it."""
    have = quads.where(F.col("p") == "rdf:type").select(F.col("o").alias("cls")).distinct().withColumn("known", F.lit(True))
    return names.join(have, "cls", "left").select("cls", F.coalesce("known", F.lit(False)).alias("known"))


def reified(quads: DataFrame) -> DataFrame:
    """Facts stated through a node that holds the value: s p n, n rdf:value o."""
    values = quads.where(F.col("p") == "rdf:value").select(F.col("s").alias("n"), "o")
    return quads.where(F.col("k") == "iri").select("s", "p", F.col("o").alias("n")).join(values, "n").select("s", "p", "o").distinct()


def new_or_old(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Entities with one object property at least, each marked new (it is among the new ones) or old."""
    linked = quads.where((F.col("k") == "iri") & (F.col("p") != "rdf:type")).select("s").distinct()
    marked = linked.join(new.select("s", F.lit("new").alias("part")).distinct(), "s", "left")
    return marked.select("s", F.coalesce("part", F.lit("old")).alias("part"))


def star(quads: DataFrame, props: list[str]) -> DataFrame:
    """Entities that have all of the properties, one value each (the least): a conditional aggregation, not a join for each property."""
    wide = quads.where(F.col("p").isin(props)).groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(p) for p in props])
    return wide.where(" AND ".join(f"`{p}` IS NOT NULL" for p in props))


def optional(quads: DataFrame, props: list[str]) -> DataFrame:
    """One row for each entity, the sorted values of each property joined; null where it has none."""
    each = [F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o")))), "|"), F.lit("")).alias(p) for p in props]
    return quads.groupBy("s").agg(*each)


def range_checked(quads: DataFrame, ranges: DataFrame) -> DataFrame:
    """Object facts whose object has the class that the shape (p, range) asks for. The shape is small; types are joined by object."""
    types = quads.where(F.col("p") == "rdf:type").select(F.col("s").alias("o"), F.col("o").alias("range")).distinct()
    return quads.where(F.col("k") == "iri").join(F.broadcast(ranges), "p").join(types, ["o", "range"], "left_semi").select("s", "p", "o")


def infer_from_date(quads: DataFrame, date_prop: str, year_prop: str, graph: str) -> DataFrame:
    """year_prop from the year of date_prop for entities that lack it."""
    dated = quads.where(F.col("p") == date_prop).select("s", F.year(F.try_to_date("o")).cast("string").alias("o")).where("o IS NOT NULL").distinct()
    have = quads.where(F.col("p") == year_prop)
    return missing(dated, have, "s").select(F.lit(graph).alias("g"), "s", F.lit(year_prop).alias("p"), "o", F.lit("literal").alias("k"))


def infer_two_hops(quads: DataFrame, first: str, cls: str, second: str, target: str, graph: str) -> DataFrame:
    """s target o if s first x, x is a cls and x second o; only for subjects without target."""
    middle = exists(quads.where(F.col("p") == second).select(F.col("s").alias("x"), "o"), of_class(quads, cls).withColumnRenamed("s", "x"), "x")
    hop = quads.where(F.col("p") == first).select("s", F.col("o").alias("x"))
    found = hop.join(middle, "x").select("s", "o").distinct()
    return missing(found, quads.where(F.col("p") == target), "s").select(F.lit(graph).alias("g"), "s", F.lit(target).alias("p"), "o", F.lit("iri").alias("k"))


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """names (name, id) of the nodes of edges (c, a), ids dense from 0 or nearly so, and the edges by id."""
    names = settle(edges.select("c").union(edges.select("a")).distinct().select(F.col("c").alias("name"), F.monotonically_increasing_id().alias("m")))
    parts = names.agg(F.max(F.shiftright("m", 33)) + 1).first()[0] or 1
    names = names.select("name", (F.col("m").bitwiseAND((1 << 33) - 1) * parts + F.shiftright("m", 33)).cast("int").alias("id"))
    child, parent = names.select(F.col("name").alias("c"), F.col("id").alias("ci")), names.select(F.col("name").alias("a"), F.col("id").alias("ai"))
    return names, edges.join(child, "c").join(parent, "a").select(F.col("ci").alias("c"), F.col("ai").alias("a"), *[x for x in edges.columns if x not in ("c", "a")])


def _gathered(rows: DataFrame) -> DataFrame:
    """A row for each node of (c, a, d): what is above it and how far, as arrays. Rows that are partitioned by c stay where they are."""
    return rows.groupBy("c", "a").agg(F.min("d").alias("d")).groupBy("c").agg(F.collect_list("a").alias("a"), F.collect_list("d").alias("d"))


class _Above:
    """A closure by numbers: above (c, a, d), a row for each node, and names (name, id)."""

    def __init__(self, above: DataFrame, names: DataFrame):
        self.above, self.names = above, names

    @staticmethod
    def of(up: DataFrame) -> _Above:
        """That of closure(); of any other table (c, a, d) it is made."""
        known = getattr(up, "_weft_above", None)
        if known is None:
            names, rows = _numbered(up.select("c", "a", "d"))
            known = up._weft_above = _Above(settle(_gathered(rows)), names)
        return known

    def rows(self) -> DataFrame:
        each = self.above.select("c", F.inline(F.arrays_zip("a", "d")))
        child, parent = self.names.select(F.col("id").alias("c"), F.col("name").alias("cn")), self.names.select(F.col("id").alias("a"), F.col("name").alias("an"))
        return each.join(child, "c").join(parent, "a").select(F.col("cn").alias("c"), F.col("an").alias("a"), "d")

    @cached_property
    def within(self) -> DataFrame:
        """Per node the edges (x, y) of all that is above it; y is -1 for an x without parents."""
        each = self.above.select("c", F.inline(F.arrays_zip("a", "d")))
        direct = each.where("d = 1").select(F.col("c").alias("a"), F.col("a").alias("y"))
        edges = each.select("c", "a").join(direct, "a", "left").select("c", F.col("a").alias("x"), F.coalesce("y", F.lit(-1)).alias("y"))
        return settle(edges.repartition("c").groupBy("c").agg(F.collect_list("x").alias("x"), F.collect_list("y").alias("y")))

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (c1, c2) of known nodes with their numbers i1, i2."""
        for c, i in (("c1", "i1"), ("c2", "i2")):
            pairs = pairs.join(self.names.select(F.col("name").alias(c), F.col("id").alias(i)), c)
        return pairs.select("c1", "c2", "i1", "i2")


def closure(edges: DataFrame, child: str = "c", parent: str = "p") -> DataFrame:
    """Reflexive transitive closure with the least number of steps (c, a, d), of any graph, cycles included. Reach doubles with each round: a node further than t steps and
    within 2t is within t of one at just t. So there are as many rounds as the longest distance has binary digits, and one that finds nothing. Rounds send arrays of
    numbers, a row for each node at just t."""
    e = edges.select(F.col(child).alias("c"), F.col(parent).alias("a")).where("c IS NOT NULL AND a IS NOT NULL").distinct()
    edges, (names, e) = e, _numbered(e)
    first = names.select(F.col("id").alias("c"), F.col("id").alias("a"), F.lit(0).alias("d")).unionByName(e.withColumn("d", F.lit(1)))
    above, t = settle(_gathered(first.repartition("c"))), 1
    while True:
        last = above.select("c", F.inline(F.arrays_zip("a", "d"))).where(F.col("d") == t).select("c", "a")
        if last.isEmpty():
            out = (known := _Above(above, names)).rows()
            out._weft_above, out._weft_edges = known, edges
            return out
        further = last.join(above.select(F.col("c").alias("a"), F.col("a").alias("b"), "d"), "a").select("c", F.col("b").alias("a"), "d", F.lit(t).alias("more"))
        both = above.withColumn("more", F.lit(0)).unionByName(further).repartition("c")
        old, above = above, settle(_gathered(both.select("c", "more", F.inline(F.arrays_zip("a", "d"))).select("c", "a", (F.col("d") + F.col("more")).alias("d"))))
        discard(old)
        t *= 2


def direct(edges: DataFrame, child: str = "c", parent: str = "p") -> DataFrame:
    """Of closure() what is at no step or one (c, a, d): all that the functions on pairs of classes need."""
    e = edges.select(F.col(child).alias("c"), F.col(parent).alias("a")).where("c IS NOT NULL AND a IS NOT NULL")
    nodes = e.select("c").union(e.select("a"))
    out = nodes.select("c", F.col("c").alias("a"), F.lit(0).alias("d")).unionByName(e.where("c <> a").withColumn("d", F.lit(1))).distinct()
    out._weft_edges = e
    return out


_PAIRS = 1 << 16  # pairs that a group holds
_BLOCKS = 64  # blocks of 64 pairs that are worked on at once


def _parents(up: DataFrame) -> DataFrame:
    """A row for each node c with the array ps of its parents, kept in partitions by c until unpersist()."""
    e = getattr(up, "_weft_edges", None)
    if e is None:
        e = up.where("d <= 1").select("c", "a")
    each = e.select("c", F.when(F.col("c") != F.col("a"), F.col("a")).alias("a")).union(e.select("a", F.lit(None).cast("string")))
    width = int(up.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(width, "c").groupBy("c").agg(F.collect_set("a").alias("ps")).sortWithinPartitions("c").persist(StorageLevel.DISK_ONLY)


def _met(pairs: DataFrame, up: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *seeds: str) -> DataFrame:
    """work on groups of the pairs (c1, c2) and on all that is above the group's seeds, as rows (c, ps) of a node and its parents; rows may repeat. Groups are ranges by name: names
    that are near each other often have the same ancestors, which a group gets once. A round goes one step up, for all groups; nodes that a group already has are left out
    in rounds 8, 16, 32 and so on, so cycles end."""
    parts = -(-pairs.count() // _PAIRS) or 1
    asked = settle(pairs.select("c1", "c2").repartitionByRange(parts, "c1", "c2").withColumn("g", F.spark_partition_id()))
    graph = _parents(up)
    front, found = reduce(DataFrame.union, [asked.select("g", F.col(x).alias("c")) for x in seeds]).where("c IS NOT NULL"), []
    while True:
        if (n := len(found)) >= 8 and n & (n - 1) == 0:
            again = reduce(DataFrame.union, found).join(front, ["g", "c"], "left_semi")  # few, where front is small
            front = front.join(again, ["g", "c"], "left_anti")
        found.append(settle(front.distinct().join(graph, "c").select("g", "c", "ps")))
        if found[-1].isEmpty():
            break
        front = found[-1].select("g", F.explode("ps").alias("c"))
    graph.unpersist()
    return asked.groupBy("g").cogroup(reduce(DataFrame.union, found).groupBy("g")).applyInArrow(work, schema)


def _spread(bits: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """Adds to the bits at the end of each edge those at its start, until nothing is new. Edges are sorted by their ends."""
    new = bits != 0
    while len(go := np.flatnonzero(new[start])):
        first = np.flatnonzero(np.diff(end[go], prepend=-1))
        to = end[go[first]]
        more = bits[to] | np.bitwise_or.reduceat(bits[start[go]], first)
        new = np.zeros(len(bits), bool)
        new[to] = more != bits[to]
        bits[to] = more


class _Group:
    """The distinct pairs of a group by the numbers of their names, which are sorted, and the parents of each number; -1 is null."""

    def __init__(self, asked: pa.Table, found: pa.Table):
        c, ps = found.column("c").combine_chunks(), found.column("ps").combine_chunks()
        names = pc.unique(pa.chunked_array([c, *asked.column("c1").chunks, *asked.column("c2").chunks], pa.string())).drop_null()
        self.names = names = names.take(pc.sort_indices(names))
        number = lambda x: pc.fill_null(pc.index_in(x, names), -1).to_numpy().astype(np.int64)
        node, once = np.unique(number(c), return_index=True)
        ps = ps.take(pa.array(once))
        count = np.zeros(len(names), np.int64)
        self.known = np.zeros(len(names) + 1, bool)  # the last is that of null
        self.known[node], count[node] = True, pc.list_value_length(ps).to_numpy()
        self.first, self.parents = np.cumsum(count) - count, number(pc.list_flatten(ps))
        self.count = count
        both = np.unique((number(asked.column("c1")) + 1) << 32 | number(asked.column("c2")) + 1)
        self.i1, self.i2 = (both >> 32) - 1, (both & 0xFFFFFFFF) - 1

    def named(self, i: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(i, mask=i < 0))

    def ups(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each edge up from the states, the position of its start and the state at its end."""
        node = state % len(self.names)
        count = self.count[node]
        start = np.repeat(np.arange(len(state)), count)
        at = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count) + self.first[node][start]
        return start, state[start] - node[start] + self.parents[at]

    def lots(self, *seeds: str) -> Iterator[_Lot]:
        ok = np.flatnonzero(np.logical_and.reduce([self.known[i] for i in (self.i1, self.i2)]))
        for at in range(0, len(ok), 64 * _BLOCKS):
            yield _Lot(self, ok[at : at + 64 * _BLOCKS], seeds)


class _Lot:
    """Pairs (at) with known ends, in blocks of 64. A state is a block and a node that is above a seed of it; it has a bit for each pair of the block. Pairs that are near each other
    have most states in common."""

    def __init__(self, group: _Group, at: np.ndarray, seeds: tuple[str, ...]):
        self.group, self.at, self.size = group, at, len(group.names)
        pair = np.arange(len(at))
        self.block, self.bit = pair // 64 * self.size, np.uint64(1) << (pair % 64).astype(np.uint64)
        new = self.states = np.unique(np.concatenate([self.block + getattr(group, i)[at] for i in seeds]))
        while len(new):
            new = np.unique(group.ups(new)[1])
            old = np.minimum(np.searchsorted(self.states, new), len(self.states) - 1)
            new = new[self.states[old] != new]
            self.states = np.sort(np.concatenate([self.states, new]), kind="stable")
        low, end = group.ups(self.states)
        high = np.searchsorted(self.states, end)
        by = np.argsort(high, kind="stable")
        self.up = low[by], high[by]
        self.down = high, low

    def marks(self, nodes: np.ndarray, down: bool = False) -> np.ndarray:
        """Bits of the pairs for which a state is above (or below) the pair's node, itself included; -1 is no node."""
        bits = np.zeros(len(self.states), np.uint64)
        key = self.block + nodes
        at = np.minimum(np.searchsorted(self.states, key), len(bits) - 1)
        some = (nodes >= 0) & (self.states[at] == key)
        np.bitwise_or.at(bits, at[some], self.bit[some])
        _spread(bits, *(self.down if down else self.up))
        return bits

    def each(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the pair and node of each bit that is set."""
        some = np.flatnonzero(bits)
        row, bit = np.nonzero(_bits(bits[some]))
        state = self.states[some[row]]
        return state // self.size * 64 + bit, state % self.size

    def sums(self, bits: np.ndarray) -> np.ndarray:
        """For each pair the number of states that have its bit."""
        n = np.zeros((-(-len(self.at) // 64), 64), np.int64)
        some = np.flatnonzero(bits)
        if len(some):
            block, first = np.unique(self.states[some] // self.size, return_index=True)
            n[block] = np.add.reduceat(_bits(bits[some]), first, axis=0, dtype=np.int64)
        return n.ravel()[: len(self.at)]

    def lowest(self, above1: np.ndarray, above2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the pair and node of each lowest common ancestor: no other common one is a direct child."""
        both = above1 & above2
        low, (start, end) = both.copy(), self.up
        if len(end):
            first = np.flatnonzero(np.diff(end, prepend=-1))
            low[end[first]] &= ~np.bitwise_or.reduceat(both[start], first)
        return self.each(low)


def _bits(words: np.ndarray) -> np.ndarray:
    """A row of 64 numbers 0 or 1 for each word."""
    return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _between(asked: pa.Table, found: pa.Table) -> pa.Table:
    group = _Group(asked, found)
    n = np.where(group.i1 == group.i2, 0, -1)  # each class is above itself, known or not
    for lot in group.lots("i1"):
        n[lot.at] = lot.sums(lot.marks(group.i1[lot.at]) & lot.marks(group.i2[lot.at], down=True)) - 1
    return pa.table({"c1": group.named(group.i1), "c2": group.named(group.i2), "n": pa.array(n, pa.int32())})


def _lowest(asked: pa.Table, found: pa.Table) -> pa.Table:
    group, at, nodes = _Group(asked, found), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lot in group.lots("i1", "i2"):
        pair, node = lot.lowest(lot.marks(group.i1[lot.at]), lot.marks(group.i2[lot.at]))
        at.append(lot.at[pair])
        nodes.append(node)
    pair = np.concatenate(at)
    return pa.table({"c1": group.named(group.i1[pair]), "c2": group.named(group.i2[pair]), "lca": group.named(np.concatenate(nodes))})


def _common(asked: pa.Table, found: pa.Table) -> pa.Table:
    group = _Group(asked, found)
    lca, d1, d2 = (np.full(len(group.i1), -1) for _ in range(3))
    for lot in group.lots("i1", "i2"):
        above1, above2 = lot.marks(group.i1[lot.at]), lot.marks(group.i2[lot.at])
        pair, node = lot.lowest(above1, above2)
        least = np.full(len(lot.at), len(group.names))
        np.minimum.at(least, pair, node)
        least = np.where(least < len(group.names), least, -1)
        below = lot.marks(least, down=True)
        lca[lot.at], d1[lot.at], d2[lot.at] = least, lot.sums(above1 & below) - 1, lot.sums(above2 & below) - 1
    far = lambda d: pa.array(d, pa.int32(), mask=lca < 0)
    return pa.table({"c1": group.named(group.i1), "c2": group.named(group.i2), "lca": group.named(lca), "d1": far(d1), "d2": far(d2)})


def distances(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """Per distinct pair (c1, c2): n, the nodes that are above c1 and below c2, both included, less one; so a node with several ways between counts the nodes of
    all of them. -1 where c2 is not above c1. up: closure() or direct(). What is above c1 is followed down from c2."""
    return _met(pairs.where("c1 IS NOT NULL AND c2 IS NOT NULL"), up, _between, "c1 string, c2 string, n int", "c1")


def lowest_common(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """Per distinct pair (c1, c2): all its lowest common ancestors (lca), those above both that no other one above both is a direct child of. A pair has several where classes have several
    parents, and none where nothing is above both or only classes of a cycle are. up: closure() or direct()."""
    return _met(pairs.where("c1 IS NOT NULL AND c2 IS NOT NULL"), up, _lowest, "c1 string, c2 string, lca string", "c1", "c2")


def common_ancestors(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """Per distinct pair (c1, c2): the lowest common ancestor (of several the least by name; null if there is none) and the distances of both to it."""
    return _met(pairs, up, _common, "c1 string, c2 string, lca string, d1 int, d2 int", "c1", "c2")


def similarities(lcas: DataFrame, up: DataFrame, root: str) -> DataFrame:
    """Wu-Palmer and depth similarity of each pair: 1 for equal classes; without a common ancestor the one is null, the other 0."""
    lcas = settle(lcas)  # read twice
    depth = distances(lcas.select(F.col("lca").alias("c1"), F.lit(root).alias("c2")).distinct(), up).select(F.col("c1").alias("lca"), F.col("n").alias("d0"))
    joined = lcas.join(depth, "lca", "left")
    d0, d1, d2 = F.col("d0"), F.col("d1"), F.col("d2")
    far = lambda d: 1 - F.pow(F.lit(0.5), d)
    same = F.col("c1") == F.col("c2")
    none = F.col("lca").isNull()
    wu = F.when(same, 1.0).when(none, None).otherwise(F.coalesce(F.try_divide(2 * d0, d1 + d2 + 2 * d0), F.lit(0.0)))
    deep = F.when(same, 1.0).when(none, 0.0).otherwise(F.coalesce(F.try_divide(far(d0), far(d1) + far(d2) + far(d0)), F.lit(0.0)))
    return joined.select("c1", "c2", "lca", F.round(wu, 6).alias("wu_palmer"), F.round(deep, 6).alias("depth_sim"))


def or_equivalent(classes: DataFrame, known: DataFrame, equivalent: DataFrame) -> DataFrame:
    """Each class c, or the class that it is equivalent to if it is unknown itself (cls)."""
    k = known.select(F.col("c").alias("__k")).distinct()
    e = equivalent.groupBy("c").agg(F.min("e").alias("e"))
    return classes.join(k, classes["c"] == k["__k"], "left").join(e, "c", "left").select("c", F.coalesce("__k", "e").alias("cls"))
