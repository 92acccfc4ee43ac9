"""Class graphs whose classes have several parents, against path search on small graphs."""

import random

import pytest

from weft.operators import graph

DIAMOND = {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "r"), ("e", "c"), ("e", "b"), ("x", "y"), ("y", "x")}


def above(edges, x):
    seen, todo = {x}, [x]
    while todo:
        y = todo.pop()
        for c, p in edges:
            if c == y and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def by_paths(edges, c1, c2):
    return len({m for m in above(edges, c1) if c2 in above(edges, m)}) - 1


def by_search(edges, c1, c2):
    both = above(edges, c1) & above(edges, c2)
    return {x for x in both if not any(p == x and c in both and c != x for c, p in edges)}


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_distances_and_lowest_ancestors_on_any_graph(spark, seed):
    edges = DIAMOND
    if seed:
        r = random.Random(seed)
        edges = {(f"n{a}", f"n{b}") for a, b in ((r.randrange(12), r.randrange(12)) for _ in range(16 + 4 * seed)) if a > b or r.random() < 0.1}
    names = sorted({x for e in edges for x in e})
    known = {x for e in edges for x in e}
    pairs = [(a, b) for a in names for b in names] + [("new", "new"), ("new", "a"), (None, "a")]
    df = spark.createDataFrame(pairs, "c1 string, c2 string")
    up = graph.closure(spark.createDataFrame(sorted(edges), "c string, p string"))
    far = {(r.c1, r.c2): r.n for r in graph.distances(df, up).collect()}
    assert far == {(a, b): by_paths(edges, a, b) for a, b in pairs if a}
    low = {}
    for r in graph.lowest_common(df, up).collect():
        low.setdefault((r.c1, r.c2), set()).add(r.lca)
    assert low == {(a, b): x for a, b in pairs if a in known and b in known and (x := by_search(edges, a, b))}
    sims = {(r.c1, r.c2): r for r in graph.similarities(graph.common_ancestors(df, up), up, "r").collect()}
    assert len(sims) == len(set(pairs))
    for (a, b), r in sims.items():
        want = min(low.get((a, b), {None}), key=lambda x: x or "")
        assert r.lca == want and (r.wu_palmer == 1.0) == (r.depth_sim == 1.0 and a == b or r.wu_palmer == 1.0)
        if a == b:
            assert r.wu_palmer == r.depth_sim == 1.0
        elif want is None:
            assert r.wu_palmer is None and r.depth_sim == 0.0
        elif a:
            d1, d2, d0 = by_paths(edges, a, want), by_paths(edges, b, want), by_paths(edges, want, "r")
            assert r.wu_palmer == pytest.approx(2 * d0 / (d1 + d2 + 2 * d0) if d1 + d2 + 2 * d0 else 0.0, abs=1e-6)


def test_the_diamond_counts_the_nodes_of_both_ways(spark):
    up = graph.closure(spark.createDataFrame(sorted(DIAMOND), "c string, p string"))
    pairs = spark.createDataFrame([("a", "r"), ("a", "e")], "c1 string, c2 string")
    assert {(r.c1, r.c2): r.n for r in graph.distances(pairs, up).collect()} == {("a", "r"): 4, ("a", "e"): -1}
    assert sorted(r.lca for r in graph.lowest_common(pairs.where("c2 = 'e'"), up).collect()) == ["b", "c"]


def test_ancestors_are_sent_as_a_row_for_each_node(spark):
    """Parts under their halves and thirds: rows for each pair of a node and what is above it grew faster than the parts."""
    n = 300
    up = graph.closure(spark.range(1, n).selectExpr("string(id) AS c", "explode(array(string(id div 2), string(id div 3))) AS p"))
    assert up._weft_above.above.count() == n and up._weft_above.within.count() == n
    edges = {(str(k), str(k // q)) for k in range(1, n) for q in (2, 3)}
    pairs = spark.createDataFrame([("288", "289"), ("288", "144"), ("216", "162"), ("7", "0")], "c1 string, c2 string")
    assert {(r.c1, r.c2): r.n for r in graph.distances(pairs, up).collect()} == {(a, b): by_paths(edges, a, b) for a, b in (("288", "289"), ("288", "144"), ("216", "162"), ("7", "0"))}
    assert {r.lca for r in graph.lowest_common(pairs.where("c1 = '216'"), up).collect()} == by_search(edges, "216", "162")


def test_groups_of_pairs_get_what_is_above_them(spark, monkeypatch):
    """Many small groups, a cycle longer than the rounds without a look at what is known, a chain, nulls, unknown classes and pairs that occur twice."""
    r = random.Random(5)
    edges = {(f"n{a}", f"n{b}") for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(60)) if a > b}
    edges |= {(f"y{i}", f"y{(i + 1) % 11}") for i in range(11)} | {(f"z{i}", f"z{i + 1}") for i in range(3)} | {("y3", "n7"), ("z3", "y0"), ("y5", "y5")}
    known = sorted({x for e in edges for x in e})
    pairs = [(a, b) for a in r.sample(known, 18) for b in r.sample(known, 12)] + [("new", "new"), ("new", "n3"), (None, "n3"), ("y1", "y1"), ("y1", "y9"), ("z0", "n0"), ("z0", "y10")]
    df = spark.createDataFrame(pairs * 2, "c1 string, c2 string")
    up = graph.direct(spark.createDataFrame(sorted(edges) * 2, "c string, p string"))
    monkeypatch.setattr(graph, "_PAIRS", 40)
    far = graph.distances(df, up).collect()
    assert sorted((x.c1, x.c2, x.n) for x in far) == sorted({(a, b, by_paths(edges, a, b)) for a, b in pairs if a})
    low = graph.lowest_common(df, up).collect()
    want = {(a, b, x) for a, b in pairs if a in known and b in known for x in by_search(edges, a, b)}
    assert sorted((x.c1, x.c2, x.lca) for x in low) == sorted(want)
    best = {(a, b): min(x for *p, x in want if p == [a, b]) for a, b, _ in want}
    for x in (rows := graph.common_ancestors(df, up).collect()):
        lca = best.get((x.c1, x.c2))
        assert (x.lca, x.d1, x.d2) == (lca, *(lca and by_paths(edges, c, lca) for c in (x.c1, x.c2)))
    assert len(rows) == len(set(pairs))


def test_pairs_need_no_closure(spark, monkeypatch):
    """Parts under their halves and thirds: the rows that are written grow with the parts, not with all that is above each. No closure is made."""
    n, rows, settle = 3000, [], graph.settle
    edges = spark.range(1, n).selectExpr("concat('part/', id) AS c", "explode(array(concat('part/', id div 2), concat('part/', id div 3))) AS p")
    pairs = spark.range(n).selectExpr("concat('part/', id) AS c1", "concat('part/', id + 1) AS c2")
    monkeypatch.setattr(graph, "_PAIRS", n // 8)

    def count(df):
        out = settle(df)
        rows.append(out.selectExpr("count(*) + coalesce(sum(size(ps)), 0)" if "ps" in df.columns else "count(*)").first()[0])
        return out

    monkeypatch.setattr(graph, "settle", count)
    monkeypatch.setattr(graph, "closure", None)
    each = lambda k: {k} | (each(k // 2) | each(k // 3) if k else set())
    both = {k: each(k) & each(k + 1) for k in range(n - 1)}
    want = {(k, x) for k, b in both.items() for x in b if not any(x in (t // 2, t // 3) and t != x for t in b if t)}
    assert {(int(x.c1[5:]), int(x.lca[5:])) for x in graph.lowest_common(pairs, graph.direct(edges)).collect()} == want
    assert sum(rows) < sum(len(each(k)) for k in range(n)) / 2


def test_lots_of_pairs_in_a_group():
    """More pairs than are worked on at once, with the nodes of the group in any order and more than once."""
    import pyarrow as pa

    n = 3000
    asked = pa.table({c: [f"part/{k + i * 7}" for k in range(n) for i in (j, 2 * j)] for j, c in enumerate(("c1", "c2"))})
    nodes = [f"part/{k}" for k in [*range(n), *range(0, n, 3)]]
    random.Random(1).shuffle(nodes)
    up = lambda c: sorted({f"part/{int(c[5:]) // q}" for q in (2, 3)}) if c != "part/0" else []
    got = graph._common(asked, pa.table({"c": nodes, "ps": pa.array([up(c) for c in nodes], pa.list_(pa.string()))})).to_pylist()
    each = lambda c: {c}.union(*(each(p) for p in up(c)))
    assert len(got) == len(set(zip(*(asked.column(c).to_pylist() for c in ("c1", "c2"))))) > 64 * graph._BLOCKS
    for x in random.Random(2).sample(got, 200):
        a, b = (each(x[c]) if int(x[c][5:]) < n else set() for c in ("c1", "c2"))
        lca = min((y for y in a & b if not any(y in up(z) for z in a & b)), default=None)
        assert x["lca"] == lca and (lca is None or (x["d1"], x["d2"]) == tuple(sum(lca in each(z) for z in s) - 1 for s in (a, b)))
