"""The graph store and N-Triples files."""

import os
import re

import pytest
from pyspark.sql import functions as F

from weft.sources import quads

LINES = [
    '<http://x/s> <http://x/p> "plain" .', "_:a <http://x/p> _:b.", '_:a.b-c<http://x/p>"tight"@en-GB.', r'<http://x/é> <http://x/p> "tab\t quote\" \\ é \U0001F600 \x \uD800"^^<http://x/dA> . # comment',
    '<http://x/s> <http://x/p> "" .', "  <http://x/s>\t<http://x/p>\t<http://x/o>\t.\t", "# comment", "", "   ", "no triple", "<http://x/s> <http://x/p> .", '<http://x/s> _:p "blank predicate" .', '<http://x/s> <http://x/p> "open .',
    "<http://x/s p> <http://x/p> <http://x/o> .", '<http://x/s> <http://x/p> "two" "literals" .', '<http://x/s> <http://x/p> "' + "long \\\" " * 3000 + '" .',
]


def test_ntriples_with_blank_nodes_and_escapes(spark, tmp_path):
    for name in ("one.nt", "two.nt"):
        (tmp_path / name).write_text("\n".join(LINES), encoding="utf-8")
    rows = quads.read_ntriples(spark, str(tmp_path), "g").collect()
    bare = lambda x: re.sub(r"^_:[0-9a-f]{16}\.", "_:", x)
    got = {(bare(r.s), r.p, bare(r.o), r.k, r.dt, r.lang) for r in rows}
    p = "http://x/p"
    assert got == {
        ("http://x/s", p, "plain", "literal", None, None), ("_:a", p, "_:b", "bnode", None, None), ("_:a.b-c", p, "tight", "literal", None, "en-GB"), ("http://x/é", p, 'tab\t quote" \\ é 😀 \\x �', "literal", "http://x/dA", None),
        ("http://x/s", p, "", "literal", None, None), ("http://x/s", p, "http://x/o", "iri", None, None), ("http://x/s", p, 'long " ' * 3000, "literal", None, None),
    }
    assert len(rows) == 2 * len(got)
    labels = {r.s for r in rows if r.s.endswith(".a")} | {r.o for r in rows if r.o.endswith(".b")}
    assert len(labels) == 4  # a label names another node in each file, and the same one within a file
    rejects = quads.ntriples_rejects(spark, str(tmp_path)).collect()
    assert len(rejects) == 12 and {os.path.basename(r.file) for r in rejects} == {"one.nt", "two.nt"}
    assert len(rejects) + len(rows) + 2 * 3 == 2 * len(LINES)


GRAPHS = ["http://x/g1", "a=b/c?d%e", "5", "2020-01-01", "ü n", None]


def some(spark, graphs, n=40):
    return spark.createDataFrame([(g, f"s{i}", "p", str(i % 7), "literal") for g in graphs for i in range(n)], "g string, s string, p string, o string, k string")


@pytest.mark.parametrize("graph", GRAPHS)
def test_graphs_of_any_name_are_dropped(spark, tmp_path, graph):
    path = str(tmp_path / "store")
    quads.write_store(some(spark, GRAPHS), path)
    quads.drop_graph(spark, path, graph)
    left = {r.g: r.n for r in quads.read_store(spark, path).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert left == {g: 40 for g in GRAPHS if g != graph}
    with pytest.raises(FileNotFoundError):
        quads.drop_graph(spark, path, graph)


def test_names_that_look_like_numbers_stay_text(spark, tmp_path):
    path = str(tmp_path / "store")
    quads.write_store(some(spark, ["007", "8"]), path)
    assert sorted(r.g for r in quads.read_store(spark, path).select("g").distinct().collect()) == ["007", "8"]
    assert quads.insert_missing(some(spark, ["007", "9"], 50), path) == 60


def test_a_large_graph_has_several_files_and_a_small_one_one(spark, tmp_path):
    path, coalesce = str(tmp_path / "store"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # tables as small as this one become one partition else
    quads.write_store(some(spark, ["big"], 2000).unionByName(some(spark, ["small"], 30)).repartition(5), path, file_rows=100)
    spark.conf.unset(coalesce)
    assert quads.read_store(spark, path).count() == 2030
    files = lambda g: [f for f in os.listdir(f"{path}/g={g}") if f.endswith(".parquet")]
    assert len(files("big")) > 3 and len(files("small")) == 1


def test_repeated_and_null_quads(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("g", "s", "p", None, "literal")] * 3 + [("g", "s", "p", "o", "iri")], "g string, s string, p string, o string, k string")
    quads.write_store(rows, path)
    assert quads.read_store(spark, path).count() == 2 and quads.insert_missing(rows, path) == 0
