"""One JSON array read by many tasks."""

import json
import random

import pytest

from weft.sources import arrays, quads


def objects(n, seed=1):
    r = random.Random(seed)
    odd = ['"', "\\", "{", "}", "[", "]", ",", "é🙂", "\n", "x", ' "a": {', "\\\"}"]
    text = lambda k: "".join(r.choice(odd) for _ in range(r.randrange(k)))
    return [{"id": i, "a": text(30), "b": {"c": [text(5), {"d": text(4)}], "e": None}, **({"f": text(400)} if i % 9 == 0 else {})} for i in range(n)]


@pytest.mark.parametrize("size", ["64b", "301b", "16m"])
@pytest.mark.parametrize("indent", [None, 2])
def test_splits_find_their_place(spark, tmp_path, monkeypatch, size, indent):
    if size == "301b":
        monkeypatch.setattr(arrays, "MAX_SPLITS", 0)  # places joined by shuffle
    (tmp_path / "d").mkdir()
    want = []
    for name, n in (("one", 40), ("two", 25), ("none", 0), ("single", 1)):
        rows = objects(n, n)
        want += rows
        (tmp_path / "d" / f"{name}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=n == 25), encoding="utf-8")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        found = arrays.json_objects(spark, str(tmp_path / "d"))
        assert size != "64b" or arrays._pieces(spark, str(tmp_path / "d")).rdd.getNumPartitions() > 50
        got = [json.loads(r.text) for r in found.collect()]
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, keep[k]) if k in keep else spark.conf.unset(k)
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_datasets_and_what_is_no_object(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"triples": "t}", "abstract": "a", "entity": "e"},\n {"triples": "u", "abstract": null, "ent": "f", "class": 3, "more": {"x": 1}}]\n')
    rows = sorted(tuple(r) for r in quads.read_dataset(spark, str(tmp_path / "a.json")).collect())
    assert rows == [("t}", "a", "e", None, 0), ("u", None, "f", None, 3)]
    (tmp_path / "b.json").write_text('["text", {"a": 1}]')
    with pytest.raises(Exception, match="no object"):
        arrays.json_objects(spark, str(tmp_path / "b.json")).collect()


@pytest.mark.parametrize("size", ["40b", "173b", "16m"])
def test_matrices_in_splits(spark, tmp_path, size):
    r, want = random.Random(3), set()
    odd = ['"', "\\", "{", "}", "[", "]", ",", "é🙂", "\n", "x", ' "columns": [', '], "data": [[']
    (tmp_path / "m").mkdir()
    for fold in range(3):
        columns = [f"c {fold}", 'q"u', "third"]
        rows = [["".join(r.choice(odd) for _ in range(r.randrange(12))), r.choice(["1", None]), str(i)] for i in range(25 if fold else 0)]
        want |= {tuple(zip(columns, row, strict=True)) for row in rows}
        wrapped = {"columns": columns, "data": rows, "ncols": 3} if fold % 2 else {"ncols": 3, "note": "a [b] {c}", "data": rows, "columns": columns}
        (tmp_path / "m" / f"f{fold}.json").write_text(json.dumps(wrapped, ensure_ascii=fold == 1), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = [tuple(x.row.items()) for x in quads.read_artifact(spark, str(tmp_path / "m")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {tuple(sorted(x)) for x in got} == {tuple(sorted(x)) for x in want}
