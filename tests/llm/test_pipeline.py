import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import jaccard_brute, prose
from weft.llm import decontaminate, mixing
from weft.llm.base import load


def test_stages_keep_what_they_must(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns, name
        if name == "n-gram Jaccard join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, _) in jaccard_brute(rows).items() if c == i)
        if name == "benchmark decontamination":
            gone = {r.doc_id for r in decontaminate.leaks(before, load(spark, sf_dir, "benchmark")).collect()}
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect()} - gone
    n = kept.count()
    last = corpus_pipeline.STAGES[4][1](spark, kept, sf_dir)
    assert last.count() == n > 0


def test_odd_documents(spark, sf_dir):
    rows = [(1, prose(1, 60), "en", "s", 1, "x"), (1, prose(1, 60), "en", "s", 1, "x"), (None, prose(2, 60), None, None, None, None), (3, None, "en", "s", 0, "x"), (4, "", "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, rejected string")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert {r.doc_id for r in docs.collect()} <= {1, None}
    empty = load(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_mix_meets_its_targets(spark, sf_dir):
    sizes = {"a": 500, "b": 200, "c": 500, "d": 500, "e": 200, None: 100}  # of c, the mix takes 0.375 times its words
    rows = [(1000 * n + i if i % 50 else None, prose(1000 * n + i, 60 + i * 7 % 400), "en", s) for n, s in enumerate(sizes) for i in range(sizes[s])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(8).cache()
    want = {r.source: r.target for r in mixing.Mix(docs, corpus_pipeline.SHARE, corpus_pipeline.WEIGHTS).rows.select("source", "target").distinct().collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    size = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert want["c"] < 0.4 * size["c"] and {s: got.get(s, 0) / t for s, t in want.items()} == {s: pytest.approx(1, abs=0.02) for s in want}
    again = corpus_pipeline.mix_sources(spark, docs.repartition(5), sf_dir)
    assert mixed.exceptAll(again).count() == again.exceptAll(mixed).count() == 0


def test_rows_are_judged_by_their_own_texts(spark, sf_dir):
    """Rows that share an id, or have none, neither go with others nor stay beside them."""
    one, other = prose(70, 80), prose(71, 80)
    item = load(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    rows = [(1, one, "a"), (2, one, "a"), (2, other, "a"), (2, other, "b"), (None, one, "a"), (None, prose(72, 80), "a"), (None, prose(72, 80), "a"), (3, item, "a"), (3, prose(73, 80), "a"), (None, f"{item} end", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, key int, `a.b` string")
    first = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    kept = sorted((r.doc_id or 0, r.text) for r in first.collect())
    assert first.columns == docs.columns
    assert kept in (sorted([(0, prose(72, 80)), (1, one), (2, other), (3, item), (3, prose(73, 80))]), sorted([(0, prose(72, 80)), (0, f"{item} end"), (1, one), (2, other), (3, item), (3, prose(73, 80))]))
    assert sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, sf_dir).collect()) == sorted((i or 0, t) for i, t, _ in rows if item not in t)
    assert corpus_pipeline.mix_sources(spark, docs, sf_dir).columns == docs.columns


def test_whole_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    docs = load(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n")).toPandas().set_index("doc_id").n
    assert set(got.columns) == {"doc_id", "size", "shard", "slot"} and set(got.doc_id) <= set(docs.index)
    assert (got["size"] == got.doc_id.map(docs) + 16).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    size = got.groupby("shard")["size"].sum().reindex(range(corpus_pipeline.N_SHARDS), fill_value=0)
    assert (size - size.mean()).abs().max() <= 0.08 * size.mean() + got["size"].max()
