import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import cutting, packing, queries
from weft.llm.tokens import Remembered, WordIds, byte_names

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, rid string, length int, start string, ids string, rank long"
ODD = [None, "", " ", "\n\n", "It's we'll DON'T İstanbul ŉ é é Σας ΑΣ ﬁ 漢字 ½ ²3", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "x\x1cy\x85z q　r s", "\x00 a\tb\r\nc\x0bd\x0ce\x01 \x7f", "'S's '' 'll", "ßẞ ÀÖ×÷ø Ā Į į İ", "e ́b", "💥é", "a" * 5000, "word " * 3000]


@pytest.fixture(scope="module")
def encoder():
    return WordIds(PATH)


def whole(encoder, texts):
    return [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def some_texts(n, seed=1):
    r = random.Random(seed)
    return [" ".join(r.choice(["Straße", "it's", "the", "été,", "x9", "“quoted”", "foo-bar", "Łódź"]) for _ in range(int(r.lognormvariate(3, 1)))) for _ in range(n)]


def test_words_are_encoded_as_whole_texts_are(encoder, spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert encoder.plain
    for _ in range(2):  # the second time from memory
        ids, counts = encoder(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == whole(encoder, texts)
    ids, counts = WordIds(PATH, separable=False)(pa.array(ODD))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == whole(encoder, ODD)


def test_remembered_words_are_bounded():
    asked = []
    seen = Remembered(lambda words: asked.extend(words) or [w * 2 for w in words], limit=3)
    assert seen("abcab") == ["aa", "bb", "cc", "aa", "bb"] and asked == ["a", "b", "c"]
    assert seen("def") == ["dd", "ee", "ff"] and seen("a") == ["aa"] and asked == list("abcdef")
    for i in range(50):
        seen([f"x{i}", f"y{i}"])
        assert len(seen.young) + len(seen.old) <= 2 * (3 + 3)  # the limit and what one call adds, twice
    assert seen("a") == ["aa"] and asked[-1] == "a"


def test_names_of_bytes_are_those_of_the_vocabulary(encoder):
    names = byte_names()
    assert len(set(names.values())) == 256 and all(n in encoder.tokenizer.get_vocab() for n in names.values())


def held(rows, docs, encoder, capacity=2048, end=1):
    """Whether rows (doc_id, start, length, doc_tokens, sequence_id, offset, crc) are a packing of docs; gives the padding."""
    want = Counter()
    for (i, _), ids in zip(docs, whole(encoder, [t for _, t in docs]), strict=True):
        want[(i, np.array([*ids, end], "<u4").tobytes())] += 1
    for i in {i for i, _ in docs}:  # rows that share an id: compare all pieces of the id
        mine = [r for r in rows if r.doc_id == i]
        texts = [w for (j, w), n in want.items() if j == i for _ in range(n)]
        assert sum(r.length for r in mine) * 4 == sum(map(len, texts))
        assert all(any(zlib.crc32(w[4 * r.start : 4 * (r.start + r.length)]) == r.crc and 4 * r.doc_tokens == len(w) for w in texts) for r in mine)
        if len(texts) == 1:
            ends = list(itertools.accumulate(r.length for r in sorted(mine, key=lambda r: r.start)))
            assert [r.start for r in sorted(mine, key=lambda r: r.start)] == [0, *ends[:-1]]
    by, padding = {}, 0
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def pack(spark, docs, parts=3, **options):
    df = spark.createDataFrame([(i, t, "r", 5, "s", "i", 9) for i, t in docs], SCHEMA).repartition(parts)
    return packing.packed(df, PATH, **options).withColumn("crc", F.crc32("ids")).collect()


@pytest.mark.parametrize("capacity", [32, 100, 2048])
def test_every_id_once_and_little_padding(spark, encoder, capacity):
    docs = list(enumerate(ODD + some_texts(300)))
    rows = pack(spark, docs, capacity=capacity)
    assert held(rows, docs, encoder, capacity) <= 0.01 * sum(r.length for r in rows)


def test_repeated_rows_null_ids_and_tables_of_few_rows(spark, encoder):
    docs = [(1, "a b c")] * 40 + [(None, "d e"), (None, None), (2, "x " * 5000), (2, "x " * 5000)]
    assert held(pack(spark, docs), docs, encoder) <= 2048
    assert pack(spark, [], 1) == []
    assert [(r.start, r.length, r.doc_tokens, r.offset) for r in pack(spark, [(7, None)], 1)] == [(0, 1, 1, 0)]


def test_query_packs_all_documents(spark, sf_dir, encoder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op13_pattern_packing(spark, sf_dir).withColumnRenamed("ids_crc32", "crc").collect()
    assert held(rows, docs, encoder) <= 0.005 * sum(r.length for r in rows)
    assert len(rows) <= 1.2 * len(docs) + sum(r.length for r in rows) / 2048


def test_knapsack_finds_the_best_bags():
    lengths, counts, prices = np.array([3, 5, 6, 7]), np.array([2, 1, 1, 3]), np.array([1.0, 2.5, 2.0, 3.1])
    sack = cutting.Knapsack(lengths, counts, prices, 20)
    for total in range(21):
        best = max((sum(p * n for p, n in zip(prices, bag, strict=True)) for bag in itertools.product(*(range(c + 1) for c in counts)) if lengths @ bag == total), default=-np.inf)
        assert sack.value[total] == pytest.approx(best)
        if best > -np.inf:
            bag = sack.bag(total)
            assert sum(lengths[i] * n for i, n in bag.items()) == total and all(n <= counts[i] for i, n in bag.items())
            assert sum(prices[i] * n for i, n in bag.items()) == pytest.approx(best)
    assert sack.bag(5, 1) is None  # both pieces of length 5 are needed, one is there


def test_columns_lower_the_cost_to_that_of_the_best_patterns():
    """Fractions of full sequences hold all of these; slacks alone would cost 14."""
    lengths, counts = np.array([10, 20, 30, 40, 50, 70, 80]), np.array([1, 2, 2, 1, 1, 1, 1])
    bags, cost = cutting.relax(lengths, counts, 100, 4.0, tables=50)
    assert cost == pytest.approx(0, abs=0.02) and all(sum(lengths[i] * a for i, a in bag.items()) == 100 for bag, _ in bags)
    for seed in range(5):
        rng = np.random.default_rng(seed)
        lengths, counts = np.unique(rng.integers(1, 256, 300), return_counts=True)
        bags, left = cutting.plan(lengths, counts, 256, 4.0)
        used = Counter()
        for bag, n in bags:
            assert sum(length * a for length, a in bag.items()) <= 256
            for length, a in bag.items():
                used[length] += a * n
        assert [used[int(x)] + k for x, k in zip(lengths, left, strict=True)] == counts.tolist()
        _, least = cutting.relax(lengths, counts, 256, 4.0, tables=100)
        assert left @ lengths <= least * 256 / 4.0 + 256  # rounding leaves a sequence more than the program at most
