import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weft.llm import alignment, queries
from weft.llm.base import materialize

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, links string, pair int, rid string, best int"
ODD = [None, "", " ", "  ", "ab ", "ab  ", "  ab", "a  b   c", "\n", "a\n b\t c\r\n  d ", "x▁y", "▁", "naïve ﬁ é é Ａ", "漢字 かな 💥é", "<|endoftext|> a <s></s> <unk><0x41>", "\x00a \x01", "it's 12345 we'll", "q　r s\x85t  u  v", "a" * 3000, "-" * 999, "word " * 2000]


@pytest.fixture(scope="module")
def encoder():
    return alignment.Encoder(A, B)


def brute(encoder, texts):
    """By text, from whole texts and byte offsets: counts, groups and links; then n_best and count_sum."""
    out, count = [], Counter()
    for t in texts:
        full = (" " + (t or "")).encode()
        a, b = encoder.a.encode(full.decode(), add_special_tokens=False).ids, encoder.b.encode(t or "")
        if not t or b"".join(encoder.bytes_a[i] for i in a) != full or b"".join(encoder.bytes_b[i] for i in b) != full:
            out.append((0, 0, "", []))
            continue
        ends = []
        for ids, name in ((a, encoder.bytes_a), (b, encoder.bytes_b)):
            at, mine = 0, {}
            for k, i in enumerate(ids):
                at += len(name[i])
                mine[at] = k
            ends.append(mine)
        groups, links, p, q = [], [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            i, j = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            links.append((a[i - 1], b[j - 1]))
            p, q = i, j
        count.update(links)
        out.append((len(a), len(b), ";".join(groups), links))
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(n_a, n_b, len(x), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), g) for n_a, n_b, g, x in out]


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "a", "l", 1, "r", 2) for i, t in rows], SCHEMA).repartition(parts)
    found = materialize(alignment.align(df, A, B).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    got = alignment.score(found, alignment.pair_counts(found)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got)


def want(encoder, rows):
    return sorted((-1 if i is None else i, *x) for (i, _), x in zip(rows, brute(encoder, [t for _, t in rows]), strict=True))


def mixed(n, seed=2):
    r = random.Random(seed)
    words = ["the", "Straße", "it's", "x9", "“quoted”", "foo-bar", "Łódź", "unhappiness", "\n", "", "\t", "tokenization", "éclair", "12,345.67"]
    return [" ".join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(n)]


def test_odd_texts_repeated_rows_and_null_ids(spark, encoder):
    assert encoder.separable
    rows = list(enumerate(ODD + mixed(120))) + [(5, "a b c")] * 30 + [(None, "a b"), (None, None)]
    assert run(spark, rows) == want(encoder, rows)


def test_no_common_pairs_are_sent_and_all_are_joined(spark, encoder, monkeypatch):
    rows = list(enumerate(mixed(60, 3)))
    for hot in (1, 50):
        monkeypatch.setattr(alignment, "HOT", hot)
        assert run(spark, rows) == want(encoder, rows)


def test_tables_without_rows_or_tokens(spark, encoder):
    assert run(spark, [], 1) == []
    assert run(spark, [(1, None), (2, "")], 1) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_transducer_on_all_cuts_of_a_text():
    """Two vocabularies of all substrings of a text with repeats; every pair of its cuts."""
    text = b"abaab"
    names = sorted({text[i:j] for i in range(5) for j in range(i + 1, 6)})
    number = {n: i for i, n in enumerate(names)}
    cuts = [[0, *(k + 1 for k in range(4) if bits >> k & 1), 5] for bits in range(16)]
    for limit in (10**6, 3):  # the second forgets its transitions again and again
        align = alignment.Transducer(names, names, limit)
        for x in cuts:
            for y in cuts:
                a, b = ([number[text[i:j]] for i, j in zip(c, c[1:])] for c in (x, y))
                both = sorted(set(x) & set(y) - {0})
                assert align(a, b) == [(x.index(e), y.index(e)) for e in both]
                assert align(a, [*b, number[b"a"]]) is None and align(a[:-1], b) is None
        assert align([number[b"ab"]], [number[b"aa"]]) is None and align([], []) == []


def test_transitions_are_remembered(encoder):
    align = alignment.Transducer(encoder.bytes_a, encoder.bytes_b)
    a, b = encoder.a.encode(" unhappiness and tokenization", add_special_tokens=False).ids, encoder.b.encode("unhappiness and tokenization")
    first, known = align(a, b), dict(align.next)
    assert known and align(a, b) == first and align.next == known


def test_query_on_all_documents(spark, sf_dir, encoder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    got = sorted(tuple(r) for r in queries.op11_dangling_alignment(spark, sf_dir).collect())
    assert got == [(*r[:-1], digest(r[-1])) for r in want(encoder, rows)]
