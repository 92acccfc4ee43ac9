import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from conftest import same_rows
from pyspark.sql import functions as F

from weft.llm import bitslices, bytespans, decontaminate, jaccard, langid, licenses, mixing, queries, shards, spans, warc, wordspans
from weft.llm.hashing import prefix, words

SCHEMA = "doc_id long, text string, lang string, source string, score string, n_words string"


def table(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", "x", "y") for i, t in texts], schema)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """Nulls, empty and short texts, copies, near copies, shared passages, long and repetitive texts, ties of ids."""
    base, shared = prose(1, 300), prose(2, 40)
    texts = [None, "", " ", "ab", "é" * 60, base, base, base.replace("w7 ", "w8 "), shared, f"{prose(3, 50)} {shared} {prose(4, 50)}", f"{shared}\n{prose(5, 9)}", "a" * 500, "a" * 300, "x y " * 200, prose(6, 4000, 50), prose(6, 3990, 50) + " end", "a b c d", "A, b! c d"]
    return [(i, t) for i, t in enumerate(texts)]


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def byte_brute(rows, n=50):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            seen[b[p : p + n]] = min(i, seen.get(b[p : p + n], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def word_brute(rows, n=13):
    cut = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen, out = {}, {}
    for i in sorted(cut):
        for p in range(len(cut[i]) - n + 1):
            seen.setdefault(tuple(cut[i][p : p + n]), i)
    for i, w in cut.items():
        gone = [0] * len(w)
        for p in range(len(w) - n + 1):
            if seen[tuple(w[p : p + n])] < i:
                gone[p : p + n] = [1] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_bytes_against_brute_force(spark):
    rows = corpus()
    got = bytespans.dedup(table(spark, rows)).select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == byte_brute(rows)


def test_words_against_brute_force(spark):
    rows = corpus()
    got = wordspans.dedup(table(spark, rows)).select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == word_brute(rows)


def near_copies(n=40):
    """A base text with a few words changed in each copy, so that its anchors have many different regions."""
    r, base = random.Random(12), prose(12, 250, 10**6).split()
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(6):
            own[r.randrange(len(own))] = f"x{r.randrange(999)}"
        out.append((1000 + k, f"{prose(300 + k, 20)} {' '.join(own)}"))
    return out


@pytest.mark.parametrize("part_bytes", [1 << 9, 4 << 20])
@pytest.mark.parametrize("hot", [0, 3, 10**6])
def test_split_anchors_against_brute_force(spark, monkeypatch, part_bytes, hot):
    monkeypatch.setattr(spans, "PART_BYTES", part_bytes)
    monkeypatch.setattr(bytespans, "HOT", hot)
    monkeypatch.setattr(wordspans, "HOT", hot)
    rows = corpus()[:16] + near_copies()
    got = bytespans.dedup(table(spark, rows)).select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == byte_brute(rows)
    got = wordspans.dedup(table(spark, rows)).select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == word_brute(rows)


@pytest.mark.parametrize("n", [3, 13, 130, 200])
def test_window_lengths_against_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(spans, "PART_BYTES", 1 << 11)
    monkeypatch.setattr(bytespans, "HOT", 5)
    monkeypatch.setattr(wordspans, "HOT", 2)
    rows = corpus()[4:16] + near_copies(12)
    got = bytespans.dedup(table(spark, rows), n).select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == byte_brute(rows, n)
    got = wordspans.dedup(table(spark, rows), n).select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == word_brute(rows, n)


def test_span_queries_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op6_bwt_substrings(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == byte_brute(rows)
    got = queries.op8_rlz_windows(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == word_brute(rows)


def test_names_are_dealt_evenly(spark):
    for n, partitions in ((1, 8), (256, 51), (1000, 7), (40, 211)):
        names = spans.even_names(n, partitions)
        assert len(set(names.tolist())) == n
        dealt = spark.createDataFrame([(x,) for x in names.tolist()], "x long").groupBy(F.pmod(F.hash("x"), F.lit(partitions))).count().toPandas()["count"]
        assert dealt.max() <= -(-n // partitions) and dealt.sum() == n


def test_expansion_finds_the_classes():
    r = np.random.default_rng(1)
    for _ in range(200):
        n, lengths = int(r.integers(1, 7)), r.integers(7, 20, r.integers(1, 9))
        text, starts = r.integers(97, 97 + r.integers(1, 4), lengths.sum()).astype(np.uint8), np.concatenate([[0], np.cumsum(lengths)])
        ids, windows = r.integers(0, 5, len(lengths)), lengths - n + 1
        strings = [text[i:j].tobytes() for i, j in zip(starts, starts[1:])]
        least = {}
        for i, t in zip(ids, strings, strict=True):
            for p in range(len(t) - n + 1):
                least[t[p : p + n]] = min(i, least.get(t[p : p + n], 9))
        assert list(bytespans.least_ids(n, windows, starts, text, ids)) == [least[t[p : p + n]] for t in strings for p in range(len(t) - n + 1)]


def test_factors_are_long():
    shared = words(np.frombuffer(prose(5, 300, 10**6).encode(), np.uint8), np.array([0, len(prose(5, 300, 10**6))]))[0]
    other = words(np.frombuffer(prose(6, 50, 10**6).encode(), np.uint8), np.array([0, len(prose(6, 50, 10**6))]))[0]
    text = np.concatenate([shared, other, shared[20:280], other[:12], shared[50:90]])
    begin, end = np.array([0, 350]), np.array([350, len(text)])
    index = wordspans.Index(13, prefix(text), begin, end, np.array([1, 2]))
    found, lengths = index.parse(begin, end, np.array([1, 2]))
    assert list(lengths) == [260, 40]
    assert sorted(found) == [*range(350, 350 + 248), *range(350 + 272, 350 + 300)]


@pytest.mark.parametrize("dedup", [bytespans.dedup, wordspans.dedup])
def test_spans_edge_cases(spark, dedup):
    assert dedup(table(spark, [])).count() == 0
    long = prose(9, 100)
    got = {r.doc_id: len(r.spans) for r in dedup(table(spark, [(None, long), (5, long)])).collect()}
    assert got == {None: 1, 5: 0}  # a null id counts as the largest
    assert [len(r.spans) for r in dedup(table(spark, [(5, long), (5, long)])).collect()] == [0, 0]


@pytest.mark.parametrize(("dedup", "n", "cut"), [(bytespans.dedup, 50, lambda t: list(t.encode())), (wordspans.dedup, 13, str.split)])
def test_spans_of_shared_ids_in_several_parts(spark, monkeypatch, dedup, n, cut):
    monkeypatch.setattr(spans, "PART_BYTES", 1 << 8)
    shared, other = prose(40, 60), prose(41, 60)
    rows = [(None, f"{prose(50 + k, 9)} {shared} {prose(80 + k, 9)}") for k in range(12)]
    rows += [(9, f"{prose(110 + k, 9)} {other} {prose(140 + k, 9)}") for k in range(12)]
    rows += [(7, " ".join(shared.split()[:30]) + " " + prose(170, 20)), (8, prose(171, 20) + " " + " ".join(other.split()[25:]))]
    windows = [[tuple(u[p : p + n]) for p in range(len(u) - n + 1)] for u in (cut(t) for _, t in rows)]
    number, least, want = lambda i: spans.NO_ID if i is None else i, {}, []
    for (i, _), own in zip(rows, windows, strict=True):
        for w in own:
            least[w] = min(number(i), least.get(w, spans.NO_ID))
    for (i, t), own in zip(rows, windows, strict=True):
        gone = np.zeros(len(own) + n - 1, bool)
        for p, w in enumerate(own):
            if least[w] < number(i):
                gone[p : p + n] = True
        want.append((number(i), len(gone), int(gone.sum())))
    got = dedup(table(spark, rows)).select("doc_id", "n_bytes" if n == 50 else "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])).collect()
    assert sorted((number(r[0]), r[1], r[2]) for r in got) == sorted(want)


def jaccard_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in sets}


def test_jaccard_against_brute_force(spark, monkeypatch):
    rows = corpus() + [(100 + k, f"{prose(20, 200)} tail{k}") for k in range(60)]
    want = jaccard_brute(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(table(spark, rows)).collect()} == want
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # the group of 60 as pairs of blocks
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(table(spark, rows)).collect()} == want


def test_jaccard_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = jaccard_brute(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in queries.op9_bayes_jaccard(spark, sf_dir).collect()} == want
    assert any(c != i for i, (c, _) in want.items())


def test_jaccard_edge_cases(spark):
    assert jaccard.join(table(spark, [])).count() == 0
    got = jaccard.join(table(spark, [(None, "a b c d e f"), (1, None), (2, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in got) == [(0, 0, 0), (1, 1, 0), (2, 2, 1), (2, 2, 1)]


def test_pruning_bounds():
    least = jaccard.least_matches()
    assert list(least) == [40, 80, 120, 160, 200] and all(0.3 < m / n < 0.8 for n, m in least.items())


def test_leaks(spark):
    item = prose(30, 30)
    docs = [(1, f"{prose(31, 200)} {item.upper()}! {prose(32, 9)}"), (2, prose(33, 100)), (3, None), (4, ""), (5, item.rsplit(" ", 3)[0]), (5, item)]
    items = spark.createDataFrame([(7, item, "z"), (8, "too short", "z"), (9, None, "z")], "item_id long, text string, doc_id string")
    got = sorted(tuple(r) for r in decontaminate.leaks(table(spark, docs), items).collect())
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 7, 26), (5, 7, 26)]
    assert decontaminate.leaks(table(spark, []), items).count() == 0
    assert decontaminate.leaks(table(spark, docs), items.limit(0)).count() == 0


def leaks_brute(docs, items, threshold=0.8):
    cut = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if x]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [cut(t)] for i in range(len(w) - 4)}
    sets, out = [(i, grams(t)) for i, t in docs], {}
    for item, t in items:
        if want := grams(t):
            for i, held in sets:
                if len(want & held) >= threshold * len(want) - 1e-9:
                    out[i, item] = max(out.get((i, item), 0), len(want & held))
    return out


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_leaks_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", broadcast)
    r = random.Random(8)
    items = [(k, prose(400 + k, n, 10**5)) for k, n in enumerate((5, 6, 8, 9, 12, 15, 16, 30, 40, 70, 150, 150))] + [(90, "a b c d"), (91, None)]
    docs = []
    for k in range(60):  # documents of all sizes that hold parts of items
        item = items[k % 12][1].split()
        at = r.randrange(max(1, len(item) // 4))
        part = item[at : at + max(5, int(len(item) * r.uniform(0.7, 1.0)))]
        docs.append((k, f"{prose(500 + k, 4 ** (k % 8), 10**5)} {' '.join(part)} {prose(600 + k, 30, 10**5)}"))
    docs += [(100, None), (101, ""), (7, items[3][1]), (102, items[9][1]), (102, items[9][1])]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.n_shared for x in decontaminate.leaks(table(spark, docs), frame).collect()}
    want = leaks_brute(docs, items)
    assert len(want) > 20 and got == want


def test_leak_search_alone(spark, sf_dir):
    """The candidates hold what they must with the probability that the sketch promises; here, all of it."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.n_shared for r in queries.op3_benchmark_leaks(spark, sf_dir).collect()}
    assert got == leaks_brute(docs, items) and got
    assert [decontaminate.load_bits(q, 0.8) for q in (1, 4, 8, 16, 32, 64)] == sorted(decontaminate.load_bits(q, 0.8) for q in (1, 4, 8, 16, 32, 64))


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op1_compression_langid(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    model = langid.fit(docs)
    plain = docs.where("lang = 'en' AND length(text) > 1000").orderBy("doc_id").first().text
    odd = langid.predict(table(spark, [(1, None), (2, ""), (3, "123 ..."), (4, plain), (4, plain)]), model).collect()
    assert [r.lang_pred for r in odd] == ["und", "und", "und", "en", "en"]
    assert langid.fit(docs.limit(0)) == {} and langid.predict(table(spark, [(1, "abc")]), {}).first().lang_pred == "und"


def test_language_query_against_brute_force(spark, sf_dir):
    """Every whole text compressed anew with each language's dictionary, block by block."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = langid.fit(held.where("NOT held_out"))
    got = {r.doc_id: r for r in queries.op1_compression_langid(spark, sf_dir).collect()}
    for d in docs.collect():
        raw = (d.text or "").encode()
        flat = b" ".join(re.sub(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]", b" ", raw.lower() if raw.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)).split())
        sizes = {}
        for lang, words_ in model.items():
            coder = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(words_, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(flat[i : i + langid.BLOCK_BYTES])) for i in range(0, len(flat), langid.BLOCK_BYTES))
        ranked = sorted((n, lang) for lang, n in sizes.items())
        known = any(c.isalpha() for c in d.text or "")
        want = (ranked[0][1], (ranked[1][0] - ranked[0][0]) / max(ranked[1][0], 1)) if known else ("und", 0.0)
        assert got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == (want[0], pytest.approx(want[1])), d.doc_id


def test_language_of_texts_that_begin_alike(spark):
    header = "COPYRIGHT NOTICE " * 40
    words_of = {lang: [f"{lang}{random.Random(f'{lang}{i}').randrange(10**9)}" for i in range(60)] for lang in ("aa", "bb", "cc")}
    rows = [(k * 100 + i, header + " ".join(random.Random(k * 100 + i).choices(words, k=120)), lang, "s") for k, (lang, words) in enumerate(words_of.items()) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash"))
    told = langid.predict(docs, langid.fit(docs), keep=("lang",)).toPandas()
    assert (told.lang == told.lang_pred).mean() > 0.95
    small = langid.fit(docs, sample_chars=30)
    assert set(small) == {"aa", "bb", "cc"} and all(len(v) <= 400 * 31 for v in small.values())


def test_warc_round_trip(spark, sf_dir, duck):
    same_rows(queries.op2_arc_to_warc(spark, sf_dir).toPandas(), duck.execute(queries.ORACLE["op2_arc_to_warc"]).df())
    long = "line\r\n\r\n" * 40
    pages = spark.createDataFrame([(1, None, None), (2, "http://a b/ü", "x"), (3, "u", long), (4, "u", long), (5, "u", "x"), (6, "u", "é\r\n\r\n\r\n")], "page_id long, url string, html string")
    got = {r.key: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive(warc.to_arc(pages)).collect()}
    assert got == {1: ("response", None, 0), 2: ("response", None, 1), 3: ("response", None, 320), 4: ("revisit", 3, 320), 5: ("response", None, 1), 6: ("response", None, 8)}
    assert warc.to_arc(pages.limit(0)).count() == 0


V1 = b"""filedesc://IA-001.arc 0.0.0.0 19960923142103 text/plain 76
1 0 AlexaInternet
URL IP-address Archive-date Content-type Archive-length

http://www.dryswamp.edu:80/index.html 127.10.100.2 19961104142103 text/html 146
HTTP/1.0 200 Document follows
Date: Mon, 04 Nov 1996 14:21:06 GMT
Server: NCSA/1.4.1
content-TYPE: text/html

<HTML>
Hello World!!!
\n\n\n\n\n
http://www.dryswamp.edu:80/some file.html 127.10.100.2 19961104 text/html 9
no header
dns:archive.org 1.2.3.4 199611041421 text/dns 12
archive.org.http://cut.example/ 1.2.3.4 19961104142103 text/plain 500
only this"""
V2 = b"""filedesc://IA-2.arc 0.0.0.0 20000101000000 text/plain 200 - - 0 IA-2.arc 122
2 0 Crawl
URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length


http://a.example/ 1.1.1.1 20000102030405 text/html 200 abc - 122 IA-2.arc 42
HTTP/1.1 200 OK\r
X-Record-Key: 77\r
\r
\r\n\r\nbod

garbage that no header declares
http://b.example/ 1.1.1.1 20000102030405 text/html 200 abc - 122 IA-2.arc 44
HTTP/1.1 200 OK\r
x-record-key: \r
\r
<html></html>"""


def fixed(raw):
    """The lengths of the first two records set right, whatever their texts."""
    lines = raw.split(b"\n")
    heads = [i for i, x in enumerate(lines) if re.search(rb" \d+$", x) and re.match(rb"\w+:", x)]
    for i, j in zip(heads[:2], heads[1:3]):
        lines[i] = lines[i].rsplit(b" ", 1)[0] + b" " + str(len(b"\n".join(lines[i + 1 : j]))).encode()
    return b"\n".join(lines)


def test_genuine_arc_files():
    got = [(f["url"], f["archive-date"], len(block), cut) for f, block, _, cut in warc.arc_records(fixed(V1))]
    assert [g[0].split(":")[0] for g in got] == ["filedesc", "http", "http", "dns", "http"]
    assert got[2][:3] == ("http://www.dryswamp.edu:80/some file.html", "19961104", 9) and got[3][2] == 12 and got[4][2:] == (9, True)
    assert [warc.timestamp(g[1]) for g in got[1:4]] == ["1996-11-04T14:21:03Z", "1996-11-04T00:00:00Z", "1996-11-04T14:21:00Z"]
    rows = [dict(zip(warc.CONVERTED.names, warc._converted("n", *r), strict=True)) for r in warc.arc_records(fixed(V1))]
    assert [r["kind"] for r in rows] == ["warcinfo", "response", "resource", "resource", "resource"]
    assert rows[1]["payload"].startswith(b"<HTML>") and rows[1]["head"].endswith(b"\n\n") and rows[3]["content_type"] == "text/dns"
    assert len({r["record_id"] for r in rows}) == 5 and len({r["key"] for r in rows[1:]}) == 4
    second = [warc._converted("n", *r) for r in warc.arc_records(fixed(V2))]
    assert [(r[0], r[7][:3]) for r in second[1:]] == [(77, b"\r\n\r"), (None, b"<ht")]
    whole, parts = gzip.compress(fixed(V1)), b"".join(gzip.compress(x) for x in (fixed(V1)[:300], fixed(V1)[300:]))
    for raw in (whole, parts):
        assert [r[1] for r in warc.arc_records(raw)] == [r[1] for r in warc.arc_records(fixed(V1))]
    assert len(list(warc.arc_records(whole[:-60]))) >= 1 and list(warc.arc_records(b"")) == list(warc.arc_records(b"no arc\n\n")) == []


def test_arc_files_to_warc(spark, tmp_path):
    (tmp_path / "a.arc").write_bytes(fixed(V1))
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(fixed(V2)))
    (tmp_path / "c.arc").write_bytes(b"")
    got = {r.uri: r for r in warc.archive(warc.read_arc(spark, str(tmp_path))).collect()}
    assert len(got) == 6 and got["http://a.example/"].key == 77 and got["http://b.example/"].key is None
    assert got["http://cut.example/"].truncated and got["http://cut.example/"].payload_bytes == 9 and got["dns:archive.org"].record_type == "resource"


def test_revisits_say_what_they_refer_to(spark):
    pages = spark.createDataFrame([(None, "u", "x" * 200), (2, "http://second", "x" * 200), (1, "http://first", "x" * 200), (None, "u", None)], "page_id long, url string, html string")
    rows = warc.archive(warc.to_arc(pages.withColumn("key", F.lit("clash")).withColumn("first", F.lit(1)))).collect()
    first = next(r for r in rows if r.key == 1)
    assert sorted((r.key or 0, r.record_type, r.refers_to) for r in rows) == [(0, "response", None), (0, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert next(r for r in rows if r.key == 2).refers_to_id == first.record_id


def test_arc_versions():
    for version in (1, 2):
        raw = warc.arc_head(version, "n.arc", "20200101000000") + warc.arc_record(version, "http://a b", "19990102030405", b"body\n\nx", 9, "n.arc")
        _, (fields, block, _, cut), *rest = warc.arc_records(raw)
        assert (fields["url"], fields["archive-date"], block, cut, rest) == ("http://a b", "19990102030405", b"body\n\nx", False, [])


def test_top_k(spark, sf_dir, duck):
    same_rows(queries.op4_bit_sliced_topk(spark, sf_dir).toPandas(), duck.execute(queries.ORACLE["op4_bit_sliced_topk"]).df())
    v = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [-1.0, 1.0]), (7, [1.0, None])]
    got = bitslices.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 0), (2, 2, 0)]


def test_top_k_of_odd_vectors(spark):
    v = [(0, [2.0**40, 1.0]), (1, [2.0**40, -3.0]), (2, [-(2.0**52), 5.0]), (3, [1e300, 0.0]), (4, [2.0**30, 7.0]), (5, [0.5, 0.25]), (5, [0.25, 0.5]), (5, [0.25, 0.5]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, x, "clash") for i, x in v], "vec_id long, embedding array<double>, which string")
    got = bitslices.top_k(frame, F.col("vec_id") % 5 == 0, k=3).collect()
    whole = [(i, [int(np.floor(1024 * y)) for y in x]) for i, x in v if i not in (3, None)]
    want = []
    for q, a in {(i, tuple(x)) for i, x in whole if i % 5 == 0}:
        scores = sorted(((sum(m * n for m, n in zip(a, b)), i) for i, b in whole if i != q), key=lambda s: (-s[0], s[1]))[:3]
        want += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, s))) for n, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert bitslices.top_k(frame.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_bit_arithmetic():
    r = np.random.default_rng(3)
    v, q = r.integers(-700, 700, (130, 9)), r.integers(-700, 700, 9)
    total = bitslices.add_up(q, bitslices.slices(v, 11), 28)
    assert (bitslices.values_at(total, np.arange(130)) == v @ q).all()
    assert all(sum(s << p for p, s in bitslices.naf(x)) == x for x in range(-300, 300))


def even(got, n, slack=0.08):
    """Whether the shards are all there, near equal in bytes, and their slots gapless."""
    by = got.groupby("shard")
    size = by["size"].sum()
    assert sorted(size.index) == list(range(n)) and (size - size.mean()).abs().max() <= slack * size.mean() + got["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in by)


@pytest.mark.parametrize("local_rows", [20, 1 << 14])
def test_shards_of_the_documents(spark, sf_dir, monkeypatch, local_rows):
    monkeypatch.setattr(shards, "LOCAL_ROWS", local_rows)
    got = queries.op5_kd_tree_shards(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").text
    even(got, 40)
    assert sorted(got.doc_id) == sorted(docs.index) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    raw = got.doc_id.map(docs).fillna("").map(str.encode)
    assert (got["size"] == raw.map(len) + 16).all() and (got.text_crc32 == raw.map(zlib.crc32)).all()
    same_rows(got, queries.op5_kd_tree_shards(spark, sf_dir).toPandas())


@pytest.mark.parametrize("local_rows", [50, 1 << 14])
def test_shards(spark, monkeypatch, local_rows):
    monkeypatch.setattr(shards, "LOCAL_ROWS", local_rows)
    many = table(spark, [(i, "same text") for i in range(900)] + [(None, None), (None, "")])
    even(shards.kd_shards(many, 8).toPandas(), 8)
    one = table(spark, [(1, "same id")] * 700 + [(None, "no id")] * 300).withColumn("tie", F.lit(1)).withColumn("node", F.lit(2))
    even(shards.kd_shards(one, 7).toPandas(), 7)
    groups = table(spark, [(i, f"text {i % 300} " * 20) for i in range(900)])
    got = shards.kd_shards(groups, 4).toPandas()
    even(got, 4)
    assert (got.groupby("group").shard.nunique() == 1).all()
    assert shards.kd_shards(table(spark, []), 4).count() == 0
    assert shards.kd_shards(table(spark, [(1, "a")]), 1).first().shard == 0
    assert shards.kd_shards(table(spark, [(i, "abc") for i in range(40)]), target_bytes=190).agg(F.count_distinct("shard")).first()[0] == 4


def test_many_shards(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.hash("id"), F.lit(50))).alias("text"))
    got = shards.kd_shards(rows, 5_000).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()
    assert len(got) == 5_000 and got.s.max() < 4 * got.s.mean()


def test_licenses(spark):
    texts = [(1, "Some text.\nReleased under the MIT License."), (2, "mit-license MIT LICENSE"), (3, None), (4, ""), (5, "redistribution and use in source and binary forms with or without modification are permitted provided that following conditions met"), (6, "the mit of license"), (7, "x " * 500 + "apache license " + "y " * 500)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(table(spark, texts)).collect()}
    assert got == {1: (7, 1, 5, 5, "mit", "mit"), 2: (4, 2, 0, 2, "mit", "mit"), 3: (0, 0, None, None, "", ""), 4: (0, 0, None, None, "", ""), 5: (19, 0, None, None, "", "bsd"), 6: (4, 0, None, None, "", ""), 7: (1002, 1, 500, 500, "apache", "apache")}
    assert licenses.scan(table(spark, [])).count() == 0


def test_wrapped_licenses(spark):
    bsd = "# Redistribution and use in source and binary forms, with or\n# without modification, are permitted provided\n# that the following conditions are met"
    texts = [(i, "\n".join([*["filler line"] * i, bsd, *["more words"] * 40])) for i in range(40)]
    texts += [(40, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"), (41, "Redistribution and use in source\n" + "far words " * 60 + "\nwith or without modification, are permitted provided that the following conditions")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(table(spark, texts)).collect()}
    assert got == dict.fromkeys(range(40), ("bsd", 1.0)) | {40: ("mit", 1.0), 41: ("", 0.0)}
    long = prose(60, 90, 10**6)
    assert licenses.scan(table(spark, [(1, prose(61, 50) + " " + long)]), templates=(("long", long, ""),)).first().labels == "long"


def test_license_labels(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    mit = licenses.TEMPLATES[1][1]
    texts = [(1, gpl), (2, "It was released under the old license of the town."), (3, "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60))), (4, "This library is licensed under the GNU Lesser General Public License"), (5, "Licensed under the\n * Apache License, Version 2.0\n"), (6, "Die Apache lizenz")]
    got = {r.doc_id: (r.base_labels, r.labels) for r in licenses.scan(table(spark, texts)).collect()}
    assert got == {1: ("gpl", "gpl"), 2: ("", ""), 3: ("", "mit"), 4: ("gpl", "gpl,lgpl"), 5: ("apache", "apache"), 6: ("", "")}
    assert "lgpl" in got[4][1]


def in_order(a, b):
    """The most words of both in the same order."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_license_join_tells_all_pairs_and_order_decides(spark):
    """The join has every block that holds 0.8 of a template's words, in whatever order; a bag of five words is no notice."""
    texts = [(1, "The old MIT students released the license under pressure"), (2, "Software released under the MIT license"), (3, "under license the released mit"), (4, None)]
    texts += [(10 + i, prose(70 + i, 60) + " " + t) for i, (_, t, _) in enumerate(licenses.TEMPLATES)]
    rows = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    assert [rows[i].labels for i in (1, 2, 3, 4)] == ["", "mit", "", ""] and rows[1].score == 0.0
    for i, t in texts:
        own = re.findall(rb"[a-z0-9]+", (t or "").lower().encode())
        want = []
        for k, (_, notice, _) in enumerate(licenses.TEMPLATES):
            words = re.findall(rb"[a-z0-9]+", notice.lower().encode())
            size = 1 << (len(words) - 1).bit_length()
            for at in range(0, max(1, len(own) - size), size):
                share = len(set(words) & set(own[at : at + 2 * size])) / len(set(words))
                want += [(k, at, share)] if share >= 0.8 - 1e-9 else []
        assert sorted((m.template, m.block, m.share) for m in rows[i].matches) == sorted(want)
    assert rows[1].matches and rows[3].matches
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in rows[10 + i].labels.split(",")


def licenses_brute(text):
    """Labels, base columns and score, block by block and template by template."""
    own = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    base, starts, hits = set(), [], {}
    for phrase, label in licenses.PHRASES:
        p = phrase.encode().split()
        found = [i for i in range(len(own)) if own[i : i + len(p)] == p]
        starts += found
        base |= {label} if found else set()
    for i, (_, t, must) in enumerate(licenses.TEMPLATES):
        words = re.findall(rb"[a-z0-9]+", t.lower().encode())
        size = 1 << (len(words) - 1).bit_length()
        for at in range(0, max(1, len(own) - size), size):
            block = set(own[at : at + 2 * size])
            share = len(set(words) & block) / len(set(words))
            if share >= 0.8 - 1e-9 and set(must.encode().split()) <= block and (len(words) > licenses.SHORT or in_order(words, own[at : at + 2 * size]) >= 0.8 * len(set(words)) - 1e-9):
                hits[i] = max(share, hits.get(i, 0))
    labels = base | {licenses.TEMPLATES[i][0] for i in hits}
    return len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else max(hits.values(), default=0.0)


def test_license_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_license_scan(spark, sf_dir).collect()}
    want = {r.doc_id: licenses_brute(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert got == want and any("," not in v[5] and v[5] for v in want.values()) and not any("lgpl" in v[5] for v in want.values())


def test_prefix_filter_loses_no_match():
    r, vocabulary = random.Random(5), [w for _, t, _ in licenses.TEMPLATES for w in licenses.tokens(t.encode())]
    index = licenses.Index(licenses.TEMPLATES, {w: r.randrange(9) for w in vocabulary}, 0.8)
    for _ in range(2000):
        own = r.choice(index.sets)
        block = frozenset(w for w in own if r.random() < 0.85) | frozenset(r.choices(vocabulary, k=r.randrange(4)))
        want = {i: len(s & block) / len(s) for i, s in enumerate(index.sets) if len(s & block) >= index.need[i]}
        possible = set().union(*index.possible(block).values()) if want else set()
        assert set(want) <= possible
        assert index.match(block) == want


def test_mix(spark, sf_dir):
    got = queries.op10_multinomial_mix(spark, sf_dir).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    again = queries.op10_multinomial_mix(spark, sf_dir).toPandas()
    same_rows(got, again)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = mixing.Mix(docs.repartition(7), 1.5, (5.0, 2.0, 1.0)).taken().select(*got.columns).toPandas()
    same_rows(got, other)
    small = mixing.pieces(mixing.place(docs).withColumn("ix", F.lit(0)), 9, 32).groupBy("block").agg(F.sum("words").alias("n")).orderBy(F.desc("block")).toPandas()
    assert (small.n[1:] == 32).all() and len(small) == small.block[0] + 1 and 0 < small.n[0] <= 32
    assert mixing.Mix(table(spark, []), 1.5, (5.0, 2.0, 1.0)).taken().count() == 0
    odd = spark.createDataFrame([(1, "a b", None), (2, None, "x"), (None, "c d e", "y")], "doc_id long, text string, source string")
    rows = {r.doc_id: (r.size, r.source_size) for r in mixing.Mix(odd, 1.5, (5.0, 2.0, 1.0)).taken().collect()}
    assert rows == {1: (2, 2), 2: (0, 0), None: (3, 3)}


def mix_brute(docs, share=1.5, weights=(5, 2, 1), block=32, n_shards=64, seed=7):
    """The mix drawn word by word: what it takes of each document."""
    by = {}
    for d in docs:
        by.setdefault(d["source"], []).append(d)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(d["size"] for d in by[s]) for s in names]
    goals = mixing.targets(sizes, [float(weights[i % 3]) for i in range(len(names))], share * sum(sizes))
    n_blocks = [-(-s // block) for s in sizes]
    slots = [round(t * b / s) if s else 0 for t, b, s in zip(goals, n_blocks, sizes)]
    assert list(mixing.draw(slots, n_shards, seed).sum(0)) == slots
    taken = {d["rid"]: 0 for d in docs}
    buckets = max(1, len(docs) // mixing.BUCKET_ROWS)
    for ix, s in enumerate(names):
        words = [d["rid"] for d in sorted(by[s], key=lambda d: (d["h"] % buckets, d["h"])) for _ in range(d["size"])]
        for k in range(slots[ix]):
            key = np.array([(k // n_blocks[ix]) * len(names) + ix], np.uint64) + (np.uint64(seed) << np.uint64(40))
            at = int(mixing.permute(np.array([k % n_blocks[ix]]), np.array([n_blocks[ix]]), key)[0])
            for rid in words[at * block : (at + 1) * block]:
                taken[rid] += 1
    return taken, dict(zip(names, goals)), dict(zip(names, sizes))


def test_mix_query_against_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 30)
    monkeypatch.setattr(mixing, "SUMS", 2)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("h"), F.col("doc_id").alias("rid"), "text").collect()]
    for r in rows:
        r["size"] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    taken, goals, sizes = mix_brute(rows)
    got = queries.op10_multinomial_mix(spark, sf_dir).toPandas()
    assert {r.doc_id: r.taken for r in got.itertuples()} == taken
    of = docs.select("doc_id", "source").toPandas().set_index("doc_id").source
    for r in got.itertuples():
        assert (r.size, r.source_size, r.target) == (next(x["size"] for x in rows if x["doc_id"] == r.doc_id), sizes[of[r.doc_id]], pytest.approx(goals[of[r.doc_id]]))
    sums = got.assign(s=got.doc_id.map(of)).groupby("s").taken.sum()
    assert all(abs(sums[s] - goals[s]) <= 64 + 0.01 * goals[s] for s in sums.index)


def test_targets_and_permutation():
    t = mixing.targets([10, 100, 0, 50], [5, 2, 1, 5], 240)
    assert t[0] == 20 and t[2] == 0 and sum(t) == pytest.approx(240) and t[3] == 100
    for n in (1, 2, 5, 97, 1000):
        k = np.arange(n)
        assert sorted(mixing.permute(k, np.full(n, n), np.full(n, 9, np.uint64))) == list(range(n))
    assert (mixing.draw([5, 0, 1000], 8).sum(0) == [5, 0, 1000]).all()


def test_words_of_texts():
    raw = np.frombuffer("ab céd\x0be".encode(), np.uint8)
    _, starts, before = words(raw, np.array([0, 2, len(raw)]))
    assert list(starts) == [0, 3, 8] and list(before) == [0, 1, 3]
