"""Damaged and odd ARC files."""

import gzip
import random

import pytest

from weft.llm import warc


def record(i, body=None, key=None, ip="1.2.3.4"):
    body = body or random.Random(i).randbytes(3000).hex().encode()
    head = f"HTTP/1.1 200 OK\r\n{warc.KEY}: {i if key is None else key}\r\n\r\n".encode()
    return f"http://x/{i} {ip} 20010203040506 text/html 404 c{i} - 0 f.arc {len(head + body)}\n".encode() + head + body + b"\n", body


def members(n=6):
    head = warc.arc_head(2, "f.arc", "20010203040506")
    made = [record(i) for i in range(n)]
    return [gzip.compress(head), *(gzip.compress(r) for r, _ in made)], [b for _, b in made]


def read(content):
    return {f["url"]: (warc._http(block)[1], cut) for f, block, _, cut in warc.arc_records(content) if not f["url"].startswith("filedesc")}


@pytest.mark.parametrize("bad", [1, 3, 6])
@pytest.mark.parametrize("where", [0.02, 0.5, 0.9])
def test_members_after_a_damaged_one_are_read(bad, where):
    parts, bodies = members()
    hurt = bytearray(parts[bad])
    at = 10 + int((len(hurt) - 30) * where)
    hurt[at : at + 12] = b"\xff" * 12
    got = read(b"".join([*parts[:bad], bytes(hurt), *parts[bad + 1 :]]))
    for i, body in enumerate(bodies):
        if i + 1 != bad:
            assert got[f"http://x/{i}"] == (body, False)
        elif f"http://x/{i}" in got:  # its header line could be read
            kept, cut = got[f"http://x/{i}"]
            assert cut and len(kept) < len(body)
    assert where < 0.5 or f"http://x/{bad - 1}" in got


def test_the_first_member_damaged_the_last_cut_and_bytes_between_members():
    parts, bodies = members()
    hurt = parts[0][:14] + b"\xff\xff\xff\xff" + parts[0][18:]
    got = read(b"".join([hurt, *parts[1:]]))
    assert len(got) == 6
    got = read(b"".join(parts)[:-900])
    assert got["http://x/5"][1] and bodies[5].startswith(got["http://x/5"][0]) and not got["http://x/4"][1]
    assert read(b"garbage\n".join(parts)) == read(b"".join(parts)) == {f"http://x/{i}": (b, False) for i, b in enumerate(bodies)}
    assert read(gzip.compress(b"".join(gzip.decompress(p) for p in parts))) == read(b"".join(parts))


@pytest.mark.parametrize("key", ["--5", "²", "9" * 20, "9223372036854775808", "5x", "1.0"])
def test_keys_that_are_no_number_get_a_derived_one(spark, key):
    content = warc.arc_head(2, "f.arc", "20010203040506") + record(1, b"body", key)[0] + record(2, b"body", "-7")[0] + record(3, b"body", "", ip="-")[0]
    df = spark.createDataFrame([("f.arc", content)], "name string, content binary")
    got = {r.uri: r for r in warc.archive(df).collect()}
    assert got["http://x/1"].key >= 0 and got["http://x/2"].key == -7 and got["http://x/3"].key is None
    one, three = got["http://x/1"], got["http://x/3"]
    assert (one.ip, one.result_code, one.checksum) == ("1.2.3.4", "404", "c1") and (three.ip, three.result_code, three.checksum) == (None, "404", "c3")
