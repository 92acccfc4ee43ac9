"""Legacy archives: ARC files to WARC, and WARC files written and read back through Spark alone.

An ARC file begins with a version block; its header line ``filedesc://... version ...`` and the line of
field names that follows tell how the header lines of all records read (version 1: five fields, version 2:
ten). Each record is its header line, as many bytes as its last field declares, and a newline. A record
becomes a WARC record: the identifier is a UUID of its URL, date and place, the 8- to 14-digit date becomes an
ISO timestamp, the type is ``response`` for an HTTP message (``revisit`` for a payload that an earlier key holds) and ``resource`` for
anything else, and SHA-256 digests of block and payload are added. The version block becomes a ``warcinfo`` record.

Files may be compressed, as a whole or record by record. Newlines between records may be missing or repeated. A record that the file's
end cuts short, or in which a gzip member is damaged, keeps the bytes that are there and is marked ``WARC-Truncated``; reading goes on with the next member. Lines that are no header line where one has to stand are skipped up to the next one.
Each record has a key: the number in its X-Record-Key header (null, if that is empty); a record without that header, or with one that holds no 64-bit number, gets one by its file, URL,
date and place. IP address, result code and checksum of the header line are carried along.

WARC files are written with Spark's text writer: a record and the four bytes that end it are a line and its
separator, so a written file is one gzip member holding a plain WARC file; it holds what one task converts. The reader takes the lines of a
file in order, puts the separators back and cuts records at their declared lengths; it holds one record at a
time. Neither opens a path in Python, so any store that Spark reaches will do, and a lost executor's
files are written again under Spark's commit protocol.

Nulls: a null payload is empty, a null URL becomes ``urn:weft:<key>``; a record with a null key is a response that no other refers to.
Payloads under MIN_REVISIT bytes are never revisits. Of equal keys with equal payloads every
record is a response. An empty table makes no record. Columns beside those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.base import bound_batches, materialize, shared_dir

MIN_REVISIT = 100
#: Repeated payloads whose list is broadcast; more are joined by shuffle.
MAX_BROADCAST = 200_000
#: Bytes of a synthesised ARC file, and records of a WARC file at most.
ARC_BYTES, WARC_RECORDS = 2 << 20, 20_000
END = b"\r\n\r\n"
KEY = "X-Record-Key"
#: The field names of both ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _bytes(x: pa.Scalar) -> bytes:
    return memoryview(x.as_buffer()).tobytes() if x.is_valid else b""


def arc_record(version: int, url: str, date: str, block: bytes, offset: int, name: str) -> bytes:
    fields = [url, "0.0.0.0", date, "text/html"]
    if version == 2:
        fields += ["200", "-", "-", str(offset), name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 weft\n{ARC_FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


def to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "20200101000000") -> DataFrame:
    """ARC files as rows (name, content), of both versions in turn: each record an HTTP response with the key as a header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            parts: list[bytes] = []
            size, version, name = 0, 1, ""
            for k, u, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                k = "" if k is None else k
                if not parts:
                    version, name, n = 1 + n % 2, f"weft-{k}.arc", n + 1
                    parts.append(arc_head(version, name, date))
                    size = len(parts[0])
                body = _bytes(x)
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{KEY}: {k}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                where = quote(u, safe="%:/?#[]@!$&'()*+,;=~") if u else f"urn:weft:{k}"
                parts.append(arc_record(version, where, date, head + body, size, name))
                size += len(parts[-1])
                if size >= ARC_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)])], ["name", "content"])
                    parts = []
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)])], ["name", "content"])

    return bound_batches(pages).select(F.col(key), F.col(url), F.col(payload).cast("binary")).mapInArrow(run, "name string, content binary")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """ARC files at a path, compressed or not, as rows (name, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


#: What a gzip member begins with.
MAGIC = b"\x1f\x8b\x08"


def _pieces(content: bytes, size: int = 1 << 16, step: int = 64) -> Iterator[bytes | None]:
    """The bytes of a file in pieces, decompressed if they are gzip members. A member that is damaged gives what can be read until there, then None for the gap, and reading goes on with the
    next place that looks like a member and can be read as one; a member that the file's end cuts short gives what is there, then None."""
    if content[:2] != MAGIC[:2]:
        yield content
        return
    view, start = memoryview(content), 0
    while start >= 0:
        member, at, failed = zlib.decompressobj(31), start, -1
        while at < len(view) and not member.eof:
            spare = member.copy()
            try:
                piece = member.decompress(view[at : at + size])
            except zlib.error:
                for at in range(at, at + size, step):  # again in small steps, for what comes before the damage
                    try:
                        piece = spare.decompress(view[at : at + step])
                    except zlib.error:
                        failed = at
                        break
                    if piece:
                        yield piece
                break
            if piece:
                yield piece
            at += size
        if member.eof:
            start = min(at, len(view)) - len(member.unused_data)
            if bytes(view[start : start + 2]) != MAGIC[:2]:
                start = content.find(MAGIC, start)
        else:
            yield None
            start = content.find(MAGIC, max(failed, start + 1)) if failed >= 0 else -1


class _Stream:
    """A file's bytes by line or by number. Neither goes over a gap; gap tells whether one has been met and not passed yet."""

    def __init__(self, content: bytes):
        self._from, self._held, self._at, self.place, self.gap, self._ended = _pieces(content), b"", 0, 0, False, False

    def _more(self) -> bool:
        if self.gap:
            return False
        try:
            piece = next(self._from)
        except StopIteration:
            self._ended = True
            return False
        if piece is None:
            self.gap = True
            return False
        self._held, self._at = self._held[self._at :] + piece if self._at < len(self._held) else piece, 0
        return True

    def at_end(self) -> bool:
        """Whether nothing is left; passes gaps."""
        while self._at >= len(self._held) and not self._ended:
            self.gap = False
            self._more()
        return self._at >= len(self._held)

    def _got(self, end: int) -> bytes:
        out = self._held[self._at : end]
        self._at += len(out)
        self.place += len(out)
        return out

    def line(self) -> bytes:
        """Up to the next newline, with it, or to the end or a gap."""
        seen = self._at
        while (end := self._held.find(b"\n", seen)) < 0:
            seen = len(self._held) - self._at
            if not self._more():
                return self._got(len(self._held))
        return self._got(end + 1)

    def take(self, n: int) -> bytes:
        """The next n bytes, or what is left until the end or a gap."""
        out = [self._got(self._at + n)]
        while (n := n - len(out[-1])) > 0 and self._more():
            out.append(self._got(self._at + n))
        return b"".join(out)


_NUMBER = re.compile("-?[0-9]{1,19}")
_HEADER = re.compile(r"(\S.*) (\S+) (\d{8,17}) (\S.*|) (\d+)$")


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int, bool]]:
    """The records of an ARC file, the version block first if it has one: header fields, block, place in the file, and whether it is cut short."""
    stream, names = _Stream(content), ARC_FIELDS[1].split()
    while not stream.at_end():
        place = stream.place
        line = stream.line().rstrip(b"\r\n").decode("utf-8", "replace")
        if not _HEADER.match(line):  # newlines between records, or bytes that no header declares
            continue
        fields = line.split(" ")
        length = int(fields[-1])
        block = stream.take(length)
        if line.startswith("filedesc://"):
            lines = block.decode("utf-8", "replace").split("\n")
            version = lines[0].split(" ")[0]
            given = lines[1].split() if len(lines) > 1 and lines[1].lower().startswith("url") else []
            names = given or ARC_FIELDS[int(version) if version in ("1", "2") else 1].split()
        if len(fields) < len(names):  # a record of the other version: the fields that both have
            fields = [*fields[:4], *["-"] * (len(names) - len(fields)), *fields[4:]]
        if len(fields) > len(names):  # a URL or type with spaces: the fields after it are counted from the end
            fields = [" ".join(fields[: len(fields) - len(names) + 1]), *fields[len(fields) - len(names) + 1 :]]
        yield dict(zip(map(str.lower, names), fields, strict=True)), block, place, len(block) < length


def _http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its blank line, payload, and headers (by lower-case name) of an HTTP message; all payload if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    ends = [(at, len(sep)) for sep in (END, b"\n\n") if (at := block.find(sep)) >= 0]
    at, width = min(ends, default=(len(block), 0))
    lines = (x.partition(":") for x in block[:at].decode("utf-8", "replace").splitlines()[1:])
    return block[: at + width], block[at + width :], {k.strip().lower(): v.strip() for k, _, v in lines}


def timestamp(date: str) -> str:
    """ISO form of the first 14 digits; the time is 0 where digits are missing."""
    d = (date + "000000")[:14] if len(date) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


CONVERTED = pa.schema([("key", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("timestamp", pa.string()), ("record_id", pa.string()), ("content_type", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("truncated", pa.bool_()), ("ip", pa.string()), ("result_code", pa.string()), ("checksum", pa.string())])
#: Values of ARC fields that tell nothing.
UNKNOWN = ("", "-", "0.0.0.0")


def _converted(name: str, fields: dict[str, str], block: bytes, place: int, cut: bool) -> tuple:
    url, date = fields.get("url", ""), fields.get("archive-date", "")
    head, payload, headers = _http(block)
    own = headers.get(KEY.lower())
    key = None
    if own:
        key = int(own) if _NUMBER.fullmatch(own) and -(1 << 63) <= int(own) < 1 << 63 else None
    if own and key is None:
        own = None  # no number that a key can be
    if own is None:
        key = xxhash.xxh64_intdigest(f"{name} {url} {date} {place}") >> 1
    if url.startswith("filedesc://"):
        kind, mime, key, head, payload = "warcinfo", "application/warc-fields", None, b"", b"software: weft\r\nformat: WARC File Format 1.1\r\ndescription: converted from " + url.encode() + b"\r\n"
    else:
        kind, mime = ("response", "application/http; msgtype=response") if head else ("resource", fields.get("content-type") or "application/octet-stream")
    record = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {name} {place}' if own is None else f'{url} {date} {own}')}>"
    return key, kind, url, timestamp(date), record, mime, head, payload, hashlib.sha256(payload).hexdigest(), len(payload), cut, *(None if (x := fields.get(n, "")) in UNKNOWN else x for n in ("ip-address", "result-code", "checksum"))


def convert(arcs: DataFrame) -> DataFrame:
    """Per ARC record: key, kind, uri, timestamp, record_id, content_type, head, payload, payload_digest, payload_bytes, truncated, and of the header ip, result_code and checksum
    (null where it has none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CONVERTED, strict=True)], schema=CONVERTED)

        for batch in batches:
            for name, x in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for record in arc_records(_bytes(x)):
                    rows.append(_converted(name, *record))
                    size += len(record[1])
                    if size >= ARC_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return arcs.mapInArrow(run, "key long, kind string, uri string, timestamp string, record_id string, content_type string, head binary, payload binary, payload_digest string, payload_bytes long, truncated boolean, ip string, result_code string, checksum string")


def with_roles(records: DataFrame) -> DataFrame:
    """Adds first: the key, record_id, uri and timestamp of the record with the smallest key that has the payload, where it isn't the record's own."""
    may = (F.col("kind") == "response") & (F.col("payload_bytes") >= MIN_REVISIT) & F.col("key").isNotNull()
    firsts = records.where(may).groupBy("payload_digest").agg(F.min(F.struct("key", "record_id", "uri", "timestamp")).alias("first"), F.max("key").alias("last")).where("first.key < last").drop("last")
    firsts = materialize(firsts, "firsts")
    if firsts.count() <= MAX_BROADCAST:
        firsts = F.broadcast(firsts)
    held = records.join(firsts, "payload_digest", "left")
    return held.withColumn("first", F.when(may & (F.col("first.key") < F.col("key")), F.col("first")))


#: Header fields of a WARC record that hold what an ARC header line tells besides.
CARRIED = {"WARC-IP-Address": "ip", "X-ARC-Result-Code": "result_code", "X-ARC-Checksum": "checksum"}


def render(records: DataFrame) -> DataFrame:
    """One WARC record for each row, without the four bytes that end it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n) if n in ("head", "payload") else batch.column(n).to_pylist() for n in batch.schema.names}
            out = []
            for i in range(batch.num_rows):
                first, head, payload = c["first"][i], _bytes(c["head"][i]), _bytes(c["payload"][i])
                block = head if first is not None else head + payload
                lines = ["WARC/1.1", f"WARC-Type: {c['kind'][i] if first is None else 'revisit'}", f"WARC-Record-ID: {c['record_id'][i]}", f"WARC-Date: {c['timestamp'][i]}"]
                if c["kind"][i] == "warcinfo":
                    lines.append(f"WARC-Filename: {c['uri'][i].removeprefix('filedesc://')}")
                else:
                    lines += [f"WARC-Target-URI: {c['uri'][i]}", f"WARC-Payload-Digest: sha256:{c['payload_digest'][i]}", f"{KEY}: {'' if c['key'][i] is None else c['key'][i]}"]
                if first is not None:
                    lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {first['record_id']}", f"WARC-Refers-To-Target-URI: {first['uri']}", f"WARC-Refers-To-Date: {first['timestamp']}", f"X-Refers-To-Key: {first['key']}", f"X-Payload-Length: {len(payload)}"]
                lines += [f"{name}: {c[x][i]}" for name, x in CARRIED.items() if c[x][i] is not None]
                if c["truncated"][i]:
                    lines.append("WARC-Truncated: unspecified")
                lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Type: {c['content_type'][i]}", f"Content-Length: {len(block)}"]
                out.append("\r\n".join(lines).encode() + END + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return records.select("key", "kind", "first", "head", "payload", "record_id", "timestamp", "uri", "content_type", "payload_digest", "truncated", *CARRIED.values()).mapInArrow(run, "record binary")


def write(rendered: DataFrame, path: str) -> None:
    """gzip-compressed WARC files at path."""
    text = rendered.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", WARC_RECORDS).option("zlib.compress.level", "BEST_SPEED").text(path)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """WARC records from the pieces between the separators: header fields (by lower-case name) and block. The separators are put back, so it doesn't
    matter where in a payload they were found; line ends between records are skipped. A file that ends within a record is an error, as
    what is read here was written and committed whole."""
    held = bytearray()

    def more() -> bool:
        if (piece := next(pieces, None)) is None:
            return False
        held.extend(piece)
        held.extend(END)
        return True

    while True:
        while held[:1] in (b"\r", b"\n"):
            del held[:1]
        if not held:
            if more():
                continue
            return
        while (end := held.find(END)) < 0:
            if not more():
                raise ValueError(f"no end of a WARC header in {len(held)} bytes")
        lines = (x.partition(":") for x in held[:end].decode("utf-8", "replace").split("\r\n")[1:])
        fields = {k.strip().lower(): v.strip() for k, _, v in lines}
        begin, length = end + len(END), int(fields["content-length"])
        while len(held) < begin + length:
            if not more():
                raise ValueError(f"{fields.get('warc-record-id')}: {length} bytes declared, {len(held) - begin} found")
        yield fields, bytes(held[begin : begin + length])
        del held[: begin + length]


#: What read() returns.
READ = pa.schema([("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("refers_to_id", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("truncated", pa.bool_()), ("ip", pa.string()), ("result_code", pa.string()), ("checksum", pa.string())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record: key, payload_bytes, payload_digest, record_type, refers_to (a key), uri, refers_to_id, record_id, date, truncated, ip, result_code, checksum.
    Block digests, and the payload digests of whole payloads, are verified."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for x in batch.column(0):
                yield _bytes(x)

    def number(x: str | None) -> int | None:
        return int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)
            rows.clear()
            return out

        for fields, block in parse(pieces(batches)):
            kind = fields["warc-type"]
            payload = _http(block)[1] if kind == "response" else block
            found = hashlib.sha256(payload).hexdigest()
            digest = fields.get("warc-payload-digest", f"sha256:{found}").removeprefix("sha256:")
            if fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or kind != "revisit" and found != digest:
                raise ValueError(f"{fields['warc-record-id']}: digest differs")
            size = int(fields["x-payload-length"]) if kind == "revisit" else len(payload)
            rows.append((number(fields.get(KEY.lower())), size, digest, kind, number(fields.get("x-refers-to-key")), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields["warc-record-id"], fields["warc-date"], "warc-truncated" in fields, *(fields.get(n.lower()) for n in CARRIED)))
            if len(rows) >= 5000:
                yield flush()
        if rows:
            yield flush()

    text = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary"))
    return text.mapInArrow(run, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, refers_to_id string, record_id string, date string, truncated boolean, ip string, result_code string, checksum string")


def archive(arcs: DataFrame) -> DataFrame:
    """Converts ARC files, writes the WARC files to the shared folder and reads them back, without the warcinfo records."""
    spark = arcs.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}/warc"
    write(render(with_roles(convert(arcs))), path)
    return read(spark, path).where("record_type <> 'warcinfo'")
