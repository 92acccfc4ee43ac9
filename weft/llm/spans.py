"""Repeated windows across documents: the distributed frame of both substring deduplications.

A window is n consecutive units (bytes or words) of one document. A window is a repeat when the same units also
start in a document with a smaller id. The frame brings together what may be equal; a Method decides what is:

1. tell. Of the k-grams in a window the one with the smallest hash is the window's anchor (the leftmost at a tie), so equal
   windows have equal anchors at equal places. The windows of a document that choose the same anchor are
   consecutive; their union is a region. Documents are dealt into parts of a few MB. Per part and different region, two
   hashes and the least id go to the bucket of the anchor; copies of a region are sent once.
2. resolve. Anchors that documents of different ids hold are shared. Where all regions of a shared anchor are equal (by a 64-bit hash of their content),
   there is nothing to find but the least id, and that is told. Of each different region of the others, one part is asked for the units.
3. send. The units go to the bucket of the anchor. An anchor with more than Method.hot different regions is split: its regions are cut into pieces of
   Method.per windows, and each piece goes by the hash of the units that its windows have in common, wherever they belong. Equal pieces of a
   part are sent once. So no bucket grows with the regions of one anchor.
4. compare. The method gets the units of the bucket's different regions, and which part holds each under which least id.
5. apply. What the method has found goes back to all parts that hold the region; there it says which windows of whole documents are repeats.

Rows that share an id (nulls included, which count as the largest id) don't repeat each other. The parts' texts
and the regions are shuffled once; Spark reuses these exchanges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.base import bound_batches, in_order, pack, power_of_two, runs, unpack
from weft.llm.hashing import mix, prefix, ranges

#: Bytes of text in a part, bytes of text read at once within it, and regions in a bucket, all on average.
PART_BYTES, BLOCK_BYTES, BUCKET_REGIONS = 4 << 20, 1 << 18, 1 << 17
#: Bytes of text from which parts and buckets grow with the square root of the corpus, so that the messages between them grow with the text and not with its square; up to this factor.
LARGE_BYTES, MOST_GROWTH = 1 << 30, 8
#: Stands for a null id: larger than any other.
NO_ID = np.iinfo(np.int64).max
#: Windows of a region at most: as many as a mask has bits.
MAX_WINDOWS = 64
_PLACE = 26


class Unit:
    """What a window is made of. of(raw, breaks): units of the texts that stand one after another in raw, as hashes and as they are
    sent, with the number of units before each text. density: units in a byte of text, about."""

    n: int
    k: int
    sent: str
    density: float

    def of(self, raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raise NotImplementedError

    def hashes(self, sent: np.ndarray) -> np.ndarray:
        """The hashes of units as they are sent."""
        raise NotImplementedError


def spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at first, one range after another."""
    return np.arange(int(lengths.sum())) + np.repeat(first - np.cumsum(lengths) + lengths, lengths)


def _murmur(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of long values, by which it deals rows out to partitions (Murmur3, 32 bits)."""
    turn = lambda v, n: (v << np.uint32(n)) | (v >> np.uint32(32 - n))
    h = np.full(len(x), seed, np.uint32)
    for half in (x & 0xFFFFFFFF, x >> 32):
        h ^= turn(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def even_names(n: int, partitions: int) -> np.ndarray:
    """Names for n parts or buckets that Spark's hash deals evenly to so many partitions; left to chance, the fullest partition gets several times its share."""
    share, names, found = -(-n // partitions), np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(found) < n:
        names = np.arange(len(names) * 2 or 4 * n + 64)
        at = _murmur(names).astype(np.int64) % partitions
        order = np.argsort(at, kind="stable")
        head, ends = runs(at[order])
        place = np.empty(len(names), np.int64)
        place[order] = spread(np.zeros(len(head), np.int64), ends - head)
        found = names[place < share]
    return found[np.argsort(place[found], kind="stable")][:n]


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, their breaks and the ids."""
    column = table.column("text").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ids = table.column("id").to_numpy()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), ids
    wide = column.cast(pa.large_binary())
    breaks = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None and wide.buffers()[2].size else np.zeros(0, np.uint8)
    return raw[breaks[0] : breaks[-1]], breaks - breaks[0], ids


class Regions:
    """The regions of some texts: anchor and content hashes, id, first window, number of windows; units as hashes and as sent."""

    def __init__(self, unit: Unit, raw: np.ndarray, breaks: np.ndarray, ids: np.ndarray):
        n, k = unit.n, unit.k
        w = n - k + 1
        values, self.sent, self.before = unit.of(raw, breaks)
        total = len(values)
        counts = np.diff(self.before)
        starts = np.zeros(total, bool)  # where a window starts
        if total >= n:
            sums = prefix(values)
            grams = mix(ranges(sums, slice(0, total - k + 1), slice(k, total + 1)))
            steps = np.zeros(total + 1, np.int8)
            long = counts >= n
            np.add.at(steps, self.before[:-1][long], 1)
            np.add.at(steps, self.before[1:][long] - n + 1, -1)
            starts = np.cumsum(steps[:-1]).astype(bool)
        self.valid = np.flatnonzero(starts)
        if not len(self.valid):
            self.first = self.windows = self.anchor = np.zeros(0, np.int64)
            self.key = self.content = np.zeros(0, np.uint64)
            self.id = np.zeros(0, np.int64)
            return
        place = np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << _PLACE) - 1)
        low = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | place
        width = 1
        while width < w:  # low[i] becomes the least of the w from i on
            step = min(width, w - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        at = self.valid
        # the anchor's distance from its window's start is below w, so the low bits of its place suffice
        anchor = at + ((low[at] - at.astype(np.uint64)) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        self.first, self.anchor = at[head], anchor[head]
        self.windows = np.diff(np.append(head, len(at)))
        self.key = mix(grams[self.anchor])  # the least hashes are small; as keys they have to spread evenly
        shape = ((self.anchor - self.first) * 4096 + self.windows).astype(np.uint64)
        self.content = mix(ranges(sums, self.first, self.first + self.windows + n - 1) ^ mix(shape))
        self.id = ids[np.searchsorted(self.before, self.first, "right") - 1]


def _blocks(unit: Unit, table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, Regions, np.ndarray]]:
    """Regions of a part, a bounded number of bytes at a time: rows [i, j), their bytes, Regions and ids."""
    raw, breaks, ids = _texts(table)
    i, rows = 0, len(ids)
    while i < rows:
        j = max(i + 1, int(np.searchsorted(breaks, breaks[i] + BLOCK_BYTES, "right")) - 1)
        yield i, j, raw[breaks[i] : breaks[j]], Regions(unit, raw[breaks[i] : breaks[j]], breaks[i : j + 1] - breaks[i], ids[i:j]), ids[i:j]
        i = j


class Part:
    """The different regions of a part in the order of (key, content), with the least id of each, and whether documents of further ids hold it."""

    def __init__(self, unit: Unit, table: pa.Table):
        self.unit, self.blocks = unit, list(_blocks(unit, table))
        regions = [b[3] for b in self.blocks]
        #: Units before each block.
        self.offset = np.cumsum([0, *(len(r.sent) for r in regions)])
        key, content, ids = (np.concatenate([getattr(r, a) for r in regions] or [np.zeros(0, t)]) for a, t in (("key", np.uint64), ("content", np.uint64), ("id", np.int64)))
        #: By region in reading order: the place of its first unit and of its anchor in the part, and its windows.
        self.first, self.anchor = (np.concatenate([getattr(r, a) + o for r, o in zip(regions, self.offset, strict=False)] or [np.zeros(0, np.int64)]) for a in ("first", "anchor"))
        self.windows = np.concatenate([r.windows for r in regions] or [np.zeros(0, np.int64)])
        order = in_order(key, content, ids)
        k, c = key[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        head, ends = runs(np.cumsum(new))
        self.key, self.content, self.id, self.holder = k[head], c[head], ids[order][head], order[head]
        self.several = ids[order][ends - 1] > self.id
        #: For each region in reading order, the number of its different one.
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1

    @cached_property
    def sent(self) -> np.ndarray:
        """The units of all blocks."""
        return np.concatenate([b[3].sent for b in self.blocks] or [np.zeros(0, self.unit.sent)])

    def units(self, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """The units of these windows, one range after another."""
        return self.sent[spread(first, windows + self.unit.n - 1)]


class Pieces:
    """The pieces of some different regions (at) of a part, `per` windows each. Windows whose anchor is at the distances i * per to (i + 1) * per - 1 are
    piece i of their region: they have n - per + 1 units in common, whose hash is the piece's key. Equal pieces are numbered alike, with the least id."""

    def __init__(self, part: Part, at: np.ndarray, per: int):
        unit, own = part.unit, part.holder[at]
        windows = part.windows[own]
        place = spread(np.zeros(len(at), np.int64), windows)
        region = np.repeat(np.arange(len(at)), windows)
        which = ((part.anchor - part.first)[own][region] - place) // per
        head, ends = runs(region * MAX_WINDOWS + which)
        self.region, self.offset, self.windows = at[region[head]], place[head], ends - head
        self.first = part.first[own][region[head]] + self.offset
        sums = prefix(unit.hashes(part.sent))
        latest = part.anchor[own][region[head]] - which[head] * per
        key = mix(ranges(sums, latest, latest - per + 1 + unit.n) + mix(which[head].astype(np.uint64) + np.uint64(1)))
        shape = (latest - self.first).astype(np.uint64) * np.uint64(4096) + self.windows.astype(np.uint64)
        content = mix(ranges(sums, self.first, self.first + self.windows + unit.n - 1) ^ mix(shape))
        self.id = part.id[self.region]
        order = in_order(key, content, self.id)
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        #: The first of each run of equal pieces, the run of each piece, and the key of each run.
        self.head = order[new]
        self.run = np.empty(len(order), np.int64)
        self.run[order] = np.cumsum(new) - 1
        self.key = key[self.head]


SENT = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("base", pa.int64()), ("data", pa.binary())])
ANSWER = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
#: Kinds of answers: what is asked of the part or told about its regions (least ids), and what the method says of regions and of pieces.
ASK, REGIONS, PIECES = 0, 1, 2
#: What is asked for: nothing, a region's units, or its pieces.
TOLD, UNITS, CUT = 0, 1, 2


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def answers(part: np.ndarray, kind: int, *arrays: np.ndarray) -> pa.Table:
    """A row for each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    head, ends = runs(part)
    data = [pack(*(a[order[i:j]] for a in arrays)) for i, j in zip(head, ends, strict=True)]
    return pa.table([pa.array(part[head], pa.int64()), pa.array([kind] * len(head), pa.int32()), pa.array(data, pa.binary())], schema=ANSWER)


def told(table: pa.Table, kind: int, *kinds: str) -> list[np.ndarray]:
    """The arrays of all answers of a kind."""
    found = [unpack(data.as_py(), *kinds) for k, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True) if k == kind]
    return [np.concatenate([f[i] for f in found] or [np.zeros(0, t)]) for i, t in enumerate(kinds)]


@dataclass
class Held:
    """The different regions of a bucket's shared anchors, in the order of their anchors: key, windows, least id, and the units, region i's from starts[i] to
    starts[i + 1]. And who holds them: content (the region's number), part, at (its number there), id (the least there), several (whether further ids do)."""

    key: np.ndarray
    windows: np.ndarray
    starts: np.ndarray
    units: np.ndarray
    least: np.ndarray
    content: np.ndarray
    part: np.ndarray
    at: np.ndarray
    id: np.ndarray
    several: np.ndarray


class Method:
    """What decides which windows are repeats. hot: different regions of an anchor from which it is split, into pieces of `per` windows; piece_units: whether the pieces' units are wanted."""

    def __init__(self, hot: int, per: int, piece_units: bool):
        self.hot, self.per, self.piece_units = hot, per, piece_units

    def regions(self, unit: Unit, held: Held) -> pa.Table:
        """Answers of kind REGIONS."""
        raise NotImplementedError

    def pieces(self, unit: Unit, key: np.ndarray, windows: np.ndarray, starts: np.ndarray, units: np.ndarray, ids: np.ndarray, part: np.ndarray, at: np.ndarray) -> pa.Table:
        """Answers of kind PIECES, for pieces that come together by their keys."""
        raise NotImplementedError

    def starts(self, part: Part, table: pa.Table, split: Pieces | None) -> Iterator[np.ndarray]:
        """For each block of the part, the first units of the repeated windows."""
        raise NotImplementedError


def numbers(size: int, unit: Unit) -> tuple[int, int]:
    """Parts and buckets for so many bytes of text; each part sends a message to each bucket."""
    growth = min(MOST_GROWTH, max(1.0, (size / LARGE_BYTES) ** 0.5))
    return power_of_two(size / PART_BYTES / growth), power_of_two(size * unit.density * 2 / (unit.n - unit.k + 2) / BUCKET_REGIONS / growth)


def repeated(docs: DataFrame, unit: Unit, method: Method, finish: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]], out: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs the five steps. finish(raw, breaks, before, sent, starts): columns after doc_id for some texts; starts are the repeated windows' first units."""
    rows = bound_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_parts, n_buckets = numbers(size, unit)
    shift = np.uint64(64 - n_buckets.bit_length() + 1)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = even_names(2 * n_buckets, partitions)  # those of the buckets of regions, then those of pieces
    parts = rows.sparkSession.createDataFrame(list(enumerate(even_names(n_parts, partitions).tolist())), "dealt long, part long")  # a row for some MB of text
    rows = rows.withColumn("dealt", F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(n_parts))).join(F.broadcast(parts), "dealt").drop("dealt")
    bucket_of = lambda key: (key >> shift).astype(np.int64) if n_buckets > 1 else np.zeros(len(key), np.int64)
    told_kinds, sent_kinds = ("<u8", "<u8", "<i8", "u1"), ("<u4", "<u2", "<i8", "<u8", "<u8")
    low = np.uint64(12)

    def rows_of(number: int, bucket: np.ndarray, base: np.ndarray, data: list[bytes]) -> pa.Table:
        return pa.table([pa.array(bucket, pa.int64()), pa.array([number] * len(bucket), pa.int64()), pa.array(base, pa.int64()), pa.array(data, pa.binary())], schema=SENT)

    def tell(table: pa.Table) -> pa.Table:
        part = Part(unit, table)
        bucket = bucket_of(part.key)
        head, ends = runs(bucket)
        data = [pack(part.key[i:j] >> low, part.content[i:j], part.id[i:j], part.several[i:j].astype(np.uint8)) for i, j in zip(head, ends, strict=True)]
        return rows_of(table.column("part")[0].as_py(), names[bucket[head]], head, data)

    def regions_of(table: pa.Table) -> list[np.ndarray]:
        """key, content, ids, several, part and number of the regions told."""
        cols: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (*told_kinds, "<i8", "<i8")]
        for number, base, data in zip(table.column("part").to_numpy(), table.column("base").to_numpy(), table.column("data"), strict=True):
            found = unpack(data.as_py(), *told_kinds)
            n = len(found[0])
            for c, x in zip(cols, (*found, np.full(n, number), base + np.arange(n)), strict=True):
                c.append(x)
        return [np.concatenate(c) for c in cols]

    def resolve(table: pa.Table) -> pa.Table:
        key, content, ids, several, part, at = regions_of(table)
        order = in_order(key, content, ids, part)
        key, content, ids = key[order], content[order], ids[order]
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, content[1:] != content[:-1])
        group, heads = np.cumsum(new_key) - 1, np.flatnonzero(new_key)
        shared = (np.maximum.reduceat(ids, heads) > np.minimum.reduceat(ids, heads)) | np.logical_or.reduceat(several[order], heads)
        different = np.bincount(group, new)
        hot = (shared & (different > method.hot))[group]
        wanted = (shared & (different > 1))[group]
        code = np.where(hot, CUT, np.where(wanted & new, UNITS, TOLD)).astype(np.uint8)
        least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        some = (code > 0) | (least < ids)
        return answers(part[order][some], ASK, at[order][some].astype(np.uint32), code[some], least[some])

    def split_of(part: Part, table: pa.Table) -> tuple[np.ndarray, Pieces | None]:
        """The regions whose units are asked for, and the pieces of those that are split."""
        at, code, _ = told(table, ASK, "<u4", "u1", "<i8")
        hot = np.sort(at[code == CUT])
        return np.sort(at[code == UNITS]), Pieces(part, hot, method.per) if len(hot) else None

    def send(table: pa.Table, asking: pa.Table) -> pa.Table:
        if not table.num_rows or not asking.num_rows:
            return SENT.empty_table()
        part = Part(unit, table)
        asked, split = split_of(part, asking)
        number, out = table.column("part")[0].as_py(), []

        def put(cut: bool, bucket: np.ndarray, at: np.ndarray, first: np.ndarray, windows: np.ndarray, ids: np.ndarray, key: np.ndarray, content: np.ndarray, whole: bool) -> None:
            order = np.argsort(bucket, kind="stable")
            head, ends = runs(bucket[order])
            data = []
            for i, j in zip(head, ends, strict=True):
                o = order[i:j]
                about = pack(at[o].astype(np.uint32), windows[o].astype(np.uint16), ids[o], key[o], content[o])
                data.append(len(about).to_bytes(4, "little") + about + pack(part.units(first[o], windows[o]) if whole else np.zeros(0, unit.sent)))
            out.append(rows_of(number, names[n_buckets * cut + bucket[order][head]], np.full(len(head), cut, np.int64), data))

        own = part.holder[asked]
        put(False, bucket_of(part.key[asked]), asked, part.first[own], part.windows[own], np.zeros(len(asked), np.int64), part.key[asked] >> low, part.content[asked], True)  # the ids are told with the regions
        if split is not None:
            h = split.head
            put(True, bucket_of(split.key), np.arange(len(h)), split.first[h], split.windows[h], split.id[h], split.key, split.key, method.piece_units)
        return pa.concat_tables(out)

    def compare(table: pa.Table, sent: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return ANSWER.empty_table()
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        for number, data in zip(sent.column("part").to_numpy(), sent.column("data"), strict=True):
            blob = data.as_py()
            n = int.from_bytes(blob[:4], "little")
            at, windows, ids, key, content = unpack(blob[4 : 4 + n], *sent_kinds)
            for c, x in zip(cols, (at, windows.astype(np.int64), ids, key, content, np.full(len(at), number), unpack(blob[4 + n :], unit.sent)[0]), strict=True):
                c.append(x)
        at, windows, ids, key, content, part, units = map(np.concatenate, cols)
        lengths = windows + unit.n - 1
        order = in_order(key, content)
        if len(units):
            units = units[spread((np.cumsum(lengths) - lengths)[order], lengths[order])]
        at, windows, ids, key, content, part = (x[order] for x in (at, windows, ids, key, content, part))
        starts = np.concatenate([[0], np.cumsum(lengths[order])])
        if sent.column("base")[0].as_py():
            return method.pieces(unit, key, windows, starts, units, ids, part, at)
        both = lambda k, c: mix(k) ^ c
        known = both(key, content)
        by = np.argsort(known)
        of_key, of_content, of_id, several, of_part, of_at = regions_of(table)
        mine = both(of_key, of_content)
        where = np.minimum(np.searchsorted(known[by], mine), len(by) - 1)
        some = known[by][where] == mine
        holds = by[where[some]]
        least = np.full(len(known), NO_ID)
        np.minimum.at(least, holds, of_id[some])
        return method.regions(unit, Held(key, windows, starts, units, least, holds, of_part[some], of_at[some], of_id[some], several[some].astype(bool)))

    def apply(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        part = Part(unit, table)
        done = []
        for (i, j, raw, r, _), starts in zip(part.blocks, method.starts(part, found, split_of(part, found)[1]), strict=True):
            texts = table.column("text").slice(i, j - i)
            lengths = np.array([len(x.as_buffer()) for x in texts], np.int64)
            columns = finish(raw, np.concatenate([[0], np.cumsum(lengths)]), r.before, r.sent, starts)
            done.append(pa.table([table.column("doc_id").slice(i, j - i).combine_chunks(), *columns], names=schema.names))
        return pa.concat_tables(done).cast(schema)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {id_type}, {out}"
    schema = _arrow_schema(rows.sparkSession, ddl)
    regions = rows.groupBy("part").applyInArrow(tell, _ddl(SENT))
    asked = regions.groupBy("bucket").applyInArrow(resolve, _ddl(ANSWER))
    sent = rows.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(send, _ddl(SENT))
    found = regions.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(compare, _ddl(ANSWER))
    return rows.groupBy("part").cogroup(asked.unionByName(found).groupBy("part")).applyInArrow(apply, ddl)


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)
