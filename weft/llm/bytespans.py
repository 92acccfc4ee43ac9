"""Removal of byte strings that an earlier document holds.

Every byte covered by a min_bytes-byte string that also starts in a document with a smaller id is removed;
strings are judged on the input. The frame is that of weft.llm.spans: it brings the different regions that share an anchor together,
one copy of each, so copies are one string, and a string that is alone under its anchor needs no comparison. What the others have in common is found on their Burrows-Wheeler transform, by threshold-bounded interval expansion: the
intervals of the first few bytes, which the transform's sorting by machine words parts, are extended to the left breadth first, through the transform's LF mapping alone. An interval of l bytes that extends to one of l + 1
bytes whose right end is not yet known to be a boundary makes it one, with a common prefix of l bytes, and goes on; others end there.
So boundaries come by increasing value, each once, and the expansion stops at min_bytes: what no boundary parts by then is a class of equal strings, and
its least id is the one that keeps them.

Null texts are empty; matches never cross documents; within one document nothing is a repeat of itself; rows
that share an id (nulls included, which count as the largest id) don't repeat each other. Texts shorter than min_bytes stay whole.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.hashing import BYTES
from weft.llm.spans import ASK, MAX_WINDOWS, PIECES, REGIONS, Held, Method, Part, Pieces, Unit, answers, repeated, spread, told

MIN_BYTES = 50
#: Bytes that are transformed at once, unless the regions of one anchor have more.
TRANSFORM_BYTES = 1 << 17
#: Different regions of an anchor from which it is split.
HOT = 4096


class Bytes(Unit):
    sent, density = "u1", 1.0

    def __init__(self, n: int):
        self.n, self.k = n, max(1, n * 2 // 5, n - MAX_WINDOWS + 1)

    def of(self, raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return BYTES[raw], raw, breaks

    def hashes(self, sent: np.ndarray) -> np.ndarray:
        return BYTES[sent]


def transform(text: np.ndarray, starts: np.ndarray, n: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of strings that stand one after another, string i from starts[i] to starts[i + 1]: the order of all suffixes (places in the
    strings with an end mark after each), the transform and the first symbols. A symbol is a byte plus one; end marks are 0 and
    sort by their strings. And what the first sorting by numbers tells: whether a suffix shares less than h symbols with the one before it, and h, n at most."""
    lengths = np.diff(starts)
    ends = starts[1:] + np.arange(len(lengths))
    size = len(text) + len(lengths)
    symbols = np.zeros(size, np.int64)
    symbols[spread(starts[:-1] + np.arange(len(lengths)), lengths)] = text.astype(np.int64) + 1
    rest = np.repeat(ends, lengths + 1) - np.arange(size)  # symbols before the end mark
    used = np.unique(text)
    code = np.zeros(257, np.int64)
    code[used.astype(np.int64) + 1] = np.arange(1, len(used) + 1)
    bits = int(len(used)).bit_length()
    have = 62 // bits  # symbols that fit in a number
    padded, keys = np.concatenate([code[symbols], np.zeros(have, np.int64)]), np.zeros(size, np.int64)
    for i in range(have):
        keys = keys << bits | np.where(rest > i, padded[i : i + size], 0)
    h = min(have, n)
    begin = keys >> bits * (have - h)
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))  # a rank is the place of the first suffix that isn't told apart yet
    rank = np.empty(size, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, size)))
    width = np.diff(np.append(head, size))
    places = np.flatnonzero(np.repeat(width > 1, width))
    while len(places := places[rest[order[places]] >= have]):
        at = order[places]
        keys = rank[at] * (size + 1) + rank[at + have] + 1
        by = np.argsort(keys)
        at, keys = at[by], keys[by]
        order[places] = at
        new = np.append(True, keys[1:] != keys[:-1])
        head = np.flatnonzero(new)
        width = np.diff(np.append(head, len(at)))
        fresh = np.repeat(places[head], width)
        rank[at] = fresh
        places = places[np.repeat(width > 1, width)]
        have *= 2
    final = rank[order]
    same = np.append(False, final[1:] == final[:-1])
    tied = np.flatnonzero(same | np.append(same[1:], False))  # suffixes that end alike sort by their strings
    at = order[tied]
    order[tied] = at[np.lexsort((at, rank[at]))]
    before = order - 1
    begin, ends_early = begin[order], rest[order] < h  # end marks differ, so what ends before h symbols shares them with none
    parted = ends_early.copy()
    parted[0] = True
    parted[1:] |= (begin[1:] != begin[:-1]) | ends_early[:-1]
    return order, np.where(before >= 0, symbols[before], 0), symbols[order], parted, h


def boundaries(bwt: np.ndarray, first: np.ndarray, parted_by: np.ndarray, h: int, n: int) -> np.ndarray:
    """Whether a suffix shares less than n symbols with the one before it in the order, from the transform. The expansion begins with the intervals of h symbols, which parted_by tells."""
    size = len(bwt)
    kind = np.int32 if size < 1 << 31 else np.int64
    lf = np.empty(size, kind)
    lf[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(size, dtype=kind)
    differs = np.ones(size + 1, bool)  # from the first symbol before
    differs[1:size] = first[1:] != first[:-1]
    parted = np.append(parted_by, True)
    left = np.flatnonzero(parted[:-1]).astype(kind)
    right = np.append(left[1:], size).astype(kind)
    holder = np.full(size + 1, -1, kind)
    for _ in range(h, n):
        if not len(left):
            break
        width = right - left
        of = np.repeat(np.arange(len(left), dtype=kind), width)
        place = np.arange(len(of), dtype=kind) + (left - np.cumsum(width, dtype=kind) + width)[of]
        goes = np.flatnonzero(bwt[place] > 0)
        of, to = of[goes], lf[place[goes]]
        holder[to] = of
        begins = differs[to] | (holder[to - 1] != of)  # end marks come first, so no place is 0
        last = differs[to + 1] | (holder[to + 1] != of)
        holder[to] = -1
        left, right = np.sort(to[begins]), np.sort(to[last]) + kind(1)
        fresh = ~parted[right]
        parted[right] = True
        left, right = left[fresh], right[fresh]
    return parted[:size]


def least_ids(n: int, windows: np.ndarray, starts: np.ndarray, units: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For all windows of the strings, one string after another, the least id of a string that holds it."""
    order, bwt, first, parted, h = transform(units, starts, n)
    head = np.flatnonzero(boundaries(bwt, first, parted, h, n))
    string = np.repeat(np.arange(len(windows)), np.diff(starts) + 1)
    place = np.arange(len(order)) - (starts[:-1] + np.arange(len(windows)))[string]
    starts_window = place < windows[string]
    owner = np.where(starts_window, ids[string], np.iinfo(np.int64).max)[order]
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owner, head), np.diff(np.append(head, len(order))))
    return least[starts_window]


def _in_batches(n: int, key: np.ndarray, windows: np.ndarray, starts: np.ndarray, units: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """least_ids of strings in the order of their keys: equal windows have one key, so whole keys are transformed, a bounded number of bytes at a time."""
    out, i = [], 0
    while i < len(key):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + TRANSFORM_BYTES)) - 1)
        j = int(np.searchsorted(key, key[j - 1], "right"))
        out.append(least_ids(n, windows[i:j], starts[i : j + 1] - starts[i], units[starts[i] : starts[j]], ids[i:j]))
        i = j
    return np.concatenate(out)


def _masks(least: np.ndarray, begin: np.ndarray, windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each holder, whose windows' least ids stand from begin on, a bit for each window that a smaller id holds."""
    out = np.zeros(len(ids), np.uint64)
    for i in range(int(windows.max(initial=0))):
        some = np.flatnonzero(windows > i)
        out[some] |= (least[begin[some] + i] < ids[some]).astype(np.uint64) << np.uint64(i)
    return out


class Expansion(Method):
    def regions(self, unit: Unit, held: Held) -> pa.Table:
        least = _in_batches(unit.n, held.key, held.windows, held.starts, held.units, held.least)
        begin = np.cumsum(held.windows) - held.windows
        return answers(held.part, REGIONS, held.at.astype(np.uint32), _masks(least, begin[held.content], held.windows[held.content], held.id))

    def pieces(self, unit: Unit, key: np.ndarray, windows: np.ndarray, starts: np.ndarray, units: np.ndarray, ids: np.ndarray, part: np.ndarray, at: np.ndarray) -> pa.Table:
        least = _in_batches(unit.n, key, windows, starts, units, ids)
        return answers(part, PIECES, at, _masks(least, np.cumsum(windows) - windows, windows, ids))

    def starts(self, part: Part, table: pa.Table, split: Pieces | None) -> Iterator[np.ndarray]:
        mask, judged = np.zeros(len(part.key), np.uint64), np.zeros(len(part.key), bool)
        every = lambda windows: (~np.uint64(0)) >> (np.uint64(64) - windows.astype(np.uint64))
        at, found = told(table, REGIONS, "<u4", "<u8")
        mask[at], judged[at] = found, True
        if split is not None:
            at, found = told(table, PIECES, "<u4", "<u8")
            of_run = np.zeros(len(split.head), np.uint64)
            of_run[at] = found
            own = np.where(split.id > split.id[split.head][split.run], every(split.windows), of_run[split.run])
            np.bitwise_or.at(mask, split.region, own << split.offset.astype(np.uint64))
            judged[split.region] = True
        at, _, least = told(table, ASK, "<u4", "u1", "<i8")
        alone = at[~judged[at] & (least < part.id[at])]  # all that stands under their anchors are copies, one of a smaller id
        mask[alone] = every(part.windows[part.holder[alone]])
        offset = 0
        for _, _, _, r, _ in part.blocks:
            which = part.which[offset : offset + len(r.first)]
            offset += len(r.first)
            copy = r.id > part.id[which]
            window = spread(np.zeros(len(r.first), np.int64), r.windows)
            bits = (np.repeat(mask[which], r.windows) >> window.astype(np.uint64)) & np.uint64(1)
            yield r.valid[np.repeat(copy, r.windows) | bits.astype(bool)]


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total units lie in a window of n units that starts at one of starts."""
    steps = np.zeros(total + 1, np.int32)
    steps[starts] += 1
    np.subtract.at(steps, starts + n, 1)
    return np.cumsum(steps[:-1]) > 0


def spans(removed: np.ndarray, before: np.ndarray) -> pa.Array:
    """The maximal removed runs of each text, as places within it."""
    inside = np.zeros(len(removed) + 1, bool)
    inside[:-1] = removed
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = before[(before > 0) & (before < len(removed))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(before, begin, "right") - 1
    offsets = np.searchsorted(row, np.arange(len(before)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - before[row]), pa.array(end - before[row])], ["start", "end"]))


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, **columns) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (the removed runs) and kept (the bytes that stay)."""

    def finish(raw: np.ndarray, breaks: np.ndarray, before: np.ndarray, sent: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
        removed = covered(starts, min_bytes, len(raw))
        kept = ~removed
        offsets = np.concatenate([[0], np.cumsum(kept)])[breaks]
        return [pa.array(np.diff(breaks)), spans(removed, breaks), binary_array(raw[kept], offsets)]

    return repeated(docs, Bytes(min_bytes), Expansion(HOT, 4, True), finish, "n_bytes long, spans array<struct<start: long, end: long>>, kept binary", **columns)
