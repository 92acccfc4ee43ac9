"""Removal of word sequences that an earlier document holds, by relative Lempel-Ziv parsing.

Every word covered by a window of min_words words that also starts in a document with a smaller id is
removed; windows are judged on the input. The frame is that of weft.llm.spans: to each part of the corpus it brings the reference blocks that its documents
may share something with. These are stretches of other parts' documents around a shared anchor, sent word by word (or named by their place in the
part where the part holds the same stretch itself), each with the least id that holds it; and the part's own documents. All blocks are
indexed by the hashes of their sequences of min_words words.

Each whole document is then factored greedily against all indexed blocks: if the sequence at the cursor stands in a block of a smaller id, the factor is the longest
common stretch of the two from there, of any length; else it is one word. Only cursors are looked up. Factors of min_words words or more
are duplicate spans. A window that begins in one factor and ends in another is in no factor; so the last min_words - 1 places
before the end of such a factor are looked up as well, and no window is missed.

Words are runs without ASCII whitespace, compared as they are by 64-bit hashes. Null texts have no words; windows never cross
documents; rows that share an id (nulls included, which count as the largest id) don't repeat each
other. Texts with fewer than min_words words stay whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.base import pack, runs, unpack
from weft.llm.bytespans import covered, spans
from weft.llm.hashing import mix, prefix, ranges, words
from weft.llm.spans import ANSWER, ASK, MAX_WINDOWS, PIECES, REGIONS, Held, Method, Part, Pieces, Unit, answers, repeated, spread, told

MIN_WORDS = 13
#: Places after a cursor that are looked up at once.
AHEAD = 32
#: Different regions of an anchor from which it is split, as each is sent to the parts that hold another.
HOT = 8
#: Bits of the sieve before the index.
SIEVE = 22


class Words(Unit):
    sent, density = "<u8", 1 / 5

    def __init__(self, n: int):
        self.n, self.k = n, max((n + 1) // 2, n - MAX_WINDOWS + 1)

    def of(self, raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, _, before = words(raw, breaks)
        return hashes, hashes, before

    def hashes(self, sent: np.ndarray) -> np.ndarray:
        return sent


class Index:
    """The reference blocks of a text of word hashes. Block i is the places from begin[i] to end[i], held by id owner[i]; a sequence of n words is known by
    its hash, with the least id of a block that holds it and where it stands there. Sequences that stand only once are left out."""

    def __init__(self, n: int, sums: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray):
        self.n, self.sums = n, sums
        windows = np.maximum(end - begin - n + 1, 0)
        place, block = spread(begin, windows), np.repeat(np.arange(len(begin)), windows)
        key = self.hashes(place)
        order = np.argsort(key)
        head, ends = runs(key[order])
        many = np.repeat(ends - head > 1, ends - head)
        order = order[many]
        place, block, key = place[order], block[order], key[order]
        order = np.lexsort((owner[block], key)) if len(key) else np.zeros(0, np.int64)
        head, _ = runs(key[order])
        at = order[head]
        self.key, self.least, self.place, self.end = key[at], owner[block[at]], place[at], end[block[at]]
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self.key >> np.uint64(64 - SIEVE)] = True

    def hashes(self, place: np.ndarray) -> np.ndarray:
        return mix(ranges(self.sums, place, place + self.n))

    def find(self, place: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For each place, the number of its sequence if a smaller id than owner holds it, else -1."""
        key = self.hashes(place)
        out = np.full(len(place), -1)
        some = np.flatnonzero(self.sieve[key >> np.uint64(64 - SIEVE)])
        if len(some) and len(self.key):
            at = np.minimum(np.searchsorted(self.key, key[some]), len(self.key) - 1)
            good = (self.key[at] == key[some]) & (self.least[at] < owner[some])
            out[some[good]] = at[good]
        return out

    def factor(self, place: np.ndarray, end: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The words that a text shares with a reference block: from place, up to end, and from where the sequence found stands in its block."""
        source = self.place[found]
        low, high = np.full(len(place), self.n), np.minimum(end - place, self.end[found] - source)
        while (open_ := low < high).any():  # the longest length with equal hashes
            middle = (low + high + 1) // 2
            same = ranges(self.sums, place, place + middle) == ranges(self.sums, source, source + middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def parse(self, begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Factors documents, the places from begin to end, all at once: places of repeated sequences, and the lengths of the factors found."""
        n, out, lengths = self.n, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        doc, cursor = np.arange(len(begin)), begin.copy()
        while True:
            on = cursor + n <= end[doc]
            doc, cursor = doc[on], cursor[on]
            if not len(doc):
                return np.concatenate(out), np.concatenate(lengths)
            ahead = np.minimum(AHEAD, end[doc] - n + 1 - cursor)
            row, place = np.repeat(np.arange(len(doc)), ahead), spread(cursor, ahead)
            found = self.find(place, owner[doc][row])
            hit = np.flatnonzero(found >= 0)
            hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])] if len(hit) else hit  # the first of each document
            cursor = cursor + ahead  # words that begin no factor
            if len(hit):
                of, at = row[hit], place[hit]
                length = self.factor(at, end[doc[of]], found[hit])
                out.append(spread(at, length - n + 1))
                lengths.append(length)
                cursor[of] = at + length
                cross = spread(at + length - n + 1, np.minimum(n - 1, end[doc[of]] - n - (at + length - n)))
                whose = np.repeat(owner[doc[of]], np.minimum(n - 1, end[doc[of]] - n - (at + length - n)))
                out.append(cross[self.find(cross, whose) >= 0])


class Factoring(Method):
    def regions(self, unit: Unit, held: Held) -> pa.Table:
        """The reference blocks that a part needs: of each anchor that it holds, the different regions of smaller ids."""
        head, ends = runs(held.key)
        anchor = np.repeat(np.arange(len(head)), ends - head)[held.content]
        count = (ends - head)[anchor]
        row, block = np.repeat(np.arange(len(anchor)), count), spread(head[anchor], count)
        some = (block != held.content[row]) & (held.several[row] | (held.least[block] < held.id[row]))
        part, block = held.part[row[some]], block[some]
        order = np.lexsort((block, part))
        part, block = part[order], block[order]
        new = np.append(True, (part[1:] != part[:-1]) | (block[1:] != block[:-1])) if len(part) else np.zeros(0, bool)
        part, block = part[new], block[new]
        data, lengths = [], np.diff(held.starts)
        head, ends = runs(part)
        for i, j in zip(head, ends, strict=True):
            own = block[i:j]
            about = pack(held.windows[own].astype(np.uint16), held.least[own])
            data.append(len(about).to_bytes(4, "little") + about + pack(held.units[spread(held.starts[own], lengths[own])]))
        return pa.table([pa.array(part[head], pa.int64()), pa.array([REGIONS] * len(head), pa.int32()), pa.array(data, pa.binary())], schema=ANSWER)

    def pieces(self, unit: Unit, key: np.ndarray, windows: np.ndarray, starts: np.ndarray, units: np.ndarray, ids: np.ndarray, part: np.ndarray, at: np.ndarray) -> pa.Table:
        """A piece is one sequence: who holds it first."""
        head, ends = runs(key)
        least = np.repeat(np.minimum.reduceat(ids, head), ends - head)
        some = least < ids
        return answers(part[some], PIECES, at[some], least[some])

    def starts(self, part: Part, table: pa.Table, split: Pieces | None) -> Iterator[np.ndarray]:
        n = part.unit.n
        texts = [part.sent]
        before = np.concatenate([b[3].before[:-1] + o for b, o in zip(part.blocks, part.offset, strict=False)] + [part.offset[-1:]])
        ids = np.concatenate([b[4] for b in part.blocks] or [np.zeros(0, np.int64)])
        begin, end, owner = [before[:-1]], [before[1:]], [ids]
        at, _, least = told(table, ASK, "<u4", "u1", "<i8")
        own = part.holder[at]  # the part's own stretches that stand elsewhere too
        begin.append(part.first[own])
        end.append(part.first[own] + part.windows[own] + n - 1)
        owner.append(least)
        if split is not None:
            at, least = told(table, PIECES, "<u4", "<i8")
            first = split.first[split.head[at]]
            begin.append(first)
            end.append(first + n)
            owner.append(least)
        total = len(part.sent)
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
            if kind == REGIONS:
                blob = data.as_py()
                size = int.from_bytes(blob[:4], "little")
                windows, least = unpack(blob[4 : 4 + size], "<u2", "<i8")
                texts.append(unpack(blob[4 + size :], part.unit.sent)[0])
                ends = total + np.cumsum(windows.astype(np.int64) + n - 1)
                begin.append(np.concatenate([[total], ends[:-1]]))
                end.append(ends)
                owner.append(least)
                total = int(ends[-1])
        sums = prefix(np.concatenate(texts))
        index = Index(n, sums, *map(np.concatenate, (begin, end, owner)))
        found = np.sort(index.parse(before[:-1], before[1:], ids)[0])
        for i in range(len(part.blocks)):
            low, high = np.searchsorted(found, part.offset[i : i + 2])
            yield found[low:high] - part.offset[i]


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, **columns) -> DataFrame:
    """Per row: doc_id, n_words, spans (the removed runs, in words) and kept (the words that stay, joined by one space)."""

    def finish(raw: np.ndarray, breaks: np.ndarray, before: np.ndarray, sent: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
        removed = covered(starts, min_words, len(sent))
        stay, data, kept = (~removed).tolist(), raw.tobytes(), []
        for i in range(len(breaks) - 1):
            own = data[breaks[i] : breaks[i + 1]].split()
            kept.append(b" ".join(compress(own, stay[before[i] : before[i + 1]])))
        return [pa.array(np.diff(before)), spans(removed, before), pa.array(kept, pa.binary())]

    return repeated(docs, Words(min_words), Factoring(HOT, 1, False), finish, "n_words long, spans array<struct<start: long, end: long>>, kept binary", **columns)
