"""Alignment of two tokenizers over the same bytes by a dangling-suffix transducer, and corpus-wide counts of linked tokens.

Side A is a tokenizers file with a byte-level vocabulary, which encodes space + text; side B a sentencepiece file, which puts a space before the text by itself.
The transducer reads both token sequences at once. Its state is the side that leads and the bytes by which it does (the dangling suffix); the next token comes
from the other side, or from A while nothing dangles. A token that goes on with the suffix shortens it, or takes the lead with what remains of its own bytes; any other one ends the run. Where nothing is left
dangling, both sides end: a group closes. Transitions are remembered by state and token, states by number, so bytes are compared once for each pair met.

Texts are encoded in chunks, cut before a space that follows something else than white space: A's pattern begins a new match there, and none of B's pieces holds a space
after another character (looked up in the vocabulary; else whole texts are encoded). So what a chunk gives is remembered too, within a bound. Where the bytes of a chunk's
tokens differ from the chunk, the text is encoded and run as a whole and has no tokens if its bytes differ.

A link is the pair of tokens that end a group. Counts of pairs are added up in each batch, then by pair. Documents meet the counts of their pairs
in a join by pair; the pairs that make up more than 1 / HOT of all links, so HOT at most, are sent to all tasks instead, so that no common pair lands in one task.

Null and empty texts, and those whose bytes differ, have no tokens: zeros and an empty text of groups. Ids may be null or repeated; repeated rows are rows of their own. Special tokens
in a text are plain text. Columns besides id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.base import bound_batches, materialize, pack, unpack
from weft.llm.tokens import Remembered, byte_names

#: Chunks that a worker remembers (twice, see Remembered), transitions it remembers, and the pairs that are sent to all tasks at most.
CHUNKS, TRANSITIONS, HOT = 200_000, 1_000_000, 10_000
#: Pairs that a task counts before it hands its counts on.
PAIRS = 1 << 20
_CUT = re.compile(r"(?<=\S) (?!\Z)")
_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, links binary"


class Transducer:
    """Aligns token sequences of two vocabularies given as lists of bytes by id."""

    def __init__(self, a: list[bytes], b: list[bytes], limit: int = TRANSITIONS):
        self.sides, self.limit = (a, b), limit
        self.forget()

    def forget(self) -> None:
        #: Number of each state, and the states: the side that leads (0 for A, 1 for B) and its dangling bytes. State 0: nothing dangles.
        self.number, self.states, self.next = {(0, b""): 0}, [(0, b"")], {}

    def step(self, state: int, token: int) -> int:
        """The state after the next token of the side that does not lead (of A in state 0); -1 if its bytes don't go on with the suffix."""
        lead, suffix = self.states[state]
        side = 1 - lead if state else 0
        told = self.sides[side][token]
        if not state:
            then = (0, told)
        elif suffix.startswith(told):
            then = (lead, suffix[len(told) :])
        elif told.startswith(suffix):
            then = (side, told[len(suffix) :])
        else:
            return -1
        if not then[1]:
            return 0
        if then not in self.number:
            self.number[then] = len(self.states)
            self.states.append(then)
        return self.number[then]

    def __call__(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Where the groups end: how many tokens of a and of b each time. None if the bytes differ."""
        if len(self.next) > self.limit:
            self.forget()
        known, states, ends, i, j, state = self.next, self.states, [], 0, 0, 0
        while True:
            if state and not states[state][0]:
                if j == len(b):
                    return None
                token, j = b[j], j + 1
            elif i < len(a):
                token, i = a[i], i + 1
            else:
                return ends if not state and j == len(b) else None
            key = state << 32 | token
            then = known.get(key)
            if then is None:
                then = known[key] = self.step(state, token)
            if not then:
                ends.append((i, j))
            elif then < 0:
                return None
            state = then


class Encoder:
    """Both tokenizers, their transducer, and what chunks give."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte = {name: b for b, name in byte_names().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.separable = not any(re.search("[^▁]▁", n) for n in names)
        self.align = Transducer(self.bytes_a, self.bytes_b)
        self.chunks = Remembered(self._chunks, CHUNKS)

    def _run(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[tuple[int, int]] | None]]:
        """Of texts that begin with a space: the ids of both sides and the ends of the groups, None if the bytes differ."""
        for text, a, b in zip(texts, (e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)), self.b.encode([t[1:] for t in texts], num_threads=1), strict=True):
            same = b"".join(map(self.bytes_a.__getitem__, a)) == text.encode()
            yield a, b, self.align(a, b) if same else None

    def _told(self, a: list[int], b: list[int], ends: list[tuple[int, int]]) -> tuple[int, int, str, bytes]:
        """Tokens of both sides, the groups as text, and the links as 64-bit numbers."""
        groups, i, j = [], 0, 0
        for x, y in ends:
            groups.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
            i, j = x, y
        return len(a), len(b), ";".join(groups), b"".join((a[x - 1] << 32 | b[y - 1]).to_bytes(8, "little") for x, y in ends)

    def _chunks(self, chunks: list[str]) -> list[tuple[int, int, str, bytes] | bool]:
        return [self._told(*r) if r[2] is not None else False for r in self._run([" " + c for c in chunks])]

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, str, bytes]]:
        """What each text gives; zeros and nothing for a text without tokens."""
        out = [(0, 0, "", b"")] * len(texts)
        cut = [_CUT.split(t) if t and self.separable else [] for t in texts]
        found, at = self.chunks(c for chunks in cut for c in chunks), 0
        for k, (text, chunks) in enumerate(zip(texts, cut, strict=True)):
            mine, at = found[at : at + len(chunks)], at + len(chunks)
            if mine and all(mine):
                n_a, n_b, groups, links = zip(*mine, strict=True)
                out[k] = (sum(n_a), sum(n_b), ";".join(groups), b"".join(links))
            elif text:
                ((a, b, ends),) = self._run([" " + text])
                if ends is not None:
                    out[k] = self._told(a, b, ends)
        return out


@lru_cache(maxsize=1)
def encoder(path_a: str, path_b: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`) and links (distinct pairs and their numbers, packed)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path_a, path_b)
        for batch in batches:
            n_a, n_b, groups, links = zip(*encode(batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((),) * 4
            counted = [np.unique(np.frombuffer(x, "<u8"), return_counts=True) for x in links]
            n = pa.array([len(x) // 8 for x in links], pa.int64())
            packed = pa.array([pack(key, k.astype("<u4")) for key, k in counted], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), n, n, pa.array(groups, pa.string()), packed], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return bound_batches(docs).mapInArrow(run, f"doc_id {kind}, {_ALIGNED}")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """For each linked pair: pair (A's id * 2^32 + B's id), n (its links), best (whether none of its B id has more); written to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            parts += [_merged([unpack(x.as_py(), "<u8", "<u4") for x in batch.column("links")])] if batch.num_rows else []
            size += len(parts[-1][0]) if parts else 0
            if size > PAIRS:
                parts = [_merged(parts)]
                size = len(parts[0][0])
                if size > PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].astype(np.int64)), pa.array(parts[0][1])], ["pair", "n"])
                    parts, size = [], 0
        if parts:
            key, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], ["pair", "n"])

    pairs = aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    best = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return materialize(pairs.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def score(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """aligned (written before, with a rid for each row) without its links, with n_best (links whose pair is best) and count_sum (counts of all links added up)."""
    total = pairs.agg(F.sum("n")).first()[0] or 0
    hot = pairs.where(F.col("n") * HOT > total).orderBy("pair").collect()  # fewer than HOT
    keys, ns, bests = np.array([r.pair for r in hot], np.uint64), np.array([r.n for r in hot], np.int64), np.array([r.best for r in hot], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, without a pair, with what its hot pairs give; a row for each of its other pairs."""
        for batch in batches:
            rows = []
            for rid, x in zip(batch.column("rid").to_numpy(), batch.column("links"), strict=True):
                key, k = unpack(x.as_py(), "<u8", "<u4")
                k = k.astype(np.int64)
                at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                is_hot = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                at, kh = at[is_hot], k[is_hot]
                cold = np.flatnonzero(~is_hot)
                zero = np.zeros(len(cold), np.int64)
                rows.append((np.full(len(cold) + 1, rid), np.append(-1 - rid, key[cold].astype(np.int64)), np.append(0, k[cold]), np.append((kh * bests[at]).sum(), zero), np.append((kh * ns[at]).sum(), zero)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows, strict=True)], ["rid", "pair", "k", "n_best", "count_sum"])

    rows = aligned.select("rid", "links").mapInArrow(run, "rid long, pair long, k long, n_best long, count_sum long")
    told = rows.join(pairs, "pair", "left")  # a document's own row has a negative number, which no pair has
    told = told.groupBy("rid").agg(
        F.sum(F.col("n_best") + F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("count_sum") + F.col("k") * F.coalesce("n", F.lit(0))).alias("count_sum")
    )
    return aligned.drop("links").join(told, "rid").drop("rid")
