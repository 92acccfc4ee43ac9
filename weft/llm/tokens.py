"""Token ids of whole texts by public tokenizers, with the ids of words remembered in each Python worker.

Words recur, so encoding each distinct one once is far cheaper than encoding texts. It is right where no token goes over the place at
which a text is cut; each user of Remembered says why that holds for its tokenizer. What is remembered is bounded.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that a worker remembers: the recent ones, and as many of before.
REMEMBERED = 300_000


class Remembered:
    """Values of words. make gives the values of a list of words; those met lately are kept."""

    def __init__(self, make: Callable[[list[str]], list], limit: int = REMEMBERED):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def __call__(self, words: Iterable[str]) -> list:
        """The value of each word."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        words, young = list(words), self.young
        found = list(map(young.get, words))
        missing = dict.fromkeys(w for w, v in zip(words, found, strict=True) if v is None)
        if missing:
            again = {w: v for w, v in zip(missing, map(self.old.get, missing), strict=True) if v is not None}
            young.update(again)
            new = [w for w in missing if w not in again]
            young.update(zip(new, self.make(new), strict=True))
            found = list(map(young.__getitem__, words))
        return found


@lru_cache(maxsize=1)
def byte_names() -> dict[int, str]:
    """The printable character by which byte-level vocabularies name each byte: itself where it is printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        names.setdefault(b, chr(256 + sum(1 for x in range(b) if x not in plain)))
    return names


#: Settings of word tokenizers whose parts of words need not go through the whole tokenizer, and what their pattern means for text of printable ASCII and of Latin letters.
_PLAIN_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PLAIN_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LATIN = r"^[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-į]*$"
_LATIN_PART = r"[\x09-\x0d\x20]*('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-į]+|[0-9]|[^\x09-\x0d\x20a-z0-9ß-öø-į]+)"


class WordIds:
    """Ids of texts by a tokenizers file that drops white space.

    Texts are cut at spaces and line feeds: such tokenizers split at white space before anything else, and neither normal forms nor
    letter case look over it. Where the file has the settings above, words of ASCII and Latin letters are cut as its pattern does, and each part goes
    straight to the model. separable=False encodes whole texts.
    """

    def __init__(self, path: str, separable: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer, self.separable = Tokenizer.from_file(path), separable
        about = json.loads(self.tokenizer.to_str())
        split = (about.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.plain = (about.get("normalizer") or {}).get("normalizers") == _PLAIN_NORMALIZERS and split[0].get("pattern") == {"Regex": _PLAIN_PATTERN} and split[-1].get("use_regex") is False and len(split) == 2
        self.marks = "|".join(re.escape(t["content"]) for t in about.get("added_tokens", []))
        self.parts = Remembered(self._parts)
        self.words = Remembered(self._encode)

    def _parts(self, parts: list[str]) -> list[bytes]:
        names, tokenize = byte_names(), self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(p if p.isascii() else "".join(map(names.__getitem__, p.encode())))]).tobytes() if not p.isspace() else b"" for p in parts]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        easy = pc.match_substring_regex(words, _LATIN).to_numpy(zero_copy_only=False) if self.plain else np.zeros(len(words), bool)
        if self.plain and self.marks:
            easy &= ~pc.match_substring_regex(words, self.marks).to_numpy(zero_copy_only=False)
        counts, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(words.filter(pa.array(easy))), _LATIN_PART, "\\1\0"), "\0")
        a, counts[easy] = _joined(cut, self.parts)
        b, counts[~easy] = _flat(self.words(words.filter(pa.array(~easy)).to_pylist()))
        for which, base in ((easy, 0), (~easy, len(a))):
            starts[which] = np.cumsum(counts[which]) - counts[which] + base
        return np.concatenate([a, b])[ranges(starts, counts)], counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has. Null texts have none."""
        texts = texts.fill_null("")
        if not self.separable:
            return _flat(self._encode(texts.to_pylist()))
        return _joined(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "), self._word_ids)


def _flat(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(blobs), "<u4"), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4


def _joined(lists: pa.ListArray, values: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of lists of strings, and how many each list has. values tells those of distinct strings."""
    coded = lists.flatten().dictionary_encode()
    at = coded.indices.to_numpy()
    pool, lengths = _flat(values(coded.dictionary.to_pylist())) if isinstance(values, Remembered) else values(coded.dictionary)
    n = lengths[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    return pool[ranges((np.cumsum(lengths) - lengths)[at], n)], np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


@lru_cache(maxsize=2)
def word_ids(path: str, separable: bool = True) -> WordIds:
    """One for each worker process, so that words stay remembered from task to task."""
    return WordIds(path, separable)



def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
