"""Work of the substring deduplications at size."""

import numpy as np
import pytest

from weft.llm.bytespans import Bytes, boundaries, transform
from weft.llm.spans import numbers


def test_messages_grow_with_the_text_and_not_with_its_square():
    parts, buckets = numbers(1 << 30, Bytes(50))
    for times in (4, 16, 32):
        p, b = numbers(times << 30, Bytes(50))
        assert p * b <= 2 * times * parts * buckets


@pytest.mark.parametrize("n", [1, 3, 8, 40])
def test_expansion_begins_at_the_first_symbols_that_are_sorted(n):
    texts = [b"abracadabra" * 6, b"cadabra", b"", b"abra" * 20, bytes(range(97, 123)) * 2]
    starts = np.cumsum([0, *map(len, texts)])
    order, bwt, first, parted, h = transform(np.frombuffer(b"".join(texts), np.uint8), starts, n)
    assert 1 <= h <= n
    ends = [t + bytes([0, i]) for i, t in enumerate(texts)]
    suffix = [e[j:-2] + b"\0%d" % i for i, e in enumerate(ends) for j in range(len(e) - 1)]
    by = [suffix[i] for i in order]
    share = [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(by, by[1:], strict=False)]
    share = [min(s, a.index(0), b.index(0)) for s, a, b in zip(share, by, by[1:], strict=False)]
    assert list(boundaries(bwt, first, parted, h, n)[1:]) == [s < n for s in share]
