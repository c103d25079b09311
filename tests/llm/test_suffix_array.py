"""The two-stage suffix array and its parts against sorting in plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnloom.llm import suffix_dedup as s


def flat_pieces(pieces):
    return np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8) + np.uint8(1)


def plain_order(x):
    rank = {p: i for i, p in enumerate(np.flatnonzero(x == 0).tolist())}

    def key(i):
        end = next(j for j in range(i, len(x)) if x[j] == 0)
        return [(int(c), 0) for c in x[i:end]] + [(0, rank[end])]

    return sorted(range(len(x)), key=key)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30) | st.text("abc\x00é", min_size=1, max_size=12), min_size=1, max_size=6))
def test_order_and_common_prefixes(texts):
    x = flat_pieces([t.encode() for t in texts])
    words = s.words_at(x)
    order = s.suffix_array(x, words)
    assert order.tolist() == plain_order(x)
    some = np.random.default_rng(len(x)).random(len(x)) < 0.4
    assert s.suffix_array(x, words, some).tolist() == [i for i in plain_order(x) if some[i]]
    got = s.common_prefixes(x, order, words, 20)

    def common(a, b):
        n = 0
        while n < 20 and x[a + n] == x[b + n] and x[a + n] != 0:
            n += 1
        return n

    assert got.tolist() == [0, *(common(a, b) for a, b in zip(order[:-1], order[1:]))]


@pytest.mark.parametrize("span", [2, 9, 16, 100])
def test_later_windows(span):
    rng = random.Random(span)
    base = bytes(rng.choice(b"ab c") for _ in range(400))
    pieces = [base[i : i + rng.randrange(1, 250)] for i in rng.sample(range(390), 12)] + [b"a" * 220]
    seen, want = set(), []
    for p in pieces:
        w = [p[i : i + span] for i in range(len(p) - span + 1)]
        again = []
        for i, x in enumerate(w):
            if x in seen:
                again.append(i)
            seen.add(x)
        want.append(again)
    assert [a.tolist() for a in s.later_windows(pieces, span)] == want


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 1000, 300).astype(np.uint64)
    for width in (1, 2, 3, 8, 81, 300, 301):
        assert s.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]
