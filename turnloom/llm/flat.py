"""Flat numpy views of text batches: words and hashes of many texts at once, inside a task."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = [U(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

#: Bytes that are not white space: `[^\x20\x09-\x0D]`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, lower-case letters and everything beyond ASCII: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Texts:
    """Texts one behind the other, each followed by one space; `starts` has one more entry than there are texts."""

    data: np.ndarray
    starts: np.ndarray


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    #: Text i has the words first[i]:first[i + 1].
    first: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> U(30))) * _MULTIPLIERS[0]
    h = (h ^ (h >> U(27))) * _MULTIPLIERS[1]
    return h ^ (h >> U(31))


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[slice]:
    """Row ranges of a string column of about `most` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.cumsum(sizes) // max(1, most)
    cuts = np.flatnonzero(np.diff(of)) + 1
    at = [0, *cuts.tolist(), len(sizes)]
    for a, b in zip(at, at[1:]):
        if b > a:
            yield slice(a, b)


def texts(column: pa.Array, rows: slice, lower: bool) -> Texts:
    """The given rows as one buffer; a null is an empty text."""
    part = [b"" if t is None else t for t in column[rows.start : rows.stop].cast(pa.binary()).to_pylist()]
    data = np.frombuffer(b" ".join([*part, b""]), np.uint8)
    starts = np.zeros(len(part) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in part], out=starts[1:])
    return Texts(LOWER[data] if lower else data, starts)


def words(t: Texts, is_word: np.ndarray) -> Words:
    inside = np.zeros(len(t.data) + 1, np.int8)
    inside[1:] = is_word[t.data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return Words(starts, ends, np.searchsorted(starts, t.starts))


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """One object per Python worker process, also where functions travel by value and bring their own globals."""
    store = sys.modules.setdefault("_turnloom_worker", ModuleType("_turnloom_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def make() -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base & 0xFFFFFFFFFFFFFFFF, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return out[0], out[1]

    return per_worker(("powers", size), make) if size <= 4 * BLOCK_BYTES else make()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Entry i sums the first i bytes, each times a power of the base, modulo 2**64."""
    out = np.zeros(len(data) + 1, U)
    power, _ = _powers(1 << max(16, int(len(data)).bit_length()))
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges; equal content gives equal hashes wherever it stands."""
    _, inverse = _powers(1 << max(16, int(len(prefix) - 1).bit_length()))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


#: Words are hashed as polynomials modulo this prime at a point drawn once for each of two independent hashes.
PRIME = U((1 << 61) - 1)
POINTS = (0x0B5A3F1D97C24E61, 0x13C9D27A5E08F4B3)
#: Longer stretches are summed piece by piece, so that no sum leaves 64 bits.
PIECE = 1 << 22


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for values below it."""
    low = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    middle = a1 * b0 + a0 * b1
    return _reduced(U(2) * a1 * b1 + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << U(31)) + a0 * b0)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _points(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the point, cut into their low 32 and high 29 bits, and powers of its inverse."""

    def powers(base: int) -> np.ndarray:
        p = np.ones(1, U)
        while len(p) < size:
            p = np.concatenate([p, times(p, np.full(len(p), pow(base, len(p), int(PRIME)), U))])
        return p

    def make() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        up = powers(POINTS[which])
        return (up & U(0xFFFFFFFF)).astype(np.uint32), (up >> U(32)).astype(np.uint32), powers(pow(POINTS[which], -1, int(PRIME)))

    if size > 2 * BLOCK_BYTES:
        return make()
    size = 2 * BLOCK_BYTES  # one table serves all smaller ones
    return per_worker(("points", which), make)


def word_hashes(t: Texts, w: Words, which: int = 0) -> np.ndarray:
    """64 bits for each word; `which` chooses one of two hashes whose collisions have nothing to do with each other."""
    low, high, inverse = _points(which, 1 << max(16, int(len(t.data)).bit_length()))
    data = t.data.astype(U) + U(1)
    sums = []
    for part in (low, high):
        s = np.zeros(len(data) + 1, U)
        np.cumsum(data * part[: len(data)].astype(U), out=s[1:])
        sums.append(s)

    def total(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lows, highs = (s[ends] - s[starts] for s in sums)
        return _reduced(_reduced(lows) + (highs >> U(29)) + ((highs & U((1 << 29) - 1)) << U(32)))

    out = total(w.starts, np.minimum(w.ends, w.starts + PIECE))
    for i in np.flatnonzero(w.ends - w.starts > PIECE):
        at = np.arange(w.starts[i] + PIECE, w.ends[i], PIECE)
        for x in total(at, np.minimum(at + PIECE, w.ends[i])):
            out[i : i + 1] = _reduced(out[i : i + 1] + x)
    return mix(times(out, inverse[w.starts]))


def stretch_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the ranges of a sequence of hashes, as polynomials modulo PRIME; equal ranges have equal ones."""
    low, high, inverse = _points(which, 1 << max(16, int(len(h)).bit_length()))
    terms = times(_reduced(h), low[: len(h)].astype(U) | high[: len(h)].astype(U) << U(32))
    lows, highs = np.zeros(len(h) + 1, U), np.zeros(len(h) + 1, U)
    np.cumsum(terms & U((1 << 31) - 1), out=lows[1:])
    np.cumsum(terms >> U(31), out=highs[1:])
    lows, highs = lows[ends] - lows[starts], highs[ends] - highs[starts]
    total = _reduced((highs >> U(30)) + ((highs & U((1 << 30) - 1)) << U(31)) + _reduced(lows))
    return mix(times(total, inverse[starts]))


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` neighbours in h, in order."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for i in range(length):
        out = mix(out + h[i : i + n] * _MULTIPLIERS[i % 5] + U(i + 1))
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(U).view(np.int64)
