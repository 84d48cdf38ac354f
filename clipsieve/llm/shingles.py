"""Word shingles of whole texts as 64-bit hashes, a batch of texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Words in a shingle.
WIDTH = 5
#: Bytes of text hashed at once; a longer text goes in parts, which end at white space.
SLICE = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of an odd number mod 2**64 and of its inverse."""
    inverse = np.uint64(pow(int(_ODD), -1, 2**64))
    out = []
    for base in (_ODD, inverse):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _kept_series() -> tuple[np.ndarray, np.ndarray]:
    return _series(SLICE + 1)


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random value for each byte, A-Z as a-z; and which bytes are white space."""
    lower = np.arange(256)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return mix(lower.astype(np.uint64) + np.uint64(1)), space


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs [start, end)."""
    value, _ = _bytes()
    powers, inverse = _kept_series() if len(data) <= SLICE else _series(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(value[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts between ``offsets`` of ``data``, and each text's first word (one more at the end)."""
    _, space = _bytes()
    solid = ~space[data]
    bounds = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    before, after = np.empty_like(solid), np.empty_like(solid)
    if len(data):
        before[0] = after[-1] = False
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[bounds] = False
        after[bounds - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return _hash_words(data, starts, ends), np.searchsorted(starts, offsets)


def _sets(words: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """Shingle sets of texts whose words are ``words[first[i]:first[i + 1]]``."""
    factors = [mix(np.array([k + 101], np.uint64))[0] | np.uint64(1) for k in range(WIDTH)]
    n = max(0, len(words) - WIDTH + 1)
    rolled = np.zeros(n, np.uint64)
    for k, f in enumerate(factors):
        rolled += words[k : k + n] * f
    rolled = mix(rolled)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= WIDTH:
            found = np.sort(rolled[lo : hi - WIDTH + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif hi > lo:
            whole = np.uint64(hi - lo)
            for k in range(hi - lo):
                whole = np.bitwise_xor(whole, mix(words[lo + k : lo + k + 1] + np.uint64(k))[0])
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def word_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of ``texts`` in order: hashes of all words, and where each text's begin (one more at the end).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; null counts as empty.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, at, raw = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        if offsets[hi] - offsets[lo] > SLICE:
            words = _long_words(data[offsets[lo] : offsets[hi]])
            yield words, np.array([0, len(words)])
        else:
            yield _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def _long_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long text; a part is longer than SLICE only by the word at its end."""
    _, space = _bytes()
    out, lo = [], 0
    while lo < len(data):
        hi = min(lo + SLICE // 2, len(data))
        while hi < len(data) and not (ends := np.flatnonzero(space[data[hi : hi + SLICE // 2]])[:1]).size:
            hi = min(hi + SLICE // 2, len(data))
        hi = hi + int(ends[0]) if hi < len(data) else hi
        out.append(_words(data[lo:hi], np.array([0, hi - lo]))[0])
        lo = hi
    return np.concatenate(out)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; null and wordless texts: none.

    A text of fewer than WIDTH words has one shingle, the whole sequence.
    """
    for words, first in word_hashes(texts):
        yield from _sets(words, first)


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a set of shingles."""
    total = int(shingles.sum(dtype=np.uint64)) + int(np.bitwise_xor.reduce(shingles, initial=np.uint64(0))) * int(_ODD) + len(shingles)
    return int(mix(np.array([total % 2**64], np.uint64)).view(np.int64)[0])
