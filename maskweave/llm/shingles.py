"""Word shingles of whole texts as 64-bit hashes, in numpy over Arrow's buffers."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 18
_rng = np.random.default_rng(20240501)
_PLACES = _rng.integers(0, 1 << 63, 64, dtype=_U) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, _SLICE + 1), base, _U)
        table[0] = 1
        have = np.multiply.accumulate(table)
        if n <= 4 * _SLICE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts raw[bounds[i]:bounds[i+1]], and each text's first word."""
    n = len(raw)
    inside = _IN_WORD[raw]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = inside & (~before | edge[:-1])
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = inside & (~after | edge[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, _U)
    np.cumsum((_LOWER[raw].astype(_U) + _U(1)) * _power(_BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, n + 1)[starts]
    return mix(h ^ (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)), np.searchsorted(starts, bounds)


def _sets(raw: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    words, at = _word_hashes(raw, bounds)
    n = max(0, len(words) - width + 1)
    grams = np.zeros(n, _U)
    for j in range(width):
        grams += words[j : j + n] * _PLACES[j]
    grams = mix(grams)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * _PLACES[: b - a]).sum(dtype=_U) + _U(b - a)], _U))
        else:
            yield np.zeros(0, _U)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one for the whole text if it has fewer words; none for null or no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):  # a slice at a time, or one text
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE, "right")) - 1)
        yield from _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        i = j


class MinHash:
    """Signatures of ``k`` coordinates; a key names a coordinate and its value."""

    def __init__(self, k: int):
        rng = np.random.default_rng(7)
        self.xor = rng.integers(0, 1 << 63, k, dtype=_U)
        self.mul = rng.integers(0, 1 << 63, k, dtype=_U) * _U(2) + _U(1)
        self.tag = mix(np.arange(1, k + 1, dtype=_U))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.xor), np.iinfo(_U).max, _U)
        for i in range(0, len(shingles), 2048):
            part = (shingles[i : i + 2048, None] ^ self.xor) * self.mul
            np.minimum(least, part.min(axis=0), out=least)
        return mix(least ^ self.tag).view(np.int64)
