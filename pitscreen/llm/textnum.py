"""Word and n-gram hashes of whole Arrow batches as numpy arrays.

A word is a maximal run of bytes outside ASCII white space. A word's hash is a
difference of running sums of byte * base**position (modulo 2**64), shifted to
position 0, so all words, and all prefixes of words, cost a few array passes.
Two different words share a hash with a probability of about 2**-60.
"""
from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    doc: np.ndarray    # row of the word, ascending
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray   # running sums, one longer than the bytes
    hash: np.ndarray


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        powers = np.ones(1, np.uint64)
        for _ in range(bits):
            step = powers[-1:] * np.uint64(base)
            powers = np.concatenate([powers, powers * step])
        out.append(powers)
    return out[0], out[1]


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for every position below `length`, at least."""
    return _powers(max(20, int(length).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def running(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """All words of the texts data[offsets[i]:offsets[i + 1]]."""
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:len(data)]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    sums = running(data)
    return Words(np.searchsorted(offsets, start, side="right") - 1, start, end, sums, span_hash(sums, start, end))


def shingles(found: Words, rows: int, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than `size` make one shingle, none make none."""
    h, doc = found.hash, found.doc
    bounds = np.searchsorted(doc, np.arange(rows + 1))
    factor = np.uint64(0xC2B2AE3D27D4EB4F)
    count = max(0, len(h) - size + 1)
    grams = np.zeros(count, np.uint64)
    for j in range(size):
        grams = (grams + h[j:j + count]) * factor
    grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            run = np.sort(grams[a:b - size + 1])
            if len(run) > 1:
                keep = np.empty(len(run), bool)
                keep[0] = True
                np.not_equal(run[1:], run[:-1], out=keep[1:])
                run = run[keep]
            out.append(run)
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                short = mix(short + h[i:i + 1])
            out.append(short)
        else:
            out.append(h[:0])
    return out
