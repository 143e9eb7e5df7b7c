"""Word shingles of whole texts as 64-bit hashes, a slice of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from palimpsa.llm.common import GOLD, mix, text_bytes

BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2 ** 64


def _byte_values() -> np.ndarray:
    """A random-looking number per byte; A-Z count as a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
    values[65:91] = values[97:123]
    return values


def _separators() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[32, 9, 10, 11, 12, 13]] = True
    return out


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def word_hashes(run: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of all texts in a run of bytes, and the index of each text's first word (one more at the end).

    Words are runs of bytes other than blanks and tab to carriage return, with A-Z as a-z; none crosses a text's bound.
    """
    n = len(run)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_separators()[run]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up = _powers(BASE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[run] * up[:n], out=sums[1:])
    down = _powers(pow(BASE, -1, 1 << 64), n)
    words = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    return words, np.searchsorted(start, bounds)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Per text its distinct shingles of ``width`` words, as sorted hashes.

    A text with fewer words has its whole sequence as one shingle; without words its set is empty.
    """
    words, first = word_hashes(*text_bytes(texts))
    n = len(words)
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for i in range(width):
        whole = whole * np.uint64(BASE) + words[i : i + len(whole)]
    whole = mix(whole + np.uint64(width))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            values = np.sort(whole[a : b - width + 1])
            fresh = np.ones(len(values), bool)
            fresh[1:] = values[1:] != values[:-1]
            out.append(values[fresh])
        elif b > a:
            value = 0
            for w in words[a:b]:
                value = (value * BASE + int(w)) % (1 << 64)
            out.append(mix(np.array([(value + int(b - a)) % (1 << 64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(values: np.ndarray) -> bytes:
    """128 bits that name a set: two independent sums over its members."""
    one = mix(values + np.uint64(1)).sum(dtype=np.uint64)
    two = mix(values * GOLD + np.uint64(3)).sum(dtype=np.uint64)
    return one.tobytes() + two.tobytes()


def set_id(name: bytes) -> int:
    """The first 64 bits of a set's name; sets that share them are told apart by the rest."""
    return int.from_bytes(name[:8], "little", signed=True)
