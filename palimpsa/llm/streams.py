"""Letter streams of whole texts as code points, and hashes of their n-grams, a slice of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palimpsa.llm.common import GOLD, SLICE_BYTES

BLANK = 32
SLICE_ROWS = 256


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def array_slices(texts: pa.Array, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.Array]:
    """Cut a column so that a piece holds about ``limit`` bytes of text and at most ``rows`` whole texts."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        stop = min(stop, start + rows)
        yield texts.slice(start, stop - start)
        start = stop


def letter_stream(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, one blank for each run of others and at both ends of each text.

    Returns the code points and the index of the text of each. A text without letters has blanks only.
    """
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) + 2 for c in codes], np.int64)
    ends = np.cumsum(sizes)
    stream = np.full(ends[-1] if len(ends) else 0, BLANK, np.uint32)
    for code, end in zip(codes, ends, strict=True):
        stream[end - len(code) - 1 : end - 1] = code
    blank = ~letters[stream]
    stream[blank] = BLANK
    keep = np.ones(len(stream), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[(ends - sizes)[:]] = True
    owner = np.repeat(np.arange(len(texts)), sizes)
    return stream[keep], owner[keep]


def gram_hashes(stream: np.ndarray, owner: np.ndarray, orders: range, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (text, bucket of ``bits`` bits) of every n-gram inside a text."""
    hashed = np.zeros(len(stream), np.uint64)
    for order in range(1, orders.stop):
        n = len(stream) - order + 1
        if n <= 0:
            return
        hashed = hashed[:n] * np.uint64(0x100000001B3) + stream[order - 1 :] + np.uint64(1)
        if order in orders:
            inside = owner[:n] == owner[order - 1 :]
            bucket = ((hashed ^ (hashed >> np.uint64(29))) * GOLD) >> np.uint64(64 - bits)
            yield owner[:n][inside], bucket[inside].astype(np.int64)
