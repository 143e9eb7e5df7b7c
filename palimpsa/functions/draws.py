"""Repeatable draws: a hash of stable keys, so a retried task draws the same again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32


def text_seed(text: Column, label: Column) -> Column:
    """First 16 hex digits of sha256(label::text). Kept as hex: it may exceed a signed 64-bit number."""
    return F.substring(F.sha2(F.concat_ws("::", label, text).cast("binary"), 256), 1, 16)


def draw(*keys: Column) -> Column:
    """Whole number in [0, 2**32) from the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys).cast("binary")), 1, 8), 16, 10).cast("bigint")


def threshold(probability: float) -> int:
    """Largest draw that counts as a hit."""
    return int(probability * RANGE)
