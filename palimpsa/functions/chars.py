"""The invisible and look-alike characters that are flagged, and how they are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsa.functions.arrays import literal_map

# Zero-width and format characters.
FORMAT_CHARS = {
    0x200B: "ZERO WIDTH SPACE",
    0x200C: "ZERO WIDTH NON-JOINER",
    0x200D: "ZERO WIDTH JOINER",
    0x200E: "LEFT-TO-RIGHT MARK",
    0x200F: "RIGHT-TO-LEFT MARK",
    0xFEFF: "ZERO WIDTH NO-BREAK SPACE (BOM)",
    0x2060: "WORD JOINER",
    0x2061: "FUNCTION APPLICATION",
    0x2062: "INVISIBLE TIMES",
    0x2063: "INVISIBLE SEPARATOR",
    0x2064: "INVISIBLE PLUS",
    0x180E: "MONGOLIAN VOWEL SEPARATOR",
    0x00AD: "SOFT HYPHEN",
    0x2028: "LINE SEPARATOR",
    0x2029: "PARAGRAPH SEPARATOR",
    0x061C: "ARABIC LETTER MARK",
}

# Spaces that look like an ordinary space.
LOOKALIKE_SPACES = {
    0x00A0: "NO-BREAK SPACE",
    0x2000: "EN QUAD",
    0x2001: "EM QUAD",
    0x2002: "EN SPACE",
    0x2003: "EM SPACE",
    0x2004: "THREE-PER-EM SPACE",
    0x2005: "FOUR-PER-EM SPACE",
    0x2006: "SIX-PER-EM SPACE",
    0x2007: "FIGURE SPACE",
    0x2008: "PUNCTUATION SPACE",
    0x2009: "THIN SPACE",
    0x200A: "HAIR SPACE",
    0x202F: "NARROW NO-BREAK SPACE",
    0x205F: "MEDIUM MATHEMATICAL SPACE",
    0x3000: "IDEOGRAPHIC SPACE",
}

# Ranges and the labels they share.
BIDI_RANGE = (0x202A, 0x202E)
TAG_RANGE = (0xE0000, 0xE007F)
NONCHARACTERS = (0xFFFE, 0xFFFF)
TAG_NAME = "UNICODE TAG CHARACTER (steganographic payload)"
NONCHARACTER_NAME = "NONCHARACTER"

# Every flagged character is outside ASCII, so the class is intersected with
# "not ASCII": plain text leaves the character test after one comparison.
FLAGGED_CLASS = (
    r"[[^\x{0}-\x{7F}]&&["
    r"\x{AD}\x{61C}\x{180E}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{FEFF}"
    r"\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
    r"\x{E0000}-\x{E007F}\x{FFFE}\x{FFFF}]]"
)

# Look-alike spaces alone, for the opt-in that keeps words apart.
SPACE_CLASS = r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def singles() -> list[tuple[int, str, str]]:
    """(code point, name, class) for every character that has a name of its own."""
    rows = [(cp, name, "format") for cp, name in FORMAT_CHARS.items()]
    rows += [(cp, f"BIDI CONTROL U+{cp:04X}", "bidi") for cp in range(BIDI_RANGE[0], BIDI_RANGE[1] + 1)]
    rows += [(cp, f"SUSPICIOUS SPACE ({name})", "space") for cp, name in LOOKALIKE_SPACES.items()]
    rows += [(cp, NONCHARACTER_NAME, "nonchar") for cp in NONCHARACTERS]
    return rows


def char_table(spark: SparkSession) -> DataFrame:
    """Lookup by code point: 38 rows fixed by the tables above, so it may be broadcast."""
    return spark.createDataFrame(singles(), "cp int, name string, class string")


def range_table(spark: SparkSession) -> DataFrame:
    """Lookup by range, cut at multiples of 128 so that a range join has an equality key."""
    lo, hi = TAG_RANGE
    rows = [(block, lo, hi, TAG_NAME, "tag") for block in range(lo >> 7, (hi >> 7) + 1)]
    return spark.createDataFrame(rows, "block int, lo int, hi int, name string, class string")


def _lookup(slot: int) -> Column:
    return literal_map((chr(row[0]), row[slot]) for row in singles())


def char_name(ch: Column) -> Column:
    """Name of one flagged character; the classes are disjoint, so the order is free."""
    return F.coalesce(F.try_element_at(_lookup(1), ch), F.lit(TAG_NAME))


def char_class(ch: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(2), ch), F.lit("tag"))


def code_point_label(ch: Column) -> Column:
    cp = F.ascii(ch)
    digits = F.hex(cp)
    return F.concat(F.lit("U+"), F.when(cp < 0x10000, F.lpad(digits, 4, "0")).otherwise(digits))
