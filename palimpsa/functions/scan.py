"""All matches of a pattern in a text with exact offset, line and column.

One regex pass puts a mark before and after every match; the text is then cut
at the marks and a prefix combination over the pieces yields the offsets.
Nothing leaves the row, so no shuffle is needed and a very long document cannot
skew a stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsa.functions.arrays import let, running_max, running_sum

_OPEN, _FILL, _CLOSE = "﷐", "﷑", "﷒"

MATCH_TYPE = "array<struct<position:int,line:int,column:int,matched:string>>"


def _fill(text: Column) -> Column:
    """A run of the fill character longer than any run in the text, so no mark occurs by chance."""
    runs = F.regexp_extract_all(text, F.lit(_FILL + "+"), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
    return F.when(F.contains(text, F.lit(_FILL)), F.repeat(F.lit(_FILL), longest + 1)).otherwise(F.lit(_FILL))


_LINE = 1 << 32


def _measure(piece: Column) -> Column:
    """Length and line breaks of a piece, packed into one number so one sum carries both."""
    breaks = F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
    length = F.length(piece).cast("bigint")
    return F.when(F.contains(piece, F.lit("\n")), length + breaks * F.lit(_LINE)).otherwise(length)


def _offset(packed: Column) -> Column:
    return (packed % _LINE).cast("int")


def _line_starts(before: Column, ends: Column) -> Column:
    """Offset at which the line open at the end of each piece begins."""
    own = F.transform(
        before,
        lambda p, i: F.when(
            F.contains(p, F.lit("\n")), _offset(F.get(ends, i)) - F.length(F.substring_index(p, "\n", -1))
        ).otherwise(0),
    )
    return F.when(F.element_at(ends, -1) >= _LINE, running_max(own))


def segments(text: Column, pattern: str) -> Column:
    """The text cut at its matches: even entries lie between matches, odd entries are matches."""

    def cut(mark: Column) -> Column:
        return F.split(F.regexp_replace(text, F.lit(pattern), F.concat(mark, F.lit("$0"), mark)), mark, -1)

    return let(F.concat(F.lit(_OPEN), _fill(text)), cut)


def find_all(text: Column, pattern: str | Column) -> Column:
    """Non-overlapping matches, left to right, empty ones included."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def cut(opening: Column, closing: Column) -> Column:
        marked = F.regexp_replace(text, pattern, F.concat(opening, F.lit("$0"), closing))
        return let(F.split(marked, opening, -1), lambda pieces: place(pieces, closing))

    def place(pieces: Column, closing: Column) -> Column:
        before = F.transform(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.replace(p, closing, F.lit(""))
        )
        found = let(
            before,
            lambda b: let(
                running_sum(F.transform(b, _measure)),
                lambda ends: let(_line_starts(b, ends), lambda starts: report(pieces, closing, ends, starts)),
            ),
        )
        return F.when(F.size(pieces) == 1, F.array().cast(MATCH_TYPE)).otherwise(found)

    def report(pieces: Column, closing: Column, ends: Column, starts: Column) -> Column:
        return F.transform(
            ends,
            lambda end, i: F.struct(
                _offset(end).alias("position"),
                (F.shiftright(end, 32) + 1).cast("int").alias("line"),
                (_offset(end) - F.coalesce(F.get(starts, i), F.lit(0)) + 1).alias("column"),
                F.call_function("substring_index", F.get(pieces, i + 1), closing, F.lit(1)).alias("matched"),
            ),
        )

    return let(
        F.struct(
            F.concat(F.lit(_OPEN), _fill(text)).alias("opening"),
            F.concat(F.lit(_CLOSE), _fill(text)).alias("closing"),
        ),
        lambda marks: cut(marks["opening"], marks["closing"]),
    )


def find_all_deep(text: Column, pattern: str, case_sensitive: bool) -> Column:
    """The same for patterns whose repeats would exhaust the JVM's stack on long texts; batches go through Python."""
    compiled = re.compile(pattern, 0 if case_sensitive else re.IGNORECASE)

    def matches(value: str) -> list[dict]:
        out, line, start, seen = [], 1, 0, 0
        for m in compiled.finditer(value):
            breaks = value.count("\n", seen, m.start())
            if breaks:
                line, start = line + breaks, value.rfind("\n", seen, m.start()) + 1
            seen = m.start()
            out.append({"position": seen, "line": line, "column": seen - start + 1, "matched": m.group()})
        return out

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = [(name, pa.int32()) for name in ("position", "line", "column")]
        kind = pa.list_(pa.struct([*numbers, ("matched", pa.string())]))
        for texts in batches:
            yield pa.array([matches(t.as_py()) if t.is_valid else None for t in texts], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, MATCH_TYPE)(text)
