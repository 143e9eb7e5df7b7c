"""Span arithmetic on arrays of struct<start,end>, per document and inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsa.functions.arrays import let, running_max
from palimpsa.functions.texts import escape_markup

# A substring walks the text from its start. Above this many pieces a text is
# cut from its character array instead, which is linear in the text.
DENSE = 128


def cut(text: Column, pieces: Column) -> Column:
    """The substrings of ``text`` named by ``pieces`` (array of struct<start,end>)."""
    direct = F.transform(pieces, lambda p: text.substr(p["start"] + 1, p["end"] - p["start"]))
    by_chars = let(
        F.split(text, "", -1),
        lambda chars: F.transform(
            pieces, lambda p: F.array_join(F.slice(chars, p["start"] + 1, p["end"] - p["start"]), "")
        ),
    )
    return F.when(F.size(pieces) > DENSE, by_chars).otherwise(direct)


def merge(spans: Column) -> Column:
    """Union of spans: sorted and disjoint, touching ones joined."""

    def islands(ordered: Column) -> Column:
        return let(
            running_max(F.transform(ordered, lambda s: s["end"])),
            lambda reach: let(
                F.filter(
                    F.transform(ordered, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"))),
                    lambda s: (s["i"] == 0) | (s["start"] > F.get(reach, s["i"] - 1)),
                ),
                lambda heads: F.transform(
                    heads,
                    lambda h, j: F.struct(
                        h["start"].alias("start"),
                        F.get(
                            reach, F.coalesce(F.get(heads, j + 1)["i"], F.size(reach)) - 1
                        ).alias("end"),
                    ),
                ),
            ),
        )

    return let(F.sort_array(spans), islands)


def kept(text: Column, islands: Column) -> Column:
    """What remains between disjoint sorted spans: one piece more than there are spans."""
    return F.transform(
        F.sequence(F.lit(0), F.size(islands)),
        lambda j: F.struct(
            F.coalesce(F.get(islands, j - 1)["end"], F.lit(0)).alias("start"),
            F.coalesce(F.get(islands, j)["start"], F.length(text)).alias("end"),
        ),
    )


def delete(text: Column, islands: Column) -> Column:
    """``text`` without the spans; everything else is unchanged."""
    shorter = let(kept(text, islands), lambda pieces: F.array_join(cut(text, pieces), ""))
    return F.when(F.size(islands) == 0, text).otherwise(shorter)


def preview(text: Column, islands: Column) -> Column:
    """Escaped text with the spans wrapped in deletion markup."""

    def join(stay: Column, gone: Column) -> Column:
        return F.array_join(
            F.transform(
                stay,
                lambda piece, j: F.concat(
                    escape_markup(piece),
                    F.when(F.get(gone, j).isNull() | (F.get(gone, j) == ""), F.lit("")).otherwise(
                        F.concat(F.lit('<del class="wm-removed">'), escape_markup(F.get(gone, j)), F.lit("</del>"))
                    ),
                ),
            ),
            "",
        )

    marked = let(
        F.struct(
            let(kept(text, islands), lambda pieces: cut(text, pieces)).alias("stay"),
            cut(text, islands).alias("gone"),
        ),
        lambda parts: join(parts["stay"], parts["gone"]),
    )
    return F.when(F.size(islands) == 0, escape_markup(text)).otherwise(marked)
