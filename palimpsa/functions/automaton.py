"""Many literal keywords in one pass of a text: an Aho-Corasick automaton per task, fed with Arrow batches."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP_TYPE = (
    "array<struct<ordinal:int,keyword:string,matches:array<struct<position:int,line:int,column:int,matched:string>>>>"
)


def _fold(c: str) -> str:
    """A character as caseless matching compares it: upper case, then lower case, where those are single characters."""
    upper = c.upper()
    lower = (upper if len(upper) == 1 else c).lower()
    return lower[0]


_TABLES: list[tuple[dict[int, str], re.Pattern]] = []


def _tables() -> tuple[dict[int, str], re.Pattern]:
    """Characters that folding changes, and those that ``str.lower`` folds otherwise."""
    if not _TABLES:
        every = {c: _fold(chr(c)) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000}
        changed = {c: f for c, f in every.items() if f != chr(c)}
        # A capital sigma is lowered by its place in the word.
        other = [chr(c) for c, f in every.items() if chr(c).lower() != f or f == "σ" and chr(c) != "σ"]
        _TABLES.append((changed, re.compile(f"[{re.escape(''.join(other))}]")))
    return _TABLES[0]


def folded(text: str) -> str:
    """The text with every character folded; offsets stay as they are."""
    if text.isascii():
        return text.lower()
    changed, other = _tables()
    return text.translate(changed) if other.search(text) else text.lower()


def build(keywords: list[tuple[int, str]], case_sensitive: bool) -> ahocorasick.Automaton:
    """States for all keywords; a state that ends one holds its length and the numbers of all that read the same."""
    by_word: dict[str, list[int]] = {}
    for ordinal, keyword in keywords:
        by_word.setdefault(keyword if case_sensitive else folded(keyword), []).append(ordinal)
    automaton = ahocorasick.Automaton()
    for word, ordinals in by_word.items():
        automaton.add_word(word, (len(word), ordinals))
    automaton.make_automaton()
    return automaton


def scan(automaton: ahocorasick.Automaton, text: str, case_sensitive: bool) -> dict[int, list[dict]]:
    """Matches by keyword number: each keyword's from left to right without overlap; those of different ones may overlap."""
    found: dict[int, list[dict]] = {}
    free: dict[int, int] = {}
    breaks: list[int] | None = None
    for last, (length, ordinals) in automaton.iter(text if case_sensitive else folded(text)):
        start = last + 1 - length
        if start < free.get(ordinals[0], 0):
            continue
        if breaks is None:
            breaks = [m.start() for m in re.finditer("\n", text)]
        line = bisect_right(breaks, start - 1)
        begins = breaks[line - 1] + 1 if line else 0
        match = {"position": start, "line": line + 1, "column": start - begins + 1, "matched": text[start : last + 1]}
        free[ordinals[0]] = last + 1
        for ordinal in ordinals:
            found.setdefault(ordinal, []).append(match)
    return found


def find_keywords(text: Column, keywords: list[tuple[int, str]], case_sensitive: bool) -> Column:
    """For each numbered keyword found in a text, by number: its matches. One pass whatever the number of keywords."""
    names = dict(keywords)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = build(keywords, case_sensitive)
        match = pa.struct(
            [("position", pa.int32()), ("line", pa.int32()), ("column", pa.int32()), ("matched", pa.string())]
        )
        kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("keyword", pa.string()), ("matches", pa.list_(match))]))

        def groups(value: str) -> list[dict]:
            found = scan(automaton, value, case_sensitive)
            return [{"ordinal": i, "keyword": names[i], "matches": found[i]} for i in sorted(found)]

        for texts in batches:
            yield pa.array([groups(t.as_py()) if t.is_valid else None for t in texts], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, GROUP_TYPE)(text)
