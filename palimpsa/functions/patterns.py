"""Character classes and the translation of Python-style patterns for the JVM."""

from __future__ import annotations

import re

# Whitespace as Unicode text tools usually see it (str.isspace).
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The same characters as a plain string, for trimming.
WS_CHARS = "".join(
    map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])
) + "\u2028\u2029\u202f\u205f\u3000"
NOT_WS = WS.replace("[", "[^", 1)
WORD_CHAR = r"[\p{L}\p{N}_]"
NOT_WORD_CHAR = r"[^\p{L}\p{N}_]"
# Letters, plus the letter-like numerals that are not decimal digits.
LETTER = r"[a-zA-Z\p{L}\p{Nl}\p{No}]"
WORD = rf"{LETTER}+(?:'{LETTER}+)?"
SENTENCE_BREAK = rf"(?<=[.!?]){WS}+"

_BOUNDARY = rf"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"
_NO_BOUNDARY = rf"(?:(?<={WORD_CHAR})(?={WORD_CHAR})|(?<!{WORD_CHAR})(?!{WORD_CHAR}))"
_ESCAPES = {
    "w": WORD_CHAR, "W": NOT_WORD_CHAR, "s": WS, "S": NOT_WS,
    "d": r"\p{Nd}", "D": r"\P{Nd}", "b": _BOUNDARY, "B": _NO_BOUNDARY, "Z": r"\z",
}
_PIECE = re.compile(
    r"\(\?P<(?P<group>\w+)>|\(\?P=(?P<back>\w+)\)|(?P<comment>\(\?\#[^)]*\))|(?P<upto>\{,(?P<most>\d+)\})"
    r"|\\(?P<esc>.)|(?P<other>.)",
    re.DOTALL,
)


def _group_name(name: str) -> str:
    return name.replace("_", "U")


def to_java(pattern: str) -> str:
    """The same pattern in java.util.regex spelling.

    Shorthand classes are written out because the JVM's are ASCII-only by
    default and, with its Unicode flag, also take marks and joiners.
    """
    out, in_class = [], False
    for piece in _PIECE.finditer(pattern):
        esc, other = piece["esc"], piece["other"]
        if piece["group"]:
            out.append(f"(?<{_group_name(piece['group'])}>")
        elif piece["comment"] and not in_class:
            continue
        elif piece["upto"] and not in_class:
            out.append(f"{{0,{piece['most']}}}")
        elif piece["comment"] or piece["upto"]:
            out.append(re.sub(r"[\[&]", r"\\\g<0>", piece[0]))
        elif piece["back"]:
            out.append(rf"\k<{_group_name(piece['back'])}>")
        elif esc is not None:
            if in_class and esc == "b":
                out.append(r"\x08")
            else:
                out.append(_ESCAPES.get(esc, "\\" + esc))
        elif in_class:
            out.append("\\" + other if other in "[&" else other)
            in_class = other != "]"
        else:
            in_class = other == "["
            out.append(other)
    return "".join(out)


_ALTERNATIVES = re.compile(r"\((?:\?:)?((?:\w\|)+\w)\)(?=[*+]|\{\d*,)")


def flat_alternatives(pattern: str) -> str:
    """A repeated choice of single characters as a class: the matcher then needs no stack for each repeat.

    Only groups that no back reference can name are changed.
    """
    if re.search(r"\\[1-9]|\(\?P=|\(\?\(", pattern):
        return pattern
    return _ALTERNATIVES.sub(lambda m: "[" + m[1].replace("|", "") + "]", pattern)


def is_deep(pattern: str) -> bool:
    """Whether a repeated group is left that the JVM's matcher enters once per repeat, so long texts end its stack."""
    return re.search(r"(?<!\\)\)(?:[*+]|\{\d*,\d*\})(?!\+)", flat_alternatives(pattern)) is not None


def anywhere(pattern: str) -> str:
    """A user pattern that may match empty but never between the halves of a surrogate pair."""
    return rf"(?![\x{{DC00}}-\x{{DFFF}}])(?:{to_java(flat_alternatives(pattern))})"


def quote(literal: str) -> str:
    """A literal as a pattern, safe for text that holds the quote terminator."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def _letter(char: str) -> str:
    """One character as a pattern, short and in ASCII: the engine reads a pattern's text again for each row."""
    if char.isascii():
        return char if char.isalnum() or char == " " else quote(char)
    return rf"\x{{{ord(char):X}}}"


def _prefix_tree(phrases: list[str]) -> str:
    """Alternation with shared beginnings, longest first, so few branches are tried per position."""
    rest: dict[str, list[str]] = {}
    for phrase in phrases:
        if phrase:
            rest.setdefault(phrase[0], []).append(phrase[1:])
    if not rest:
        return ""
    branches = "|".join(_letter(first) + _prefix_tree(tails) for first, tails in sorted(rest.items()))
    ends_here = "?" if "" in phrases else ""
    return branches if len(rest) == 1 and not ends_here else f"(?:{branches}){ends_here}"


def whole_phrases(phrases: list[str]) -> str:
    """Longest of the literals between word boundaries, any case."""
    tree = _prefix_tree(sorted(set(phrases)))
    return rf"(?iu)(?<!{WORD_CHAR})(?:{tree})(?!{WORD_CHAR})"


def flags(case_sensitive: bool) -> str:
    """Dot stops at newline only; case folding is Unicode-aware when on."""
    return "(?d)" if case_sensitive else "(?diu)"
