"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import whole

CONTEXT_CHARS = 40

# The base kinds in their order, then the kinds that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits: an earlier start in the run would match as well.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NEARBY = {
    "email": re.compile(r"mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login", re.I),
    "card": re.compile(r"card|visa|master|credit|payment", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
}
# Score of a confirmed span without and with a nearby word; a span of an added kind needs ADDED_SCORE.
SCORES = {
    "email": (0.9, 1.0), "ip": (0.6, 0.8), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.9, 1.0), "ssn": (0.3, 0.8),
}
ADDED_SCORE = 0.5


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """The check digits of account numbers (letters count from 10)."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in linear time: each at-sign is looked at once, its local part backwards."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _matches(pattern: re.Pattern[str], holds: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: ((m.start(), m.end()) for m in pattern.finditer(text) if holds(m.group()))


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": email_spans,
    "ip": _matches(IP, lambda v: all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in v.split("."))),
    "card": _matches(CARD, lambda v: 14 <= len(_digits(v)) <= 19 and luhn(_digits(v))),
    "phone": _matches(PHONE, lambda v: 10 <= len(_digits(v)) <= 15),
    "iban": _matches(IBAN, lambda v: 15 <= len(v.replace(" ", "")) <= 34 and mod_97(v.replace(" ", ""))),
    "ssn": _matches(SSN, lambda v: v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"),
}


def find_spans(text: str) -> list[Span]:
    """All spans of a whole text by start, then kind. Offsets are code points, ends exclusive."""
    found = []
    for kind in BASE_KINDS + ADDED_KINDS:
        plain, near = SCORES[kind]
        for start, end in FINDERS[kind](text):
            around = text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]
            score = near if any(NEARBY[kind].search(a) for a in around) else plain
            if kind in BASE_KINDS or score >= ADDED_SCORE:
                found.append(Span(kind, start, end, score))
    rank = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}
    return sorted(found, key=lambda s: (s.start, rank[s.kind], s.end))


def add_personal_data(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """All columns of ``docs`` plus ``into``: an array of (kind, start, end, score) by start, then kind.

    Base kinds (email, ip, card, phone) stay whatever their score; added kinds need a score of at least 0.5.
    A missing or empty text has an empty array. Whole texts are searched, in time linear in their length.
    A narrow step: no shuffle, one text in memory at a time besides its batch. An existing column ``into`` is replaced.
    """

    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for column in batches:
            rows = [[vars(s) for s in find_spans(value.as_py() or "")] for value in column]
            yield pa.array(rows, pa.list_(kind))

    shape = "array<struct<kind:string,start:int,end:int,score:double>>"
    return docs.withColumn(into, F.arrow_udf(_typed(spans), shape)(whole(text)))


def mask(docs: DataFrame, text: str = "text", into: str = "masked") -> DataFrame:
    """All columns of ``docs`` plus ``into``: the text with each run of spans replaced by its first kind in brackets."""

    def masked(value: str) -> str:
        out, at = [], 0
        for span in find_spans(value):
            if span.start >= at:
                out += [value[at : span.start], f"[{span.kind}]"]
            at = max(at, span.end)
        return "".join(out) + value[at:]

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([None if v.as_py() is None else masked(v.as_py()) for v in column], pa.string())

    return docs.withColumn(into, F.arrow_udf(_typed(texts), "string")(F.col(text)))


def _typed(f: Callable) -> Callable:
    f.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return f
