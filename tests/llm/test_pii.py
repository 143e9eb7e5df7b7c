import random
import re

from palimpsa.llm import pii

# The base patterns as they are given.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and total % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out)


def found(text):
    return sorted((s.kind, s.start, s.end) for s in pii.find_spans(text) if s.kind in pii.BASE_KINDS)


def test_same_base_spans_as_the_patterns():
    rng = random.Random(7)
    pieces = ["a@b.co", "x.y@", "@", "@c.d", "1.2.3.4", "256.1.1.1", "0001.2.3.255", ".5", "4111 1111 1111 1111", "-", " ",
              "+1 (743) 555-3824", "+", "9", "00", "é", "😀", "me+you@mail-1.example.com", "..", "(", ")", "\n", "a_b"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert found(text) == plain(text), text


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod_97("GB82WEST12345698765432") and not pii.mod_97("GB82WEST12345698765433")


def test_added_kinds_need_score():
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32.") == ["iban"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 33.") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"]
    assert kinds("part 123-45-6789 of it") == []


def test_context_moves_the_score():
    near, far = pii.find_spans("call +1 (743) 555-3824")[0], pii.find_spans("zzzz +1 (743) 555-3824")[0]
    assert near.score > far.score


def test_columns_nulls_and_mask(docs):
    rows = [(1, None), (2, ""), (3, "mail a@b.co now"), (3, "mail a@b.co now"), (None, "x")]
    out = pii.mask(pii.add_personal_data(docs(rows)))
    got = sorted(((r.doc_id or 0, r.text, len(r.pii), r.masked) for r in out.collect()), key=str)
    assert got == sorted(
        [(1, None, 0, None), (2, "", 0, ""), (3, rows[2][1], 1, "mail [email] now"), (3, rows[2][1], 1, "mail [email] now"),
         (0, "x", 0, "x")], key=str,
    )
    assert pii.add_personal_data(docs([])).count() == 0


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a.b-" * 80_000 + "@", "1." * 150_000, "+1" * 100_000, "@" * 200_000):
        found(text)
