import hashlib
import heapq
import random
import re
import zlib

import pytest

from palimpsa.llm import dialogue

EMPTY = hashlib.sha256(b"").hexdigest()


def left(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = lambda v: " " if v is None else v
        draw = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ends = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        kind = "blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows, kinds):
    """Dijkstra over (cost, audit): every edit of every row, with the roles that result as the state."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, end, lines = heapq.heappop(heap)
        if (i, end) in done:
            continue
        if i == len(rows) and end in ("", "a"):
            return cost, audit, lines
        # With equal cost the letters so far decide, and no letters of a node begin those of another: the first is best.
        done.add((i, end))
        for role, name in (("u", "user"), ("a", "assistant")):
            if (end, role) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", i, step[end, role], (*lines, f"{name}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, end, lines))
        if kinds[i] in ("blank", "duplicate"):
            continue
        worn = 3 if kinds[i] == "truncated" else 0
        if (end, role[:1]) in step:
            heapq.heappush(heap, (cost + worn, audit + "K", i + 1, step[end, role[:1]], (*lines, f"{role}:{text}")))
        for initial, name in (("u", "user"), ("a", "assistant")):
            if (end, initial) in step:
                heapq.heappush(heap, (cost + 3 + worn, audit + "R", i + 1, step[end, initial], (*lines, f"{name}:{text}")))
    raise AssertionError


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = left([r for r in rows if r[0] == conv])
        kinds = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, audit, lines = cheapest(own, kinds)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def repaired(spark, rows, partitions=3):
    schema = "conv_id long, turn long, role string, text string, _conv string, audit string, _at string, cost string"
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema).repartition(partitions)
    return {r[0]: tuple(r)[1:] for r in dialogue.repair_conversations(frame).collect()}


def talk(rng, conv, turns, texts):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [
        (conv, t, rng.choice(roles), rng.choice(texts)) for t in turns
    ]


def test_random_conversations(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "cut off", "  \t\n", "", None, "Why? ", "a ", "Ends. ", "x" * 50_000 + "."]
    rows = []
    for conv in range(250):
        rows += talk(rng, conv, [rng.choice([*range(12), None]) for _ in range(rng.randint(1, 9))], texts)
    rows += talk(rng, None, range(6), texts) + [(1000, 5, "user", "Same.")] * 4
    got = repaired(spark, rows)
    assert got == expected(rows)
    assert got == repaired(spark, rows, 1)


def test_conversation_that_loses_all_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(conv, 0, "user", "Hi.")]) == {conv: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    assert repaired(spark, []) == {}


@pytest.mark.parametrize("segment", [2, 7])
def test_segments_join_as_one(spark, monkeypatch, segment):
    monkeypatch.setattr(dialogue, "SEGMENT", segment)
    rng = random.Random(segment)
    rows = talk(rng, 1, range(120), ["Yes.", "No!", "cut off", " "] + [f"T {i}." for i in range(60)])
    rows += talk(rng, 2, range(5), ["A.", "B."])
    assert repaired(spark, rows) == expected(rows)


def test_search_equals_bounds():
    rng = random.Random(9)
    for _ in range(300):
        codes = [rng.choice("suax") + rng.choice("kkkbdt") for _ in range(rng.randint(0, 12))]
        after = dialogue._settled(dialogue._closing_costs())
        letters, cost, end = dialogue.cheapest_edits(codes, dialogue.START, after)
        assert cost + after[end] == dialogue.suffix_bounds(codes, after)[0][dialogue.START]
        assert len(letters.replace("I", "")) == len(codes)
