import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from palimpsa.llm import suffixes


def brute(rows, length):
    bodies = [(k, (t or "").encode()) for k, t in rows]
    counts = Counter(b[i : i + length] for _, b in bodies for i in range(len(b) - length + 1))
    out = []
    for k, b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def got(frame):
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted(((r.doc_id, *(r[n] for n in names), bytes(r.kept)) for r in frame.collect()), key=str)


def mixed(seed, count):
    """Texts that share passages of many lengths, at their ends or inside, with runs of one sign among them."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    passages = [noise(n) for n in (35, 39, 40, 41, 60, 200)]
    rows = []
    for i in range(count):
        parts = [noise(rng.randint(0, 90)) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.1:
            parts.append("z" * rng.randint(30, 120))
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize(("length", "gram"), [(40, 8), (41, 16), (47, 40)])
def test_same_bytes_as_brute_force(docs, length, gram):
    rows = mixed(length, 150) + [(500, None), (501, ""), (None, "q" * 90)]
    assert got(suffixes.remove_repeats(docs(rows, 5), length=length, gram=gram)) == brute(rows, length)


def test_repeated_rows_and_copies(docs, prose):
    text = prose(1, 200)
    rows = [(1, text), (1, text), (2, text[:500]), (3, prose(2, 100)), (4, text[100:299]), (5, "é" * 150)]
    assert got(suffixes.remove_repeats(docs(rows))) == brute(rows, suffixes.LENGTH)


def test_crowded_anchors_meet_by_fingerprints(docs, prose, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_CONTEXTS", 3)
    passage = prose(3, 60)
    rows = [(i, prose(100 + i % 9, 12) + passage + prose(200 + i, 12)) for i in range(40)]
    assert got(suffixes.remove_repeats(docs(rows, 4), length=64, gram=20)) == brute(rows, 64)


def test_long_text_in_chunks(docs, prose, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    a = prose(4, 1500)
    rows = [(1, a), (2, prose(5, 30) + a[2000:2300] + prose(6, 30)), (3, prose(7, 900))]
    assert got(suffixes.remove_repeats(docs(rows, 2))) == brute(rows, suffixes.LENGTH)


def test_empty_table(docs):
    assert suffixes.remove_repeats(docs([])).collect() == []


def test_sort_finds_equal_windows():
    rng = np.random.default_rng(1)
    run = np.tile(rng.integers(97, 100, 300, dtype=np.uint8), 2)
    run[400] ^= 1
    start = np.arange(len(run) - 50)
    ties = suffixes.tied_windows(run, start, np.zeros(len(start), np.int64), np.ones(len(start), np.int64), 50)
    seen = Counter(run[s : s + 50].tobytes() for s in start)
    assert ties.tolist() == [seen[run[s : s + 50].tobytes()] > 1 for s in start]
