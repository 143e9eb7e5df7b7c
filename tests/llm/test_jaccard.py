import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from palimpsa.llm import jaccard
from palimpsa.llm.components import components
from palimpsa.llm.shingles import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, under, over):
    sets = [sets_of(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and over * common >= under * (len(sets[i]) + len(sets[j]) - common):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    classes = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            classes[find(i)] = min(k, classes.get(find(i), k))
    return sorted(((k, len(s), classes.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


def variants(prose, seed, count):
    """Families of texts with a few words changed, moved or dropped, so that links form chains."""
    rng = random.Random(seed)
    rows = []
    for family in range(count):
        words = prose(seed * 100 + family, rng.choice([3, 9, 10, 19, 40, 150, 700])).split()
        for _ in range(rng.randint(1, 7)):
            rows.append(" ".join(words))
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(["Neu", "alt", "x"])
            if rng.random() < 0.3 and len(words) > 2:
                words.pop(rng.randrange(len(words)))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_match_brute_force(docs, prose):
    for seed, width, rule in ((1, 3, (90, 100)), (2, 5, (80, 100)), (3, 1, (50, 100))):
        rows = variants(prose, seed, 40)
        frame = docs(rows, 6)
        assert got(jaccard.similarity_classes(frame, words=width, similarity=rule)) == brute(rows, width, *rule)


def test_missing_empty_repeated_and_short_texts(docs, prose):
    long = prose(5, 9000)
    rows = [(9, None), (8, ""), (7, " \t\n"), (6, "A b"), (5, "a  B"), (4, "a b c"), (4, "a b c"), (None, "a b c"),
            (None, "z z z z"), (3, long), (2, long + " tail"), (1, "a b c"), (0, "ÄB c d"), (10, "äB c d")]
    assert got(jaccard.similarity_classes(docs(rows), words=3, similarity=(90, 100))) == brute(rows, 3, 90, 100)


def test_empty_table(docs):
    assert jaccard.similarity_classes(docs([])).collect() == []
    assert jaccard.drop_near(docs([])).collect() == []


def test_a_shingle_that_all_texts_share(docs, prose):
    """Blocks of a crowded tile meet all others: thousands of texts around one line, few of them alike."""
    line = "the very same line here"
    rows = [(i, f"{line} {prose(i // 2, 3)}" + (" x" if i % 2 else " y")) for i in range(jaccard.BLOCK + 900)]
    frame = jaccard.similarity_classes(docs(rows, 4), words=3, similarity=(60, 100))
    assert len({r.component_id for r in frame.collect()}) < len(rows)
    small = rows[:400]
    assert got(jaccard.similarity_classes(docs(small, 4), words=3, similarity=(60, 100))) == brute(small, 3, 60, 100)


def test_drop_near_keeps_one_of_each(docs, prose):
    base = prose(8, 120)
    rows = [(3, base), (1, base + " a"), (2, base + " a b"), (5, prose(9, 50)), (6, None), (7, None)]
    frame = docs(rows)
    out = jaccard.drop_near(frame)
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 5, 6, 7]


def test_signature_never_rules_out_a_link():
    rng = np.random.default_rng(3)
    rule = jaccard.Threshold(90, 100)
    for n in (1, 5, 60, 600, 1100, 20_000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[int(0.04 * n) :], rng.integers(0, 2**63, int(0.04 * n), dtype=np.uint64)]))
            if rule.holds(len(np.intersect1d(a, b)), len(a) + len(b)):
                assert jaccard.may_link(jaccard.signature(a), jaccard.signature(b), len(a) + len(b), rule)


def entries_of(texts, words, rule):
    """What a task sends for each text, as pairs of key and index of the text."""

    class Counters:
        value = np.zeros(1 << jaccard.BUCKET_BITS, np.int32)

    names = [jaccard.set_id(jaccard.set_key(v)) for v in shingle_sets(pa.array(texts), words)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["_text"])
    sent = pa.Table.from_batches(jaccard._entries(words, rule, Counters)(iter([batch])))
    return [(t, names.index(i)) for t, i in zip(*(c.to_pylist() for c in sent.select(["_token", "_id"]).columns))]


def test_linked_sets_send_a_common_key():
    """Whatever the rule and however little room the differences leave; keys are few for each member of a set."""
    rng = random.Random(11)
    for under, over in ((90, 100), (80, 100), (95, 100), (60, 100), (3, 10)):
        rule = jaccard.Threshold(under, over)
        for n in (1, 2, 4, 5, 9, 10, 12, 19, 21, 40, 77, 150, 400, 1500):
            for _ in range(12):
                words = [f"w{rng.random()}" for _ in range(n)]
                other = list(words)
                # As many words as may be go from the one and come to the other.
                for _ in range(2 * n):
                    if rng.random() < 0.5 and len(other) > 1:
                        changed = other[:-1] if rng.random() < 0.5 else other[1:]
                    else:
                        changed = [*other, f"x{rng.random()}"]
                    common = len(set(words) & set(changed))
                    if over * common < under * (n + len(changed) - common):
                        break
                    other = changed
                if set(other) == set(words):
                    continue
                sent = entries_of([" ".join(words), " ".join(other)], 1, rule)
                assert {t for t, i in sent if i == 0} & {t for t, i in sent if i == 1}, (under, n)
                assert len(sent) <= 2 * (n + len(other)) + 8


def test_texts_that_share_some_sentences_do_not_meet():
    """Texts put together from a stock of sentences share many shingles with many others, but no whole part."""
    rng = random.Random(12)
    stock = [" ".join(f"s{i}w{j}" for j in range(20)) for i in range(300)]
    texts = [" ".join(rng.sample(stock, 12)) for _ in range(300)]
    for words, rule, share in ((3, jaccard.Threshold(90, 100), 0.01), (5, jaccard.Threshold(80, 100), 0.1)):
        sets = [set(v.tolist()) for v in shingle_sets(pa.array(texts), words)]
        assert not any(rule.holds(len(x & y), len(x) + len(y)) for x, y in combinations(sets, 2))
        sent = sorted(entries_of(texts, words, rule))
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sent)], ["_token", "_id"])
        assert sum(b.num_rows for b in jaccard._neighbours(iter([batch]))) < len(sent) * share


def test_shingles_agree_across_slices():
    texts = ["A b c d", None, "", "b  c\nd a b c d", "x"]
    whole = shingle_sets(pa.array(texts), 3)
    for t, s in zip(texts, whole, strict=True):
        assert np.array_equal(shingle_sets(pa.array([t], pa.string()), 3)[0], s)
    assert [len(s) for s in whole] == [len(sets_of(t, 3)) for t in texts]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200), (200, 250)]
    frame = components(spark.createDataFrame(links, "a long, b long"))
    roots = {r.node: r.root for r in frame.collect()}
    assert all(roots[i] == 0 for i in range(61)) and all(roots[i] == 100 for i in range(100, 140))
    assert {roots[n] for n in (200, 250, 300)} == {200} and len(roots) == 104


def test_one_row_of_each_component_stays(docs, prose):
    a, b, c, d = (prose(900 + i, 60) for i in range(4))
    near = a + " end"
    rows = [
        (1, a), (2, near), (2, b), (None, a), (None, near), (1, near), (1, c), (None, d), (None, d), (5, d + " end"),
        (None, ""), (None, None), (7, ""),
    ]
    out = [(r.doc_id, r.text) for r in jaccard.drop_near(docs(rows)).collect()]
    assert sum(t in (a, near) for _, t in out) == 1 and (2, b) in out and (1, c) in out
    assert [k for k, t in out if t in (a, near)] == [1] and [k for k, t in out if t in (d, d + " end")] == [5]
    assert sum(not t for _, t in out) == 3 and len(out) == 7
