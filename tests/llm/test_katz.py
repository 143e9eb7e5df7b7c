import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsa.llm import katz
from palimpsa.llm.common import pooled, remainder


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


class Plain:
    """The model as its definition says it, with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            line = ["<s>", *tokens(text)]
            for i in range(1, len(line)):
                for k in range(1, min(order, i + 1) + 1):
                    self.counts[k][tuple(line[i - k + 1 : i + 1])] += 1
        self.known = {w for (w,) in self.counts[1]}
        self.factor = [None] + [self.factors(Counter(self.counts[k].values())) for k in range(1, order + 1)]
        self.after = [{} for _ in range(order + 1)]
        for k in range(1, order + 1):
            for gram, c in self.counts[k].items():
                self.after[k].setdefault(gram[:-1], {})[gram[-1]] = c
        self.memo = {}

    @staticmethod
    def factors(n, top=5):
        out = {}
        share = (top + 1) * n[top + 1] / n[1] if n[1] else 1
        for r in range(1, top + 1):
            out[r] = 1
            if share < 1 and n[r] and n[r + 1]:
                f = ((r + 1) * n[r + 1] / n[r] / r - share) / (1 - share)
                out[r] = f if 0 < f < 1 else 1
        return out

    def share(self, history):
        """Probabilities of the seen words, and what is left for all others."""
        if history not in self.memo:
            k = len(history) + 1
            seen = self.after[k].get(history, {})
            total, f = sum(seen.values()), self.factor[k]
            left = sum(c * (1 - f.get(c, 1)) for c in seen.values())
            if left <= 0:
                total, left = total + 1, 1
            found = {w: c * f.get(c, 1) / total for w, c in seen.items()}
            rest = left / total
            if history and seen:
                rest /= 1 - sum(self.p(w, history[1:]) for w in seen)
            self.memo[history] = (found, rest)
        return self.memo[history]

    def p(self, word, history):
        found, rest = self.share(history)
        if word in found:
            return found[word]
        return rest * self.p(word, history[1:]) if history else rest

    def score(self, text):
        line = ["<s>", *tokens(text)]
        return sum(
            math.log10(self.p(line[i], tuple(line[max(0, i - self.order + 1) : i]) if self.order > 1 else ()))
            for i in range(1, len(line))
        )


@pytest.fixture(scope="module")
def rows(prose):
    texts = [prose(i // 3, 3 + i * 7 % 90) for i in range(150)]
    texts += ["The THE the é É", "", None, " \t\n", "word " * 3000, "a" * 20_000 + " b\x0bc\x1cd", "unseen-x of the"]
    out = list(enumerate(texts))
    return out + [(3, texts[3]), (None, "no key the of")]


@pytest.mark.parametrize(("order", "bucket"), [(1, 1 << 20), (2, 300), (2, 1 << 20), (3, 500)])
def test_scores_equal_the_definition(docs, rows, order, bucket):
    got = katz.score_texts(docs(rows, 5), remainder("doc_id", 7) == 2, order=order, bucket_tokens=bucket).collect()
    held = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 7 == 2
    plain = Plain([t for k, t in rows if not held(k)], order)
    seen = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    total, types = sum(seen.values()), len(seen)
    expected = sorted(
        (
            (-1 if k is None else k, held(k), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), total,
             sum(math.log10((seen[w] + 1) / (total + types + 1)) for w in tokens(t)), plain.score(t))
            for k, t in rows
        ),
        key=repr,
    )
    found = sorted(((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in got), key=repr)
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    for f, e in zip(found, expected, strict=True):
        assert f[5:] == pytest.approx(e[5:], rel=1e-9)


def test_definition_adds_up_to_one(rows):
    plain = Plain([t for _, t in rows], 3)
    histories = [(), ("<s>",), *list(plain.after[2])[:40], *list(plain.after[3])[:40]]
    for history in histories:
        assert sum(plain.p(w, history) for w in plain.known) + plain.p("never seen", history) == pytest.approx(1)


def test_empty_tables_and_nothing_to_learn(docs):
    assert katz.score_texts(docs([]), F.lit(False)).collect() == []
    (row,) = katz.score_texts(docs([(1, "a b")]), F.lit(True)).collect()
    assert row.n_tokens == 3 and row.n_known == 0 and row.train_tokens == 0 and row.base_score == row.score == 0


def test_words_of_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_BYTES", 10)
    text = b"some words of various lengths andoneverylongword\tx\n y"
    assert [w for part in katz._words_of(text) for w in part] == text.split()


def test_pack(rows):
    import numpy as np

    from palimpsa.llm.common import pack, unpack

    arrays = {"a": np.arange(300), "b": np.array([-1, 5]), "c": np.zeros(0, np.int64), "d": np.array([0.5, 1e9]), "e": b"xy"}
    back = unpack(pack(arrays))
    assert back["e"] == b"xy" and all(np.array_equal(back[k], arrays[k]) for k in "abcd")


def test_small_batches_make_no_small_chunks():
    """Rows come some megabytes at a time; a chunk holds as much text as before, and rows keep their order."""
    texts = [f"{i} " * 100 for i in range(400)] + [None, "x" * 50_000, ""]
    batches = [pa.RecordBatch.from_pydict({"_text": pa.array(texts[i : i + 7], pa.string())}) for i in range(0, len(texts), 7)]
    parts = list(pooled(iter(batches), "_text", 20_000))
    assert [t for p in parts for t in p.column("_text").to_pylist()] == texts
    sizes = [sum(len(t or "") for t in p.column("_text").to_pylist()) for p in parts]
    assert all(a + b > 20_000 for a, b in zip(sizes, sizes[1:])) and sum(s > 20_000 for s in sizes) == 1


def test_class_sums():
    counts, lower = np.array([1, 7, 0, 2, 2]), np.array([3, 9, 4, 0, 6])
    got = katz._class_sums(np.array([0, 3]), counts, lower)
    assert got.tolist() == [[1, 0, 0, 0, 0, 7, 0, 0, 3, 0, 0, 9], [0, 4, 0, 0, 0, 0, 0, 0, 0, 0, 0, 6]]
