import pathlib
import random

import numpy as np
import pytest

from palimpsa.llm import pieces
from palimpsa.llm.queries import MODEL_FILE

if not pathlib.Path(MODEL_FILE).exists():
    pytest.skip("no vocabulary file here", allow_module_level=True)

ODD = ["", " ", "  a", "▁x▁ y", "\n\t", "é😀 日本語  z", "a" * 3000, "x ", "The quick   fox!!!", "    def f(x):\n        return x",
       "▁", "a\u0000b", "http://www.example.com/a?b=c" * 3]


@pytest.fixture(scope="module")
def model():
    return pieces.load_model(MODEL_FILE)


def noise():
    rng = random.Random(4)
    return ["".join(rng.choices("abcdehinorst  ,.éüTHE\n", k=rng.randint(1, 200))) for _ in range(300)]


def test_ids_are_those_of_the_public_library(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    texts = noise() + [t for t in ODD if "▁" not in t] + [" " * n + "the" for n in range(1, 40)]
    for text, ids in zip(texts, pieces.encode_texts(texts, model), strict=True):
        assert ids.tolist() == library.encode(text), text


def unbroken():
    rng = random.Random(6)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return ["".join(rng.choices(signs, k=20_000)), "".join(rng.choices("theandofin", k=9_000)), "a" * 7_001,
            "=" * 5_000 + "ab" * 3_000, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(5_000)),
            "x" * 2_049, "to be " * 500 + "".join(rng.choices(signs, k=4_000)) + " end"]


@pytest.mark.parametrize(("segment", "lead"), [(512, 64), (128, 1), (40, 1)])
def test_unbroken_texts_are_cut_into_segments(model, monkeypatch, segment, lead):
    """Ids are the library's, whether segments agree with the ones before them or go on from them."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    monkeypatch.setattr(pieces, "SEGMENT", segment)
    monkeypatch.setattr(pieces, "LEAD", lead)
    repaired = []
    go_on = pieces._go_on
    monkeypatch.setattr(pieces, "_go_on", lambda *a: repaired.append(a[1]) or go_on(*a))
    texts = unbroken()
    for text, ids in zip(texts, pieces.encode_texts(texts, model), strict=True):
        assert ids.tolist() == library.encode(text)
    assert segment == 512 or len(repaired) > 20


def test_unbroken_megabyte(model):
    """Linear, with tables of bounded size: a quadratic or one-sign-at-a-time way takes minutes here."""
    import time

    rng = random.Random(7)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1_000_000))
    start = time.process_time()
    ids = pieces.encode_texts([text], model)
    assert time.process_time() - start < 60
    assert pieces.decode_ids(ids, model) == [text]


def test_exact_round_trip(model):
    texts = noise() + ODD
    assert pieces.decode_ids(pieces.encode_texts(texts, model), model) == texts


def test_unigram_paths_match_brute_force():
    """A small unigram model: the greatest sum of scores over all ways to cut a word."""
    plain = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -4.0, "ba": -3.5, "▁a": -4.5, "aba": -5.0, "▁ab": -7.5, "bb": -4.9}
    keys = np.array([pieces._piece_hash(p) for p in plain], np.uint64)
    order = np.argsort(keys)
    ids = np.arange(len(plain))[order]
    scores = np.array(list(plain.values()))[order]
    texts = tuple(p.replace("▁", " ").encode() for p in plain) + tuple(bytes([i]) for i in range(256))
    own = pieces.PieceModel(keys[order], ids, scores, 3, -17.5, np.arange(256) + len(plain), texts)
    names = list(plain)

    def best(word):
        paths = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for size in range(1, min(3, end) + 1):
                score = plain.get(word[end - size : end], -17.5 if size == 1 else -np.inf)
                paths[end] = max(paths[end], paths[end - size] + score)
        return paths[-1]

    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choices("abc", weights=[4, 4, 1], k=rng.randint(1, 12)))
        (got,) = pieces.encode_texts([word], own)
        assert sum(plain[names[i]] if i < len(plain) else -17.5 for i in got) == pytest.approx(best("▁" + word))
        assert pieces.decode_ids([got], own) == [word]


def test_columns(docs, model):
    rows = [(1, None), (2, ""), (3, "some text"), (3, "some text"), (None, "x"), (4, "word " * 30_000)]
    out = pieces.decode(pieces.encode(docs(rows), model), model).collect()
    assert len(out) == 6 and all(r.decoded == r.text for r in out)
    assert [r.pieces for r in out if r.doc_id == 1] == [None] and [r.pieces for r in out if r.doc_id == 2] == [[]]
    assert pieces.encode(docs([]), model).count() == 0


def test_unknown_numbers_decode_to_nothing(model):
    assert pieces.decode_ids([np.array([-5, 0, 10**6, 1])], model) == [""]
