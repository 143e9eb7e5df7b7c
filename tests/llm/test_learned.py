"""Language and toxicity: held-out accuracy, defined results for odd rows, and the counterfactual penalty."""

import random

import pytest

from palimpsa.llm import langid, toxicity

SOUNDS = {"aa": ["ka", "to", "ri"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "é", "oi"]}


def sentence(rng, lang, words):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = rng.choice(list(SOUNDS))
        rows.append((i, sentence(rng, lang, rng.randint(1, 40)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_held_out_languages(spoken):
    model = langid.fit_languages(spoken.filter("doc_id % 3 <> 1"))
    got = langid.add_language(spoken.filter("doc_id % 3 = 1"), model).collect()
    assert sum(r.language.name == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.language.score <= 1 for r in got)


def test_language_of_odd_rows(spark, spoken, docs):
    model = langid.fit_languages(spoken)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "schung einsch"), (4, "schung einsch"), (None, "x"), (5, "kato " * 50_000)]
    got = {(r.doc_id, r.text): r.language for r in langid.add_language(docs(rows), model).collect()}
    assert all(got[k].name == "und" and got[k].score == 0 for k in got if k[0] in (1, 2, 3))
    assert got[4, "schung einsch"].name == "bb" and got[5, rows[-1][1]].name == "aa"
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit_languages(nothing) is None
    assert langid.add_language(docs([(1, "kato")]), None).first().language.name == "und"
    assert langid.add_language(docs([]), model).count() == 0


def test_one_language_only(spoken):
    model = langid.fit_languages(spoken.filter("lang = 'aa'"))
    assert {r.language.name for r in langid.add_language(spoken.limit(5), model).collect()} == {"aa"}


@pytest.fixture(scope="module")
def spoiled(spark):
    """Toxic rows hold an insult; a group is named in most toxic rows and in few others."""
    rng = random.Random(2)
    rows = []
    for i in range(900):
        toxic = i % 4 == 0
        words = sentence(rng, "aa", rng.randint(3, 60)).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "dimwit", "blockhead"]))
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(rng.randrange(len(words)), "muslims")
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)


def test_held_out_toxicity(spoiled):
    model = toxicity.fit_toxicity(spoiled.filter("doc_id % 5 <> 1"))
    got = toxicity.add_toxicity(spoiled.filter("doc_id % 5 = 1"), model).collect()
    right = sum((r.toxicity >= toxicity.THRESHOLD) == (r.toxic == 1) for r in got)
    assert right >= 0.97 * len(got)


def test_swapping_identities_hardly_moves_the_score(spoiled, docs, monkeypatch):
    rows = docs([(1, "kato rito muslims tori"), (2, "kato rito christians tori")])

    def gap(fairness):
        monkeypatch.setattr(toxicity, "FAIRNESS", fairness)
        model = toxicity.fit_toxicity(spoiled)
        got = {r.doc_id: r.toxicity for r in toxicity.add_toxicity(rows, model).collect()}
        return abs(got[1] - got[2]), got[1]

    (fair, score), (unfair, _) = gap(10.0), gap(0.0)
    assert fair < 0.5 * unfair and score < toxicity.THRESHOLD


def test_labels_in_a_table_of_their_own(spoiled):
    told = spoiled.filter("doc_id % 5 <> 1").select("doc_id", "toxic")
    model = toxicity.fit_from_labels(spoiled.drop("toxic"), told)
    got = toxicity.add_toxicity(spoiled.filter("doc_id % 5 = 1"), model).collect()
    assert sum((r.toxicity >= toxicity.THRESHOLD) == (r.toxic == 1) for r in got) >= 0.97 * len(got)


def test_swaps():
    assert toxicity.swapped("Women and men, no womenfolk") == "men and women, no womenfolk"
    assert toxicity.swapped("nobody here") is None


def test_pairs_of_sentences():
    text = "Nobody is here. Women sing! The end\nWomen sing!"
    pairs = toxicity.counterfactuals(text)
    assert pairs[0] == ("Women sing", "men sing") and len(pairs) == 3
    assert pairs == toxicity.counterfactuals(text) and len(toxicity.counterfactuals(text, 2)) == 2
    for own, other in pairs[1:]:
        differ = [(a, b) for a, b in zip(own.split(), other.split(), strict=True) if a != b]
        assert len(differ) == 1 and toxicity.NEXT_TERM[differ[0][0]] == differ[0][1]
    for text in ("", " .\n", "?"):
        ((own, other),) = toxicity.counterfactuals(text)
        assert toxicity.NEXT_TERM[own] == other


def test_texts_without_terms_make_pairs(spark, spoiled):
    """Rows that name no group are fitted with pairs all the same, and their swapped sentences score alike."""
    plain = spoiled.filter("text not like '%muslims%'")
    model = toxicity.fit_toxicity(plain)
    assert model.pairs >= plain.count()
    sides = [(2 * i + j, side) for i, r in enumerate(plain.limit(50).collect())
             for j, side in enumerate(toxicity.counterfactuals(r.text)[0])]
    frame = spark.createDataFrame(sides, "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.add_toxicity(frame, model).collect()}
    gaps = [abs(got[i] - got[i + 1]) for i in range(0, len(sides), 2)]
    assert sum(gaps) / len(gaps) < 0.01


def test_toxicity_of_odd_rows(spark, spoiled, docs):
    model = toxicity.fit_toxicity(spoiled)
    rows = [(1, None), (2, ""), (3, "!"), (None, "a dimwit"), (4, "kato " * 50_000 + "dimwit")]
    got = {r.doc_id: r.toxicity for r in toxicity.add_toxicity(docs(rows), model).collect()}
    assert got[1] == got[2] == got[3] < toxicity.THRESHOLD <= got[None] and got[4] >= toxicity.THRESHOLD
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.fit_from_labels(docs(rows), labels) is not None
    assert toxicity.fit_from_labels(docs(rows), labels.filter("doc_id = 3")) is None
    assert toxicity.fit_from_labels(docs([]), labels) is None
    assert toxicity.fit_toxicity(spoiled.filter("toxic = 0")) is None
    assert toxicity.add_toxicity(docs([(1, "dimwit")]), None).first().toxicity == 0
    assert toxicity.add_toxicity(docs([]), model).count() == 0
