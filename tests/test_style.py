import random
import re
import statistics

from pyspark.sql import functions as F

from palimpsa.operators import style


def score(texts, text, **kw):
    return style.add_score(texts([text]), **kw).first()


def test_empty_text(texts):
    row = score(texts, "")
    assert row.score == 0.0 and row.signals == ["none"]


def test_connectors(texts):
    text = "En resumen, esto funciona bien. Es importante destacar que sirve. Cabe mencionar que ayuda mucho."
    row = score(texts, text)
    assert row.phrases == ["en resumen", "es importante destacar", "cabe mencionar"]
    # 25 + 30 + 20 points of 75: fewer than 20 words, so diversity does not count
    assert (row.phrase_points, row.max_points, row.score) == (30, 75, 100.0)


def test_connectors_with_enough_words(texts):
    text = (
        "En resumen, esta idea nueva funciona bastante bien hoy. Es importante destacar que sirve para muchas cosas. "
        "Cabe mencionar que ayuda mucho a cada grupo."
    )
    assert score(texts, text).score == 75.0


def test_uniform_sentences(texts):
    assert score(texts, "Uno dos tres cuatro cinco seis. " * 4).max_points in (75, 100)
    text = " ".join(f"Palabra{c} b{c}x c{c}y d{c}z e{c}w f{c}v." for c in "abcd")
    assert score(texts, text).score == 45.0


def test_low_diversity(texts):
    row = score(texts, " ".join(["dato dato dato analisis analisis resultado resultado"] * 4))
    assert row.signals == ["diversity_strong"] and row.score == 45.5


def test_custom_and_empty_phrase_lists(texts):
    assert score(texts, "Con mi-frase-rara dentro", phrases=["mi-frase-rara"]).phrases == ["mi-frase-rara"]
    assert score(texts, "En resumen, nada", phrases=[]).phrase_points == 0


def plain_score(text):
    """The scoring rules on one text with floating-point statistics."""
    word = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
    sents = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]
    words = [w.lower() for w in word.findall(text)]
    got = most = 0
    if len(sents) >= 3:
        most += 45
        lens = [len(word.findall(s)) for s in sents]
        cv = statistics.pstdev(lens) / statistics.mean(lens) if sum(lens) else 0
        got += 25 if cv < 0.35 else 12 if cv < 0.55 else 0
        share = sum(s[-1] == "." for s in sents) / len(sents)
        even = statistics.pstdev([s.count(",") for s in sents]) < 1
        got += 20 if share > 0.9 and even else 10 if share > 0.75 else 0
    if len(words) >= 20:
        most += 25
        ttr = len(set(words)) / len(words)
        got += 25 if ttr < 0.4 else 12 if ttr < 0.55 else 0
    got += min(30, 10 * sum(p in text.lower() for p in style.CONNECTOR_PHRASES))
    return round(got / (most + 30) * 100, 1)


def test_random_texts_against_plain_rules(texts):
    rnd = random.Random(7)
    vocab = ["uno", "dos", "árbol", "d'or", "x²", "12", "es crucial", "no obstante", "a,b", "Ñandú", "él", "​z"]
    values = []
    for _ in range(300):
        parts = []
        for _ in range(rnd.randint(0, 9)):
            parts.append(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 9))) + rnd.choice([".", ".", ".", "!", "?", ",", ".\n"]))
        values.append(" ".join(parts))
    rows = style.add_score(texts(values)).orderBy("doc_id").collect()
    for text, row in zip(values, rows):
        assert row.score == plain_score(text), text
        assert 0 <= row.score <= 100


def test_compare_and_transitions(spark):
    frame = spark.createDataFrame(
        [(0, "En resumen, es crucial. Por lo tanto, es fundamental. No obstante, dicho esto.", "Hola."), (1, "Hola.", "Hola.")],
        "doc_id long, a string, b string",
    )
    compared = style.compare(frame, "a", "b").orderBy("doc_id")
    rows = compared.collect()
    assert rows[0].direction == "down" and rows[1].direction == "flat"
    assert {r.band_before: r.low for r in style.band_transitions(compared).collect()}["low"] == 1


def test_no_shuffle_and_single_scan_of_words(texts):
    plan = style.add_score(texts(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_bands(spark):
    rows = spark.createDataFrame([(64.9,), (65.0,), (35.0,), (34.9,)], "s double").select(style.band(F.col("s")).alias("b"))
    assert [r.b for r in rows.collect()] == ["medium", "high", "medium", "low"]
