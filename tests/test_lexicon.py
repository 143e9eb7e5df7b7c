import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsa.functions import patterns
from palimpsa.functions.phrases import INTENSITIES, STOCK_PHRASES, SYNONYMS
from palimpsa.operators import lexicon
from palimpsa.suite import wording

SAMPLE = (
    "Es importante destacar que el equipo puede mejorar el resultado. En resumen, el problema es grande. "
    "Los datos son claros. Todo va bien. Nada cambia ya. Cabe destacar que es crucial.\n\n"
    "El informe fue aprobado por la junta directiva, pero el director general pidió además una revisión completa "
    "de todos los anexos, y el comité aceptó la propuesta sin cambios ni demoras en el calendario previsto para este "
    "año que viene.\n\n- uno muy bueno\n- dos por lo tanto\n- tres\n\nFin del texto. Muy breve."
)


def up(s):
    return s[:1].upper() + s[1:]


def random_prose(n):
    rnd = random.Random(11)
    vocab = (
        list(SYNONYMS)[:20] + list(STOCK_PHRASES)[:25]
        + ["casa", "perro", "árbol", "Sol", "que", "pero", "y", "mientras que", "  ", "12", "según", "Muy", "En resumen"]
    )
    texts = [SAMPLE, "", "  \n ", "Hola."]
    for _ in range(n):
        out = []
        for _ in range(rnd.randint(1, 4)):
            line = ""
            for _ in range(rnd.randint(1, 7)):
                words = [rnd.choice(vocab) for _ in range(rnd.randint(1, rnd.choice([5, 5, 40])))]
                line += up(" ".join(w + rnd.choice([""] * 6 + [","]) for w in words)) + rnd.choice([". ", ". ", "! ", "?\n"])
            out.append(rnd.choice(["", "", "- a\n- "]) + line)
        texts.append(rnd.choice(["\n\n", "\n \n\n", "\n\n\n \n\n"]).join(out))
    return texts


LISTED = sorted({w for table in (STOCK_PHRASES, SYNONYMS) for k, v in table.items() for o in [k, *v] for w in (o or "").lower().split()})


def free_words(text):
    """Words that no dictionary entry holds and no joint adds, in order."""
    return [w for w in re.findall(r"[^\W_]+", text.lower()) if w not in LISTED and w != "y"]


@pytest.mark.parametrize("intensity", ["low", "medium", "high"])
def test_rewrite_invariants(texts, intensity):
    values = random_prose(60)
    rows = lexicon.rewrite(texts(values), intensity).orderBy("doc_id").collect()
    again = lexicon.rewrite(texts(values).repartition(3), intensity).orderBy("doc_id").collect()
    assert rows == again
    p = INTENSITIES[intensity]
    for text, row in zip(values, rows):
        assert row.text == text and row.is_rewritten == (row.rewritten != text)
        counts = {k: row[f"n_{k}"] for k in lexicon.CHANGE_KINDS}
        assert row.changes == [k for k in lexicon.CHANGE_KINDS if counts[k]]
        assert len(row.rewritten.split("\n\n")) == len(re.split(r"\n\s*\n+", text))
        assert free_words(row.rewritten) == free_words(text)
        if p["merge_p"] == 0:
            assert counts["merge"] == counts["split"] == 0
        if not text.strip():
            assert row.rewritten == text and not any(counts.values())
        if not any(counts.values()):
            assert row.rewritten.split() == text.split()


def test_text_without_listed_phrases_is_left_alone(texts):
    value = "Zorro corre lejos. Nube baja tarde."
    (row,) = lexicon.rewrite(texts([value]), "low").collect()
    assert row.rewritten == value and not row.is_rewritten and row.changes == []


def test_low_intensity_keeps_sentences_and_bullets(texts):
    (row,) = lexicon.rewrite(texts([SAMPLE]), "low").collect()
    assert row.n_merge == row.n_split == 0
    assert row.rewritten.count("\n- ") == SAMPLE.count("\n- ")
    assert row.rewritten.count("\n\n") == SAMPLE.count("\n\n")
    assert row.text == SAMPLE


def test_rewrite_stays_inside_the_row(texts):
    plan = lexicon.rewrite(texts([SAMPLE]), "high")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_sites_need_word_boundaries(texts):
    frame = texts(["Muymuy MUY _muy ñmuy muy​ muy."]).select(
        F.transform(lexicon.phrase_sites(F.col("text"), ["muy"]), lambda m: m["position"]).alias("p")
    )
    assert frame.first().p == [7, 21, 26]


def test_longest_phrase_wins(texts):
    counts = lexicon.phrase_audit(texts(["Cabe destacar que x. cabe destacar y."] * 3), list(STOCK_PHRASES)).collect()
    assert {(r.phrase, r.n_sites, r.n_docs) for r in counts} == {("cabe destacar que", 3, 3), ("cabe destacar", 3, 3)}


def test_passive_candidates(texts):
    values = [
        "El libro fue escrito por Ana. El puente fue construido por los obreros. La ley fue aprobada por el senado.",
        "El texto fue traducido por la editorial. NASA fue fundada por unos ingenieros.",
    ]
    rows = lexicon.passive_candidates(texts(values)).orderBy("doc_id", "sent").collect()
    got = [(r.doc_id, r.subject, r.participle, r.agent, r.suggestion) for r in rows]
    assert got == [
        (0, "El puente", "construido", "los obreros", "Los obreros construieron el puente"),
        (0, "La ley", "aprobada", "el senado", "El senado aprobó la ley"),

        (1, "El texto", "traducido", "la editorial", None),
        (1, "NASA", "fundada", "unos ingenieros", "Unos ingenieros fundaron NASA"),
    ]


def test_paragraph_ordinals_skip_blanks(texts):
    rows = lexicon.paragraph_table(texts(["a\n\n \n\n\n- b\n- c\n\nd"])).orderBy("par").collect()
    assert [(r.paragraph, r.ordinal, r.is_bullet) for r in rows] == [("a", 1, False), ("- b\n- c", 2, True), ("d", 3, False)]
    rows = lexicon.paragraph_table(texts(["\n\na"])).orderBy("par").collect()
    assert [(r.paragraph, r.ordinal) for r in rows] == [("", None), ("a", 1)]


def _optimized(frame):
    conf, key = frame.sparkSession.conf, "spark.sql.maxPlanStringLength"
    before = conf.get(key)
    conf.set(key, str(1 << 30))
    try:
        return frame._jdf.queryExecution().optimizedPlan().toString()
    finally:
        conf.set(key, before)


def test_sentences_are_not_found_again_at_each_position(spark, tmp_path):
    """A lookup by position into an expression instead of a bound variable is quadratic in the sentences."""
    again = r"\)\[\(?lambda"
    texts = spark.createDataFrame([(1, "Uno va. Dos va. Tres va.")], "doc_id long, text string")
    assert not re.search(again, _optimized(lexicon.rewrite(texts, "high").select("rewritten")))
    texts.selectExpr("doc_id", "text", "'es' as lang", "'s' as source", "9L as n_chars").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    assert not re.search(again, _optimized(wording.exact_sampling(spark, str(tmp_path))))


def test_phrase_patterns_are_short_and_ascii(texts):
    phrases = ["década (1)", "ñandú", "a-b.c", "modo de"]
    pattern = patterns.whole_phrases(phrases)
    assert pattern.isascii() and r"\Qm\E" not in pattern
    found = texts(["La DÉCADA (1)x y la década (1) del ÑANDÚ; a-b.c a-bxc, MODO DE."])
    rows = found.select(lexicon.phrase_sites(F.col("text"), phrases).alias("m")).first().m
    assert [r.matched for r in rows] == ["década (1)", "ÑANDÚ", "a-b.c", "MODO DE"]
