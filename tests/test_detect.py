import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsa.functions import chars, patterns
from palimpsa.functions.scan import find_all
from palimpsa.operators import clean, detect
from palimpsa.operators.detect import DetectionConfig

FLAGGED = {cp for cp, _, _ in chars.singles()} | set(range(0xE0000, 0xE0080))


def found(texts, text, **config):
    frame = detect.findings_table(texts([text]), DetectionConfig(**config))
    return frame.orderBy("kind", "kw_ord", "position").collect()


def cleaned(texts, text, **config):
    return clean.clean(texts([text]), DetectionConfig(**config)).first()


def test_single_zero_width_space(texts):
    (row,) = found(texts, "hello​world")
    assert (row.id, row.codepoint, row.name, row.position, row.line, row.column) == (
        "inv:5", "U+200B", "ZERO WIDTH SPACE", 5, 1, 6,
    )


def test_several_kinds_in_order(texts):
    rows = found(texts, "a​b﻿c⁠d\U000e0041￿‪　")
    assert [r.codepoint for r in rows] == ["U+200B", "U+FEFF", "U+2060", "U+E0041", "U+FFFF", "U+202A", "U+3000"]
    assert rows[3].name == chars.TAG_NAME and rows[4].name == chars.NONCHARACTER_NAME
    assert rows[5].name == "BIDI CONTROL U+202A" and rows[6].name == "SUSPICIOUS SPACE (IDEOGRAPHIC SPACE)"


def test_ordinary_whitespace_is_not_flagged(texts):
    assert found(texts, "line one\n\tline two ") == []


def test_isolates_are_not_covered(texts):
    assert found(texts, "⁦x⁩") == []


def test_keyword_ignores_case(texts):
    (row,) = found(texts, "This document is CONFIDENTIAL and internal.", keywords=["confidential"])
    assert row.matched_text == "CONFIDENTIAL" and row.id == "kw:17:29"


def test_keyword_case_sensitive(texts):
    text = "this is a secret, not Secret... wait it is Secret"
    assert len(found(texts, text, keywords=["Secret"], case_sensitive=True)) == 2


def test_regex_keyword(texts):
    rows = found(texts, "Report tagged WM-1029 and also WM-8842.", keywords=[r"WM-\d{4}"], use_regex=True)
    assert [r.matched_text for r in rows] == ["WM-1029", "WM-8842"]


def test_broken_regex_is_skipped(texts):
    rows = found(texts, "some (text)", keywords=["(", "text"], use_regex=True)
    assert [r.matched_text for r in rows] == ["text"]


def test_literal_with_quote_terminator(texts):
    rows = found(texts, r"a\Eb a\eb", keywords=[r"a\Eb"])
    assert [r.position for r in rows] == [0, 5]


def test_detector_switch(texts):
    assert found(texts, "a​", detect_invisible=False) == []


def test_vetting(spark):
    unsafe = ["(a+)+$", "(a*)*b", r"(\w+)*$", "(a+){2,}", ".*.*.*x", "a" * 201, "(a)" * 25]
    safe = ["confidencial", r"©\d{4}", "watermark-[a-z0-9]+", r"\bZWSP\b", "^Draft:", r"[A-Za-z]+@[A-Za-z]+\.com"]
    usable, rejected = detect.vet_patterns(spark, unsafe + safe + ["(", "[a"])
    assert usable == safe
    assert rejected == [(p, "unsafe") for p in unsafe] + [("(", "invalid"), ("[a", "invalid")]


def test_limits_on_keywords():
    with pytest.raises(ValueError):
        DetectionConfig(keywords=["k"] * 101)
    with pytest.raises(ValueError):
        DetectionConfig(keywords=["k" * 301])


@pytest.mark.parametrize(
    "text,config,expected",
    [
        ("def foo():​\n    return 1﻿\n", {}, ("def foo():\n    return 1\n", 2, 0)),
        ("def add(a, b):\n​    return a + b\n", {}, ("def add(a, b):\n    return a + b\n", 1, 0)),
        ("start WATERMARK-X end", {"keywords": ["WATERMARK-X"]}, ("start  end", 0, 1)),
        ("top ​secret file", {"keywords": ["secret"]}, ("top  file", 1, 1)),
        ("nothing suspicious here", {}, ("nothing suspicious here", 0, 0)),
        ("xWM-001y", {"keywords": ["WM-0", "M-00", "01y"]}, ("x", 0, 3)),
        ("aa", {"keywords": ["a", "A"]}, ("", 0, 4)),
    ],
)
def test_cleaning(texts, text, config, expected):
    row = cleaned(texts, text, **config)
    assert (row.cleaned, row.removed_invisible, row.removed_keyword) == expected


def test_selected_ids_only(spark):
    frame = spark.createDataFrame(
        [(0, "a​b‌c kw", ["inv:1"], None), (1, "a​b kw", [], None), (2, "a​b kw", None, [])],
        "doc_id long, text string, inv array<string>, kw array<string>",
    )
    rows = clean.clean(frame, DetectionConfig(keywords=["kw"]), "inv", "kw").orderBy("doc_id").collect()
    assert [r.cleaned for r in rows] == ["ab‌c ", "a​b ", "ab kw"]
    assert [(r.removed_invisible, r.removed_keyword) for r in rows] == [(1, 1), (0, 1), (1, 0)]


def test_preview_marks_and_escapes(texts):
    row = cleaned(texts, "<a>​&kw'", keywords=["kw"])
    assert row.preview == (
        '&lt;a&gt;<del class="wm-removed">​</del>&amp;<del class="wm-removed">kw</del>&#x27;'
    )


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    alphabet = list("abx\n\n .'1_[&-\\$AÉéñ") + ["​", "﻿", "\U000e0041", "😀", "﷐", "﷑", "﷒", " "]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


PATTERNS = [
    r"a", r"x*", r"\bx*", r"[^\W\d_]+(?:'[^\W\d_]+)?", r"\w+", r"\W", r"[\w\-]+", r"(?P<q_1>a|b)(?P=q_1)",
    r"\s+", r"\d", r"a.b", r"é", r"x$", r"^a", r"[^\s\w]+", r"\Bb\b", r"a|",
]


def test_offsets_lines_columns_match_a_plain_scan(texts):
    values = random_texts(400)
    exprs = [find_all(F.col("text"), patterns.flags(False) + patterns.anywhere(p)) for p in PATTERNS]
    got = {r.doc_id: r for r in texts(values).select("doc_id", F.array(*exprs).alias("m")).collect()}
    for i, text in enumerate(values):
        for k, pattern in enumerate(PATTERNS):
            expected = [
                (
                    m.start(),
                    text.count("\n", 0, m.start()) + 1,
                    m.start() - text.rfind("\n", 0, m.start()),
                    m.group(0),
                )
                for m in re.finditer(pattern, text, re.IGNORECASE)
            ]
            assert [tuple(x) for x in got[i].m[k]] == expected, (pattern, text)


def test_cleaning_matches_a_plain_deletion(texts):
    values = random_texts(400, 2) + ["ab" * 400 + "​" * 300, "a\nb" * 2000]
    keywords = ["ab", "ba", "A"]
    rows = clean.clean(texts(values), DetectionConfig(keywords=keywords)).orderBy("doc_id").collect()
    for text, row in zip(values, rows):
        spans = [(i, i + 1) for i, c in enumerate(text) if ord(c) in FLAGGED]
        invisible = len(spans)
        for k in keywords:
            spans += [m.span() for m in re.finditer(re.escape(k), text, re.IGNORECASE)]
        gone = {x for a, b in spans for x in range(a, b)}
        assert row.cleaned == "".join(c for i, c in enumerate(text) if i not in gone)
        assert (row.removed_invisible, row.removed_keyword) == (invisible, len(spans) - invisible)
        unmarked = re.sub(r'<del class="wm-removed">(.*?)</del>', r"\1", row.preview, flags=re.DOTALL)
        import html

        assert html.unescape(unmarked) == text


def test_fast_path_equals_span_path(texts):
    values = random_texts(200, 3)
    frame = clean.clean(texts(values), DetectionConfig()).withColumn("fast", clean.strip_invisible(F.col("text")))
    assert frame.filter("fast <> cleaned").count() == 0


def test_look_alike_spaces_may_be_kept_apart(texts):
    row = texts(["a b​c"]).select(clean.strip_invisible(F.col("text"), " ").alias("t")).first()
    assert row.t == "a bc"


def test_span_table_form_equals_row_form(spark, texts):
    values = random_texts(200, 4)
    docs = texts(values)
    config = DetectionConfig(keywords=["ab", "ba", "A"])
    spans = detect.findings_table(docs, config).select(
        "doc_id", F.col("position").alias("start"), (F.col("position") + F.length("matched_text")).alias("end")
    )
    islands = clean.merge_span_table(spans)
    by_table = clean.apply_span_table(docs, islands).select("doc_id", F.col("cleaned").alias("c"))
    joined = clean.clean(docs, config).join(by_table, "doc_id")
    assert joined.count() == 200 and joined.filter("c <> cleaned").count() == 0
    segments = clean.kept_segments(islands, docs).join(docs, "doc_id")
    rebuilt = (
        segments.withColumn("s", F.expr("substr(text, seg_start + 1, seg_end - seg_start)"))
        .groupBy("doc_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "s"))), lambda x: x["s"]), "").alias("c"))
    )
    assert rebuilt.join(by_table.withColumnRenamed("c", "d"), "doc_id").filter("c <> d").count() == 0


def test_repeated_groups_survive_long_texts(spark, texts):
    long = "x" + "ab" * 100_000 + "\n" + "cd" * 100_000
    config = detect.DetectionConfig(keywords=["(?:a|b)+", "(?:ab|x)+", "(cd)+"], use_regex=True, detect_invisible=False)
    rows = detect.findings_table(texts([long]), config).orderBy("kw_ord").collect()
    assert [(r.position, r.line, r.column, len(r.matched_text)) for r in rows] == [
        (1, 1, 2, 200_000), (0, 1, 1, 200_001), (200_002, 2, 1, 200_000),
    ]


def test_rejected_patterns_are_told(spark):
    config = detect.DetectionConfig(keywords=["ok", "(", "(a+)+$"], use_regex=True)
    (row,) = spark.range(1).select(detect.rejected_keywords(spark, config).alias("r")).collect()
    assert [tuple(r) for r in row.r] == [("(", "invalid"), ("(a+)+$", "unsafe")]


def test_counts_up_to_and_comments_translate(texts):
    config = detect.DetectionConfig(keywords=["a{,2}b", "(?#note)c"], use_regex=True, detect_invisible=False)
    rows = detect.findings_table(texts(["aaab c"]), config).orderBy("kw_ord").collect()
    assert [r.matched_text for r in rows] == ["aab", "c"]


ALPHABET = "abAB\n İıſKµςΣσßéÉ\U0001F600"


def test_many_keywords_equal_one_by_one(texts, monkeypatch):
    """One pass for all keywords finds what a pass for each finds: overlaps, repeats, folded letters, lines."""
    rng = random.Random(4)
    pick = lambda low, high: "".join(rng.choices(ALPHABET, k=rng.randint(low, high)))
    keywords = [k for k in dict.fromkeys(pick(1, 4).strip() for _ in range(60)) if k] + ["aa", "AA", "aaa", "a"]
    frame = texts([pick(0, 400) for _ in range(40)] + ["", None, "ba" * 3_000, "aaaa\naaaaa"])
    for sensitive in (True, False):
        config = detect.DetectionConfig(keywords=keywords, case_sensitive=sensitive)
        one_pass = detect.findings_table(frame, config).collect()
        monkeypatch.setattr(detect, "AUTOMATON_KEYWORDS", 10_000)
        one_by_one = detect.findings_table(frame, config).collect()
        monkeypatch.undo()
        assert len(one_pass) > 1000 and sorted(one_pass) == sorted(one_by_one)


def test_ten_thousand_keywords_change_no_plan(texts):
    def plan(n):
        config = detect.DetectionConfig([f"word-{i}" for i in range(n)], max_keywords=n, detect_invisible=False)
        found = detect.findings_table(texts(["a word-7777, word-77 and Word-12"]), config)
        return found, found._jdf.queryExecution().executedPlan().toString().count("\n")

    small, large = plan(20), plan(10_000)
    assert small[1] == large[1]
    found = [(r.keyword, r.position) for r in large[0].orderBy("position", "keyword").collect()]
    assert found == [(f"word-{n}", 2) for n in (7, 77, 777, 7777)] + [("word-7", 13), ("word-77", 13), ("word-1", 25), ("word-12", 25)]
