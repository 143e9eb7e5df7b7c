import random

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsa.operators import code, validate
from palimpsa.suite import sourcecode


def plain_comments(text, language):
    """A hand-written scanner of the same rules, line by line."""
    line_mark, start, end = code.SYNTAX.get(language, code.DEFAULT_SYNTAX)
    out, inside = [], False
    for number, line in enumerate(text.split("\n"), start=1):
        if inside:
            body, found, _ = line.partition(end)
            out.append(("block", number, body))
            inside = not found
            continue
        quote, i = None, 0
        while i < len(line):
            if quote:
                if line[i] == "\\":
                    i += 1
                elif line[i] == quote:
                    quote = None
            elif line[i] in "'\"`":
                quote = line[i]
            elif line_mark and line.startswith(line_mark, i):
                out.append(("line", number, line[i + len(line_mark) :]))
                break
            elif start and line.startswith(start, i):
                body, found, _ = line[i + len(start) :].partition(end)
                out.append(("block", number, body))
                inside = not found
                break
            i += 1
    return out


@pytest.mark.parametrize("language", ["python", "javascript", "css", "sql", "html", "brainfuck"])
def test_comments_match_a_scanner(spark, language):
    rnd = random.Random(language)
    alphabet = ["'", '"', "`", "\\", "\n", "\n", "#", "//", "/*", "*/", "--", "<!--", "-->", "a", " ", "é", "/", "*", "-"]
    values = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    values += ["x = '" + "a" * 40_000 + "' # end\n# next"]
    frame = spark.createDataFrame(list(enumerate(values)), "doc_id int, code string")
    rows = frame.select("doc_id", code.comments(F.col("code"), F.lit(language)).alias("c")).collect()
    for row in rows:
        assert [tuple(c) for c in row.c] == plain_comments(values[row.doc_id], language), values[row.doc_id]


@pytest.mark.parametrize(
    "text,filename,language,expected",
    [
        ("import os\n\ndef foo():\n    pass", None, None, "python"),
        ("<!DOCTYPE html><p>", None, None, "html"),
        ("x", "script.rs", None, "rust"),
        ("x", "script.rs", "Python", "python"),
        ("x", "script.rs", "auto", "rust"),
        ("x", "a.b.YML", "klingon", "yaml"),
        ("<?php echo 1;", "noext", None, "php"),
        ("public class A {}", None, None, "java"),
        ("fn main() -> i32 {}", None, None, "rust"),
        ("package main\nfunc main() {}", None, None, "go"),
        ("package a.b;", None, None, "java"),
        ("select 1; delete from t", None, None, "sql"),
        ("let x = 1", None, None, "javascript"),
        (" " * 2001 + "import os", None, None, "python"),
    ],
)
def test_language(spark, text, filename, language, expected):
    frame = spark.createDataFrame([(text, filename, language)], "c string, f string, l string")
    got = frame.select(code.resolve_language(F.col("c"), F.col("f"), F.col("l")).alias("r")).first().r
    assert got == expected


def test_language_by_a_given_head_only(spark):
    frame = spark.createDataFrame([(" " * 2001 + "import os",)], "c string")
    assert frame.select(code.sniff_language(F.col("c"), 2000).alias("r")).first().r == "javascript"


def test_audits(spark):
    frame = spark.createDataFrame(
        [(0, "# Nota importante: x\ny = '#' # nota: z\n", "a.py"), (1, "/* Note: a\nb */", "b.js")],
        "doc_id int, code string, filename string",
    )
    extracted = code.with_comments(frame, "code", "filename")
    openers = {(r.language, r.opener, r.n_comments) for r in code.opener_audit(code.comment_table(extracted)).collect()}
    assert openers == {("python", "nota importante:", 1), ("python", "nota:", 1), ("javascript", "note:", 1)}
    audit = {r.language: r for r in code.language_audit(extracted).collect()}
    assert (audit["python"].n_comment_lines, audit["javascript"].comment_chars) == (2, 10)


def test_code_partition_measures_long_sources(spark, tmp_path):
    """Sources over the limit for a single request have their results, by the same SQL as short ones."""
    long = "'" + "\\a" * 60_000 + "' /* uno\ndos */ z" + "\n// tres" * 20_000
    rows = [(i, long, "es", "s", len(long)) for i in (1, 3, 4)] + [(12, "y", "es", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected = db.execute(sourcecode.QUERIES["code_partition"][1])
    columns = [d[0] for d in expected.description]
    got = sourcecode.code_partition(spark, str(tmp_path)).select(*columns)
    assert len(long) > validate.MAX_CODE_CHARS
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())
