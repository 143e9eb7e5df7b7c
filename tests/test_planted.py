"""Documents without a character, and with very large ids, in the planted corpus."""

import duckdb
import pytest
from pyspark.sql import functions as F

import compare
from palimpsa.suite import corpus, registry

NAMED = [
    "batch_scan", "batch_summary", "batch_budget", "chosen_findings", "clean_batches", "clean_documents",
    "combined_findings", "custom_phrases", "clean_corpus", "deep_patterns", "file_findings", "invisible_by_source",
    "frequent_characters", "clean_from_span_table", "invisible_names", "invisible_scan", "findings_per_document",
    "keywords_any_case", "keywords_exact_case", "many_keywords", "most_flagged_documents", "kept_segments", "quarantine",
    "keywords_regex_vetted",
]
# The operators take a missing text for an empty one, where the SQL has null.
NULL_IS_EMPTY = ["batch_scan", "clean_batches", "clean_documents", "clean_corpus", "deep_patterns"]
EMPTY = [3, 13, 22, 25]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("planted"))
    text = F.when(F.col("doc_id").isin(EMPTY), "").otherwise(F.concat(F.lit("Texto b, a "), "doc_id", F.lit(".\nFin.")))
    documents = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("es").alias("lang"))
    documents = documents.withColumn("text", text).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 2))
    documents.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", NAMED)
def test_documents_of_no_characters_end_no_query(spark, folder, name):
    frame = registry.all_queries()[name](spark, folder)
    db = duckdb.connect()
    db.execute("set error_on_division_by_zero = false")  # as the code: a place among no characters is null
    db.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    expected = db.execute(registry.all_sql()[name])
    columns = [d[0] for d in expected.description]
    got, wanted = ([dict(zip(c, r, strict=True)) for r in rows] for c, rows in ((frame.columns, frame.collect()), (columns, expected.fetchall())))
    assert len(got) == len(wanted) > 0
    if name in NULL_IS_EMPTY:
        got, wanted = ([r for r in rows if r["doc_id"] not in EMPTY] for rows in (got, wanted))
    left_out = {"original_length"} if name == "file_findings" else set()  # the writer ends a missing text's line, too
    kept = sorted(set(columns) - left_out)
    assert compare.rows_of(kept, [[r[c] for c in kept] for r in got]) == compare.rows_of(kept, [[r[c] for c in kept] for r in wanted])


def test_large_ids_have_their_place(spark, tmp_path):
    ids = [2**62 + 1, 2**60, 7, 0]
    rows = [(i, "abcdefghij", "es", "s", 10) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    found = {r.doc_id: r.text for r in corpus.marked(spark, str(tmp_path)).collect()}
    assert len(found) == 4
    for i in ids:
        if i % 11:
            planted = chr(corpus.PLANTED[i % 10])
            assert "abcdefghij"[: i * 37 % 10] + planted + "abcdefghij"[i * 37 % 10 :] + "\n" + planted * 2 in found[i]
