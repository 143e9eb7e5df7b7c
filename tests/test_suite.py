"""Registered queries against independent SQL, and the shape of a few plans."""

import pathlib

import pytest

import compare

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="shared tables absent")

CHECKED = [
    "combined_findings", "clean_documents", "kept_segments", "style_score", "batch_scan", "validation",
    "synonym_substitution", "pair_merge", "split_points", "code_comments", "throttle", "recent_history", "batch_budget",
    "stream_clean", "stream_throttle", "stream_recent", "stream_windows", "stream_history", "scan_corpus",
]


@pytest.fixture(scope="module")
def db():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    problem, rows = compare.compare(spark, db, SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None
    assert rows > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["strip_invisible", "clean_documents", "scan_corpus", "style_score", "rewrite_corpus"])
def test_per_document_work_adds_no_shuffle(spark, name):
    assert "Exchange" not in plan(entry.queries()[name](spark, SF_DIR))


def test_scans_are_pruned(spark):
    text = plan(entry.queries()["strip_invisible"](spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,text:string,n_chars:bigint>" in text
    text = plan(entry.queries()["active_sessions"](spark, SF_DIR))
    assert "ReadSchema: struct<user_id:bigint>" in text


def test_findings_are_computed_once(spark):
    """No size filter may be inferred below the projection: it would scan every text twice."""
    text = plan(entry.queries()["invisible_scan"](spark, SF_DIR))
    below = text.split("Generate", 1)[1]
    assert "- Filter" not in below and ") Filter" not in below
