import hashlib
import re

import pytest

from palimpsa.llm import exact


def expected(rows):
    best, size = {}, {}
    for k, t in rows:
        t = t or ""
        size[t] = size.get(t, 0) + 1
        best[t] = max(best.get(t, -1), -1 if k is None else k)
    return best, size


def test_groups_match_brute_force(docs, prose):
    base = prose(1, 200)
    rows = [(i, base + ("x" if i % 3 == 0 else "y") * (i % 5)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, base[:64]), (103, base[:64] + "z"), (104, "é" * 3), (None, "alone"), (None, base)]
    best, size = expected(rows)
    got = exact.exact_groups(docs(rows), digest_all=True).collect()
    assert len(got) == len(rows)
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in rows}
    for r in got:
        text = texts[r.text_sha256]
        assert r.group_size == size[text]
        assert (r.keep_id if r.keep_id is not None else -1) == best[text]
    kept = [r for r in got if r.kept]
    assert len(kept) == len(size) and all(r.doc_id == r.keep_id for r in kept)


def test_digests_only_where_needed(docs):
    got = {r.doc_id: r.text_sha256 for r in exact.exact_groups(docs([(1, "a"), (2, "b"), (3, "b"), (4, "cc")])).collect()}
    assert got[4] is None and got[2] == got[3] is not None


def test_repeated_rows_leave_one_with_all_columns(docs):
    frame = docs([(1, "same"), (1, "same"), (1, "same"), (2, None), (2, None), (3, "")])
    out = exact.drop_exact(frame)
    assert out.columns == frame.columns
    assert sorted((r.doc_id, r.text, r.kept) for r in out.collect()) == [(1, "same", "x"), (3, "", "x")]


def test_empty_table(docs):
    assert exact.exact_groups(docs([])).collect() == []
    assert exact.drop_exact(docs([])).collect() == []


def test_one_hot_group(docs):
    rows = [(i, "copy" if i % 3 == 0 else f"t{i}") for i in range(900)]
    got = exact.exact_groups(docs(rows, 5)).filter("text_sha256 is not null and group_size > 1").collect()
    assert len(got) == 300 and {r.keep_id for r in got} == {897} and sum(r.kept for r in got) == 1


@pytest.mark.parametrize("digest_all", [True, False])
def test_no_text_in_any_exchange(spark, docs, prose, monkeypatch, tmp_path, digest_all):
    """With classes too many to broadcast, rows meet them without their texts."""
    base = prose(1, 200)
    rows = [(i, base + "x" * (i % 7)) for i in range(40)] + [(50, None), (51, "")]
    plain = sorted(tuple(r) for r in exact.exact_groups(docs(rows), digest_all=digest_all).collect())
    plans, settle = [], exact.settle

    def seen(frame, name):
        query = frame._jdf.queryExecution()
        plans.append(spark.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(query, "formatted"))
        return settle(frame, name)

    monkeypatch.setattr(exact, "settle", seen)
    monkeypatch.setattr(exact, "BROADCAST_CLASSES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs(rows).write.parquet(str(tmp_path / "docs"))  # the fixture's own repartition is not the operator's
        frame = spark.read.parquet(str(tmp_path / "docs"))
        got = sorted(tuple(r) for r in exact.exact_groups(frame, digest_all=digest_all).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", p) for p in plans]
    assert any("SortMergeJoin" in p for p in plans) and sum(len(m) for m in moved) >= 6
    assert not [names for m in moved for names in m if "text#" in names]
    assert [r[:4] for r in got] == [r[:4] for r in plain]
