import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsa.operators.detect import DetectionConfig, add_findings
from palimpsa.operators.validate import violations, with_status
from palimpsa.plans import jobs
from palimpsa.sources import documents as docs
from palimpsa.sources import files, sinks
from palimpsa.streaming import streams
from palimpsa.suite import events


def test_stream_scan_history_and_windows(spark, tmp_path):
    source = str(tmp_path / "docs")
    frame = spark.range(20).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("x​ kw "), F.col("id")).alias("text"),
        F.lit("es").alias("lang"), (F.col("id") % 2).cast("string").alias("source"), F.lit(5).cast("long").alias("n_chars"),
        F.lit("f").alias("filename"), F.timestamp_seconds("id").alias("ts"),
    )
    frame.repartition(2).write.parquet(source)
    config = DetectionConfig(keywords=["kw"])
    scanned = streams.scanned_stream(streams.document_stream(spark, source, 1, frame.schema), config)
    streams.write_with_history(
        scanned, str(tmp_path / "r"), str(tmp_path / "h"), str(tmp_path / "cp")
    ).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "h")).agg(F.sum("findings")).first()[0] == 40
    assert spark.read.parquet(str(tmp_path / "r")).count() == 20

    cleaned = streams.cleaned_stream(streams.document_stream(spark, source, 1), config)
    streams.append_to(cleaned, str(tmp_path / "c"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "c")).filter("cleaned like 'x  %'").count() == 20

    timed = streams.document_stream(spark, source, 1).withColumn(
        "ts", F.timestamp_seconds(F.col("doc_id") * 43200)
    )
    windows = streams.finding_windows(streams.scanned_stream(timed, config), "ts")
    streams.append_to(windows, str(tmp_path / "w"), str(tmp_path / "cp3")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "w")).collect()
    assert rows and all(r.n_docs == 2 and r.n_invisible == 2 and r.n_keyword == 2 for r in rows)


def test_files_are_decoded_labelled_and_capped(spark, tmp_path):
    content = {
        "a.txt": "año\n".encode(), "b.TXT": "año".encode("latin-1"), "bom.md": b"\xef\xbb\xbfhi",
        "noext": b"plain", "x.pdf": b"%PDF", "big.txt": b"z" * 200, "weird.xyz": b"ok",
    }
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.filename: r for r in files.read_files(spark, str(tmp_path), max_bytes=100).collect()}
    assert rows["a.txt"].text == "año\n" and rows["b.TXT"].text == "año"
    assert rows["bom.md"].text == "﻿hi"
    assert (rows["noext"].file_type, rows["b.TXT"].file_type, rows["weird.xyz"].file_type) == ("text", "txt", "xyz")
    assert rows["x.pdf"].status == "error" and rows["big.txt"].message == "too_many_bytes"
    scanned = {r.filename: r for r in jobs.scan_files(spark, str(tmp_path), DetectionConfig()).collect()}
    assert scanned["bom.md"].total_findings == 1 and scanned["bom.md"].file_type == "md"
    assert (scanned["x.pdf"].total_findings, scanned["x.pdf"].clean, scanned["x.pdf"].score) == (None, None, None)
    listed = files.list_files(spark, str(tmp_path))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


def test_fragments_and_keyword_fields(spark):
    frame = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (1, 10, "c"), (2, 1, "z")], "k int, o int, text string")
    got = {r.k: r.text for r in docs.assemble(frame, "k", ["o"]).collect()}
    assert got == {1: "\nb\nc", 2: "z"}
    fields = spark.createDataFrame([(1, " a, ,b c ,," + ",".join(f"k{i}" for i in range(200)))], "id int, f string")
    rows = docs.keyword_rows(fields, "id", "f").orderBy("kw_ord").collect()
    assert [r.keyword for r in rows[:3]] == ["a", "b c", "k0"] and len(rows) == 202
    assert [r.within_limit for r in rows] == [True] * 100 + [False] * 102
    assert docs.keyword_rows(fields, "id", "f", 2).filter("within_limit").count() == 2
    table = spark.range(3000).selectExpr("id % 2 as k", "id * id as o", "id as keyword")
    ranks = {(r.k, r.keyword): r.kw_ord for r in docs.ranked_keywords(table, "k", "o").collect()}
    assert ranks == {(i % 2, i): i // 2 + 1 for i in range(3000)}


def test_limits_become_codes_and_quarantine(spark, tmp_path):
    frame = spark.createDataFrame(
        [(0, "x" * 200_000, "f"), (1, "x" * 200_001, "f"), (2, " \n ", "f" * 256), (3, None, "f")],
        "doc_id long, text string, filename string",
    )
    checked = with_status(frame, violations(F.col("text"), F.col("filename")))
    got = {r.doc_id: (r.status, r.message) for r in checked.collect()}
    assert got == {
        0: ("ok", None), 1: ("error", "too_long"), 2: ("error", "blank,filename_too_long"), 3: ("error", "blank"),
    }
    sinks.write_split(checked, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 3


def test_result_and_cleaned_sinks(spark, tmp_path):
    frame = docs.with_filename(spark.createDataFrame([(0, "a​"), (1, "b")], "doc_id long, text string"))
    cleaned = jobs.clean_corpus(frame, DetectionConfig())
    sinks.write_results(cleaned.select("doc_id", "out_path", "cleaned"), str(tmp_path / "c"))
    back = {r.out_path: r.cleaned for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert back == {"0/clean_pasted_text.txt": "a", "1/clean_pasted_text.txt": "b"}
    nested = sinks.nested_result(jobs.scan_corpus(frame, DetectionConfig()))
    sinks.write_results(nested, str(tmp_path / "n"))
    row = spark.read.parquet(str(tmp_path / "n")).orderBy("doc_id").first()
    assert row.result.invisible_chars[0].codepoint == "U+200B" and not row.result.clean
    assert add_findings(frame, DetectionConfig(detect_invisible=False)).selectExpr("sum(size(findings))").first()[0] == 0


def test_batches(spark):
    rows = [(b, o, b * 100 + o, "t​" * 10, 20) for b, n in ((0, 5), (1, 25)) for o in range(n)]
    frame = spark.createDataFrame(rows, "batch int, ord int, doc_id long, text string, bytes long")
    got = jobs.scan_batches(frame, DetectionConfig(), max_bytes=60).orderBy("batch", "ord").collect()
    assert [r.message for r in got] == [None] * 3 + ["batch_budget_exceeded"] * 2 + ["too_many_files"] * 25
    assert [r.total_findings for r in got] == [10] * 3 + [None] * 27
    assert all((r.clean, r.score, r.findings, r.band) == (None,) * 4 for r in got if r.status == "error")
    cleaned = jobs.clean_batches(frame, DetectionConfig()).collect()
    assert len(cleaned) == 30 and sum(r.cleaned is None for r in cleaned) == 25


def test_code_over_its_limit_has_no_results(spark):
    frame = spark.createDataFrame([("a.py", "# x\n" * 30), ("b.py", "# x\n")], "filename string, code string")
    got = {r.filename: (r.status, r.n_comment_lines) for r in jobs.audit_code(frame, 100).collect()}
    assert got == {"a.py": ("error", None), "b.py": ("ok", 1)}


def _sent(spark, folder, batches, schema):
    """A stream of one micro-batch per list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def _told(spark, stream, folder):
    streams.use_keyed_state(spark)
    streams.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint", "append").awaitTermination()
    return spark.read.parquet(f"{folder}/out").orderBy("batch").collect()


DAY = 86_400


def test_windows_close_once_and_late_rows_are_listed(spark, tmp_path):
    batches = [
        [(1, 10, 1), (2, 2 * DAY, 1), (3, None, 7)], [(4, 50, 1), (5, 5 * DAY, 2)], [(6, 60, 4), (7, 2 * DAY + 7, 5), (8, 6 * DAY, 1)]
    ]
    folder = str(tmp_path)
    _sent(spark, f"{folder}/in", batches, "id long, s long, points long")
    rows = spark.readStream.schema("id long, s long, points long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    timed = rows.withColumn("ts", F.timestamp_seconds("s"))
    told = _told(spark, streams.closing_windows(timed, "ts", "id", ["points"]), folder)
    day = lambda r: None if r.window_start is None else r.window_start // (DAY * 1000)
    late = sorted((day(r), r.id, r.points, r.batch) for r in told if r.kind == "late")
    assert late == [(0, 4, 1, 1), (0, 6, 4, 2), (2, 7, 5, 2)]
    assert [(r.id, r.points) for r in told if r.kind == "untimed"] == [(3, 7)]
    closed = [(day(r), r.n_rows, r.points) for r in told if r.kind == "closed"]
    assert sorted(closed) == [(0, 1, 1), (2, 1, 1)]  # days 5 and 6 are still open


def test_silent_keys_lose_their_history(spark, tmp_path):
    a, b = 1, None
    batches = [
        [(1, 0, a), (2, 100, a), (3, 0, b), (4, None, a)], [(5, 2 * DAY, b)], [(6, 6 * DAY, a)], [(7, 9 * DAY, a), (8, 100, b)]
    ]
    folder = str(tmp_path)
    _sent(spark, f"{folder}/in", batches, "event_id long, s long, user_id long")
    rows = spark.readStream.schema("event_id long, s long, user_id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    told = _told(spark, streams.expiring_history(rows.withColumn("ts", F.timestamp_seconds("s")), ttl_ms=3 * DAY * 1000), folder)
    assert [(r.user_id, r.event_id) for r in told if r.kind == "untimed"] == [(a, 4)]
    kept = {}
    for r in told:
        if r.kind == "kept":
            kept.setdefault((r.batch, r.user_id), []).append(r.event_id)
    assert kept == {
        (0, a): [2, 1], (0, b): [3], (1, b): [5, 3], (2, a): [6, 2, 1], (3, a): [7, 6, 2, 1], (3, b): [None]
    }
    assert [(r.user_id, r.batch) for r in told if r.kind == "evicted"] == [(b, 3)]


def test_many_keys_share_a_state(spark, tmp_path):
    """State and calls are bounded by parts, not by keys; a history ends when the watermark reaches its end."""
    ttl, hour, keys = 3 * DAY, 3600, 200
    batches = [
        [(2 * k, 100 + k, k) for k in range(keys)] + [(2 * k + 1, 200 + k, k) for k in range(keys)],
        [(1000, ttl + 300 + hour, 7)],  # the watermark reaches the ends of keys up to 100
        [(2000 + k, ttl + 500 + hour, k) for k in range(60, 120)],
    ]
    folder = str(tmp_path)
    _sent(spark, f"{folder}/in", batches, "event_id long, s long, user_id long")
    rows = spark.readStream.schema("event_id long, s long, user_id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream = streams.expiring_history(rows.withColumn("ts", F.timestamp_seconds("s")), length=2, ttl_ms=ttl * 1000, parts=3)
    streams.use_keyed_state(spark)
    query = streams.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint", "append")
    query.awaitTermination()
    assert 0 < max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 3
    told = spark.read.parquet(f"{folder}/out").collect()
    first = {r.user_id for r in told if r.kind == "evicted" and r.batch <= 2}
    assert first == set(range(101)) - {7}  # key 7 was heard of in time, key 100 ends on the moment
    kept = {}
    for r in sorted((r for r in told if r.kind == "kept"), key=lambda r: r.recency):
        kept.setdefault((r.batch, r.user_id), []).append(r.event_id)
    assert kept == (
        {(0, k): [2 * k + 1, 2 * k] for k in range(keys)} | {(1, 7): [1000, 15]}
        | {(2, k): [2000 + k] if k <= 100 else [2000 + k, 2 * k + 1] for k in range(60, 120)}
    )


def test_events_without_a_time_are_not_judged(spark, tmp_path):
    folder = str(tmp_path)
    schema = "event_id long, s long, user_id long"
    _sent(spark, f"{folder}/in", [[(1, None, 1), (2, 5, 1), (3, 6, 1)], [(4, None, None), (5, 7, None)]], schema)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    told = _told(spark, streams.throttled_stream(rows.withColumn("ts", F.timestamp_seconds("s")), limit=1), folder)
    verdicts = {r.event_id: (r.user_id, r.accepted) for r in told}
    assert verdicts == {1: (1, None), 2: (1, True), 3: (1, False), 4: (None, None), 5: (None, True)}


def test_readers_see_results_and_history_of_a_batch_or_neither(spark, tmp_path, monkeypatch):
    """The writer fails between both writes, then before the commit; a replay gives each row once, also a second one."""
    source, results, history = (str(tmp_path / name) for name in ("docs", "r", "h"))
    frame = spark.range(6).select(
        F.col("id").alias("doc_id"), F.lit("x kw").alias("text"), F.lit("es").alias("lang"),
        F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"),
        F.lit("f").alias("filename"), F.timestamp_seconds("id").alias("ts"),
    )
    frame.repartition(3, "doc_id").write.option("maxRecordsPerFile", 2).parquet(source)
    config = DetectionConfig(keywords=["kw"])
    scanned = streams.scanned_stream(streams.document_stream(spark, source, 1, frame.schema), config)
    told = T.StructType.fromDDL("session_id string, doc_id bigint, filename string, ts timestamp, findings int")

    def run(checkpoint):
        streams.write_with_history(scanned, results, history, str(tmp_path / checkpoint)).awaitTermination()

    def seen():
        first = streams.committed_rows(spark, results, frame.schema, results)
        second = streams.committed_rows(spark, history, told, results)
        return [sorted((r.batch, r.doc_id) for r in rows.collect()) for rows in (first, second)]

    assert seen() == [[], []]
    for step in ("_history", "_commit"):
        with monkeypatch.context() as broken:
            broken.setattr(streams, step, lambda *_: 1 / 0)
            with pytest.raises(StreamingQueryException):
                run("cp")
        assert seen() == [[], []]
    assert spark.read.parquet(results).count() > 0
    run("cp")
    whole = seen()
    assert whole[0] == whole[1] and sorted(doc for _, doc in whole[0]) == list(range(6))
    assert len({batch for batch, _ in whole[0]}) > 1
    run("lost")  # the stream's own checkpoint is gone, and its batches come again under their numbers
    assert seen() == whole


def test_a_micro_batch_takes_all_files_of_a_part(spark, tmp_path):
    """Files that were written by many tasks are not read one at a time."""
    spark.range(24).selectExpr(
        "id as doc_id", "concat('texto ', id) as text", "'es' as lang", "'s' as source", "10L as n_chars"
    ).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    stream = events._planted_stream(spark, str(tmp_path), str(tmp_path / "work"))
    streams.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "append").awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert len(spark.read.parquet(str(tmp_path / "work/in")).inputFiles()) > 3
    assert sorted(r.doc_id for r in written.collect()) == list(range(24))
    assert {r.batch for r in written.select("batch").distinct().collect()} == {0, 1, 2}


def test_small_packs_share_a_task_and_folders_are_listed_once(spark, tmp_path, monkeypatch):
    texts = spark.range(120).selectExpr("id % 2 as g", "id as o", "repeat('x', 99) as text")
    sinks.write_packs(texts, str(tmp_path / "p"), "g", "o", pack_bytes=100)
    found = files.list_files(spark, str(tmp_path / "p")).filter("filename like 'part-%'").collect()
    assert len(found) == 120 and {r.bytes for r in found} == {100}
    assert len({r.filename.split("-")[1] for r in found}) <= spark.sparkContext.defaultParallelism
    listed, own = [], files._files
    before = spark.conf.get(files.LISTING)
    monkeypatch.setattr(files, "_files", lambda *args: listed.append(args) or own(*args))
    assert files.read_files(spark, str(tmp_path / "p"), 50).filter("status = 'error'").count() == 120
    assert len(listed) == 1 and spark.conf.get(files.LISTING) == before
