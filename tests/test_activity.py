import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from palimpsa.operators import activity, validate
from palimpsa.streaming import streams


def plain_throttle(rows, limit, window):
    logs, accepted = {}, {}
    for event, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        log = logs.setdefault(key, deque())
        while log and t - log[0] > window:
            log.popleft()
        accepted[event] = len(log) < limit
        if accepted[event]:
            log.append(t)
    return accepted


def random_events(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < 0.4 else rnd.randint(1, 30)
        rows.append((i, key, rnd.choice([rnd.randint(0, 3000), 60 * rnd.randint(0, 50)])))
    return rows


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_throttle_matches_a_deque(spark, limit):
    rows = random_events(3000, limit)
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long").select(
        "event_id", "user_id", F.timestamp_seconds("s").alias("ts")
    )
    got = activity.throttle(events, "user_id", "ts", "event_id", limit, 60).collect()
    assert {r.event_id: r.accepted for r in got} == plain_throttle(rows, limit, 60)
    assert len(got) == len(rows)


def test_exempt_events_leave_no_trace(spark):
    events = spark.sql(
        "select id as event_id, 1L as user_id, timestamp_seconds(id) as ts, id % 2 = 0 as static from range(8)"
    )
    got = activity.throttle(events, "user_id", "ts", "event_id", 2, 60, exempt=F.col("static")).collect()
    assert sorted(r.event_id for r in got if not r.accepted) == [5, 7]


def test_latest_limits_before_the_shuffle(spark):
    events = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"))
    newest = activity.latest(events, "user_id", [F.col("event_id").desc()], 5)
    assert newest.count() == 15
    assert newest.agg(F.min("event_id")).first()[0] == 985
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_running_total_and_budget(spark):
    rnd = random.Random(5)
    rows = [(b, o, rnd.randint(0, 100)) for b in range(5) for o in range(rnd.choice([3, 2500]))]
    files = spark.createDataFrame(rows, "batch int, ord int, bytes long")
    got = {(r.batch, r.ord): r for r in validate.apply_byte_budget(files, cap=500).collect()}
    for batch in range(5):
        total = 0
        for b, o, size in sorted(r for r in rows if r[0] == batch):
            total += size
            assert got[b, o].running_bytes == total
            assert got[b, o].status == ("error" if total > 500 else "ok")


def test_oversized_batches_are_rejected_whole(spark):
    files = spark.createDataFrame([(b, i) for b, n in ((1, 20), (2, 21)) for i in range(n)], "batch int, ord int")
    got = validate.flag_oversized_batches(files.unionByName(files.limit(1).selectExpr("cast(null as int) as batch", "ord")))
    seen = {(r.batch, r.status, r.message) for r in got.collect()}
    assert seen == {(1, "ok", None), (2, "error", "too_many_files"), (None, "ok", None)} and got.count() == 42


def test_missing_keys_orders_and_times_stay(spark):
    rows = [(None, 1, 5), (None, 2, 7), (1, None, 3), (1, 9, 4), (1, 10**12, 1)]
    files = spark.createDataFrame(rows, "batch int, ord long, bytes long")
    got = {(r.batch, r.ord): r.running_bytes for r in validate.apply_byte_budget(files, cap=6).collect()}
    assert got == {(None, 1): 5, (None, 2): 12, (1, None): 3, (1, 9): 7, (1, 10**12): 8}
    events = spark.sql(
        "select * from values (1, null, 0), (2, null, 1), (3, 7, null), (4, null, null), (5, 7, 2) e(event_id, user_id, s)"
    ).select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    got = {r.event_id: r.accepted for r in activity.throttle(events, "user_id", "ts", "event_id", 1, 60).collect()}
    assert got == {1: True, 2: False, 3: None, 4: None, 5: True}


def write_events(spark, tmp_path, rows, parts=3):
    for p in range(parts):
        chunk = rows[p * len(rows) // parts : (p + 1) * len(rows) // parts]
        frame = spark.createDataFrame(chunk, "event_id long, user_id long, s long").select(
            "event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id",
            F.lit("x").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"),
        )
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def test_streamed_throttle_and_history(spark, tmp_path):
    rows = sorted(random_events(600, 9), key=lambda r: (r[2], r[0]))
    rows = [(i, k, t) for i, (_, k, t) in enumerate(rows)]
    path = write_events(spark, tmp_path, rows)
    streams.use_keyed_state(spark)
    throttled = streams.throttled_stream(streams.event_stream(spark, path, 1), limit=3)
    streams.append_to(throttled, str(tmp_path / "out"), str(tmp_path / "cp1")).awaitTermination()
    got = {r.event_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain_throttle(rows, 3, 60)

    seen = {}

    def keep(batch, number):
        for r in batch.collect():
            seen.setdefault((number, r.user_id), []).append((r.recency, r.event_id))

    history = streams.history_stream(streams.event_stream(spark, path, 1), length=4, ttl_ms=None)
    query = (
        history.writeStream.foreachBatch(keep).outputMode("update")
        .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    for user in {k for _, k, _ in rows}:
        last = max(n for n, u in seen if u == user)
        expected = [i for i, k, _ in rows if k == user][::-1][:4]
        assert [e for _, e in sorted(seen[last, user])] == expected
