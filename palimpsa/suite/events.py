"""Event and streaming queries with their plain-SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsa.operators import activity
from palimpsa.plans import jobs
from palimpsa.session import checkpoint_dir
from palimpsa.streaming import streams
from palimpsa.suite.corpus import marked, table
from palimpsa.suite.detection import BODY, CLEANED, CONFIG, COUNTS, ISL, SEG

LIMIT, WINDOW = 3, 86_400


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")


def _gapped(spark, sf_dir):
    """The events, some without a user and some without a time."""
    return _events(spark, sf_dir).withColumns(
        {
            "user_id": F.when(F.col("event_id") % 11 != 5, F.col("user_id")),
            "ts": F.when(F.col("event_id") % 17 != 9, F.col("ts")),
        }
    )


def _newest():
    return [F.col("ts").desc(), F.col("event_id").desc()]


def throttle(spark, sf_dir):
    admitted = activity.throttle(_gapped(spark, sf_dir), "user_id", "ts", "event_id", LIMIT, WINDOW)
    return admitted.select("event_id", "user_id", "accepted")


def throttle_with_exemptions(spark, sf_dir):
    exempt = F.col("event_type") == "click"
    admitted = activity.throttle(_events(spark, sf_dir), "user_id", "ts", "event_id", LIMIT, WINDOW, exempt)
    return admitted.groupBy("event_type", "accepted").agg(F.count("*").alias("n"))


def recent_history(spark, sf_dir):
    return activity.latest(_events(spark, sf_dir), "user_id", _newest()).select("user_id", "recency", "event_id")


def dashboard_rows(spark, sf_dir):
    newest = activity.latest(_events(spark, sf_dir), "user_id", _newest(), activity.DASHBOARD_LENGTH)
    return newest.select("user_id", "recency", "event_id", "event_type")


def active_sessions(spark, sf_dir):
    return activity.active_keys(_events(spark, sf_dir), "user_id")


def daily_activity(spark, sf_dir):
    timed = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def session_activity(spark, sf_dir):
    return jobs.session_activity(_events(spark, sf_dir), LIMIT, WINDOW).select("user_id", "recency", "event_id")


def _work_dir(spark):
    return f"{checkpoint_dir(spark)}/palimpsa-{uuid.uuid4().hex}"


def _planted_stream(spark, sf_dir, work, parts=3):
    """The planted corpus as a stream: parts that arrive one after another, a micro-batch of as many files as a part has each."""
    planted = marked(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600))
    for part in range(parts):
        rows = planted.filter(F.col("doc_id") % parts == part)
        rows.write.mode("append").parquet(f"{work}/in")
    # Every part has a file for each task that wrote it; one file at a time would be one task at a time.
    files = len(spark.read.schema(planted.schema).parquet(f"{work}/in").inputFiles())
    return streams.document_stream(spark, f"{work}/in", max(1, -(-files // parts)), planted.schema)


FILE_EVENTS = 250_000


def _arriving(spark, events, part, work, parts):
    """Events as a stream whose micro-batches are the values of ``part``, each written as many files as it needs."""
    files = max(1, -(-events.count() // (parts * FILE_EVENTS)))
    for n in range(parts):
        events.filter(part == n).repartition(files).write.mode("append").parquet(f"{work}/in")
    return streams.event_stream(spark, f"{work}/in", files)


def _ordered_stream(spark, sf_dir, work, parts=4):
    """Events by time, the earliest first; so state is carried from batch to batch. Those without a time come first."""
    events = _gapped(spark, sf_dir).withColumns({"value": F.lit(None).cast("double"), "props": F.lit(None).cast("string")})
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.select(at.alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)
    part = sum((F.coalesce(at >= F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    return _arriving(spark, events, part, work, parts)


QUARTERS = 4


def _quartered(spark, sf_dir):
    """The events with the quarter of the whole time span that they lie in; those without a time are in the first."""
    events = _gapped(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = events.agg(F.min("t"), F.max("t")).first()
    quarter = F.coalesce(F.floor((F.col("t") - F.lit(low)) * QUARTERS / F.lit((high or 0) - (low or 0) + 1)), F.lit(0))
    return events.withColumn("quarter", quarter.cast("int"))


def stream_clean(spark, sf_dir):
    """Documents as a stream, cleaned by the batch function, appended to a table."""
    work = _work_dir(spark)
    cleaned = streams.cleaned_stream(_planted_stream(spark, sf_dir, work), CONFIG).select(
        "doc_id", "cleaned", "removed_invisible", "removed_keyword"
    )
    streams.append_to(cleaned, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return spark.read.schema(cleaned.schema).parquet(f"{work}/out")


def stream_throttle(spark, sf_dir):
    """The throttle with keyed state over several micro-batches."""
    work = _work_dir(spark)
    streams.use_keyed_state(spark)
    admitted = streams.throttled_stream(_ordered_stream(spark, sf_dir, work), limit=LIMIT, window_seconds=WINDOW)
    streams.append_to(admitted, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return spark.read.schema("user_id bigint, event_id bigint, accepted boolean").parquet(f"{work}/out")


def stream_recent(spark, sf_dir):
    """Keyed history over several micro-batches: the last state of each key."""
    work = _work_dir(spark)
    streams.use_keyed_state(spark)
    history = streams.history_stream(_ordered_stream(spark, sf_dir, work), ttl_ms=None)
    streams.write_batches(history, f"{work}/out", f"{work}/checkpoint", "update").awaitTermination()
    states = spark.read.schema("user_id bigint, event_id bigint, recency int, batch int").parquet(f"{work}/out")
    last = states.groupBy(F.col("user_id").alias("whose")).agg(F.max("batch").alias("newest"))
    same = F.col("user_id").eqNullSafe(F.col("whose")) & (F.col("batch") == F.col("newest"))
    return states.join(last, same).select("user_id", "recency", "event_id")


def _with_silence(spark, sf_dir):
    """A third of the users is silent in the middle of the time."""
    silent = (F.col("user_id") % 3 == 0) & F.col("quarter").isin(1, 2) & F.col("ts").isNotNull()
    return _quartered(spark, sf_dir).filter(~F.coalesce(silent, F.lit(False)))


def session_days(spark, sf_dir):
    """Open sessions by day; a session ends when nothing is heard for seven days."""
    timed = _with_silence(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = activity.open_sessions(activity.gap_sessions(timed, "user_id", "ts"))
    return counted.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_open")


def stream_sessions(spark, sf_dir):
    """Sessions as a stream closes them, over several micro-batches."""
    work = _work_dir(spark)
    sent = _with_silence(spark, sf_dir).select(
        "event_id", "ts", "user_id", "event_type", F.lit(None).cast("double").alias("value"), F.lit("").alias("props"), "quarter"
    )
    arriving = _arriving(spark, sent, F.col("quarter"), work, QUARTERS).withWatermark("ts", "1 hour")
    streams.append_to(activity.gap_sessions(arriving, "user_id", "ts"), f"{work}/out", f"{work}/checkpoint").awaitTermination()
    told = spark.read.schema("user_id bigint, session_start timestamp, session_end timestamp, n_events bigint").parquet(f"{work}/out")
    return told.select("user_id", F.unix_micros("session_start").alias("first"), F.unix_micros("session_end").alias("over"), "n_events")


TTL_DAYS = 3


def stream_expiry(spark, sf_dir):
    """Histories with a time to live. A third of the users is silent in the middle of the time, and starts again empty."""
    work = _work_dir(spark)
    streams.use_keyed_state(spark)
    sent = _with_silence(spark, sf_dir).select(
        "event_id", "ts", "user_id", "event_type", F.lit(None).cast("double").alias("value"), F.lit("").alias("props"), "quarter"
    )
    arriving = _arriving(spark, sent, F.col("quarter"), work, QUARTERS)
    told = streams.expiring_history(arriving, ttl_ms=TTL_DAYS * 86_400_000)
    streams.write_batches(told, f"{work}/out", f"{work}/checkpoint", "append").awaitTermination()
    lines = spark.read.schema("user_id bigint, kind string, event_id bigint, recency int, batch int").parquet(f"{work}/out")
    last = lines.filter("kind <> 'untimed'").groupBy(F.col("user_id").alias("whose")).agg(
        F.max(F.struct("batch", (F.col("kind") == "kept").alias("alive"))).alias("last")
    )
    kept = lines.filter("kind = 'kept' and event_id is not null").join(last, F.col("user_id").eqNullSafe(F.col("whose")))
    kept = kept.filter(F.col("last.alive") & (F.col("batch") == F.col("last.batch")))
    evicted = lines.filter("kind = 'evicted'").groupBy("user_id", "kind").agg(F.count("*").cast("int").alias("recency"))
    apart = lines.filter("kind = 'untimed'").select("user_id", "kind", "event_id", F.lit(None).cast("int").alias("recency"))
    evicted = evicted.select("user_id", "kind", F.lit(None).cast("bigint").alias("event_id"), "recency")
    return kept.select("user_id", "kind", "event_id", "recency").unionByName(evicted).unionByName(apart)


def stream_closed_windows(spark, sf_dir):
    """Events per day as windows close, over micro-batches with planted late events and events without a time."""
    work = _work_dir(spark)
    streams.use_keyed_state(spark)
    # Every 13th event arrives one quarter after its time.
    part = F.least(F.col("quarter") + F.when(F.col("event_id") % 13 == 4, 1).otherwise(0), F.lit(QUARTERS - 1))
    events = _quartered(spark, sf_dir).withColumn("value", (F.col("event_id") % 5).cast("double")).withColumn("props", F.lit(""))
    sent = events.withColumn("part", part).select("event_id", "ts", "user_id", "event_type", "value", "props", "part")
    arriving = _arriving(spark, sent, F.col("part"), work, QUARTERS)
    counted = arriving.withColumn("points", F.col("value").cast("long"))
    told = streams.closing_windows(counted, "ts", "event_id", ["points"], 86_400, "1 hour")
    streams.write_batches(told, f"{work}/out", f"{work}/checkpoint", "append").awaitTermination()
    lines = spark.read.schema(
        "window_start bigint, kind string, event_id bigint, n_rows bigint, points bigint, batch int"
    ).parquet(f"{work}/out")
    day = F.date_format(F.timestamp_millis("window_start"), "yyyy-MM-dd").alias("day")
    merged = streams.merged_windows(lines, ["points"]).select(day, "kind", F.lit(None).cast("bigint").alias("event_id"), "n_rows", "points")
    listed = lines.filter("kind = 'late'").select(day, F.lit("late row").alias("kind"), "event_id", "n_rows", "points")
    return merged.unionByName(listed)


def stream_windows(spark, sf_dir):
    """Documents and findings per day of a stream, as the last micro-batch leaves them."""
    work = _work_dir(spark)
    scanned = streams.scanned_stream(_planted_stream(spark, sf_dir, work), CONFIG)
    windows = streams.finding_windows(scanned, "ts", lateness="10000 days")
    streams.write_batches(windows, f"{work}/out", f"{work}/checkpoint", "complete").awaitTermination()
    every = spark.read.schema(
        "window_start timestamp, n_docs bigint, n_invisible bigint, n_keyword bigint, batch int"
    ).parquet(f"{work}/out")
    last = every.agg(F.max("batch").alias("batch"))
    return every.join(F.broadcast(last), "batch").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n_docs", "n_invisible", "n_keyword"
    )


def stream_history(spark, sf_dir):
    """Scan results and their history rows written together per micro-batch; the newest three rows per session."""
    work = _work_dir(spark)
    scanned = streams.scanned_stream(_planted_stream(spark, sf_dir, work), CONFIG)
    streams.write_with_history(scanned, f"{work}/results", f"{work}/history", f"{work}/checkpoint").awaitTermination()
    schema = T.StructType.fromDDL("session_id string, doc_id bigint, filename string, ts timestamp, findings int")
    history = streams.committed_rows(spark, f"{work}/history", schema, f"{work}/results")
    newest = activity.latest(history, "session_id", [F.col("ts").desc(), F.col("doc_id").desc()], 3)
    return newest.select("session_id", "recency", "doc_id", "filename", "findings")


GAPPED = (
    "gapped as (select event_id, event_type, case when event_id % 11 <> 5 then user_id end as user_id, "
    "case when event_id % 17 <> 9 then ts end as ts from events)"
)


def _throttle_sql(where: str = "", source: str = "events", also: str = "") -> str:
    ok = f"(len(log) < {LIMIT} or t - log[-{LIMIT}] > {WINDOW * 1_000_000})"
    return f"""with recursive {also}e as (select event_id, user_id, event_type, epoch_us(ts) as t,
        row_number() over (partition by user_id order by ts, event_id) as rn from {source}{where}),
      r as (select user_id, rn, event_id, event_type, true as accepted, [t] as log from e where rn = 1
        union all select e.user_id, e.rn, e.event_id, e.event_type, {ok},
          case when {ok} then list_append(log, t)[-{LIMIT}:] else log end
        from r join e on e.user_id is not distinct from r.user_id and e.rn = r.rn + 1)"""


TIMED_THROTTLE = _throttle_sql(" where ts is not null", "gapped", f"{GAPPED}, ")
UNTIMED_EVENTS = " union all select event_id, user_id, null from gapped where ts is null"
QUARTERED = (
    f"{GAPPED}, timed as (select *, epoch_us(ts) as t from gapped), span as (select min(t) as low, max(t) as high from timed), "
    "quartered as (select *, coalesce(cast(floor((t - low) * 4.0 / (high - low + 1)) as int), 0) as quarter from timed, span)"
)
HEARD = (
    f"{QUARTERED}, heard as (select * from quartered where ts is null or not coalesce(user_id % 3 = 0, false) or "
    "quarter not in (1, 2))"
)
WEEK = 7 * 86_400_000_000
SESSIONS = (
    f"{HEARD}, marked as (select user_id, t, coalesce(t - lag(t) over own > {WEEK}, true) as begins from heard where t is not null "
    "window own as (partition by user_id order by t)), numbered as (select *, sum(begins::int) over (partition by user_id order by t) "
    f"as session from marked), sessions as (select user_id, min(t) as first, max(t) + {WEEK} as over_at, count(*) as n_events "
    "from numbered group by user_id, session)"
)
RANK = "row_number() over (partition by user_id order by ts desc, event_id desc) as recency"

QUERIES = {
    "throttle": (
        throttle,
        f"{TIMED_THROTTLE} select event_id, user_id, accepted from r{UNTIMED_EVENTS}",
    ),
    "throttle_with_exemptions": (
        throttle_with_exemptions,
        _throttle_sql(" where event_type <> 'click'")
        + " select event_type, accepted, count(*) as n from (select event_type, accepted from r union all "
        "select event_type, true from events where event_type = 'click') group by all",
    ),
    "recent_history": (
        recent_history, f"select user_id, {RANK}, event_id from events qualify recency <= 50"
    ),
    "dashboard_rows": (
        dashboard_rows, f"select user_id, {RANK}, event_id, event_type from events qualify recency <= 25"
    ),
    "active_sessions": (active_sessions, "select count(distinct user_id) as n_active from events"),
    "daily_activity": (
        daily_activity,
        "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all",
    ),
    "session_activity": (
        session_activity,
        f"{_throttle_sql()} select user_id, row_number() over (partition by user_id order by rn desc) as recency, event_id "
        "from r where accepted qualify recency <= 50",
    ),
    "stream_clean": (
        stream_clean,
        f"with {BODY}, {ISL}, {SEG}, {COUNTS}, built as (select doc_id, {CLEANED} from seg group by doc_id) select doc_id, "
        "cleaned, coalesce(removed_invisible, 0) as removed_invisible, coalesce(removed_keyword, 0) as removed_keyword "
        "from built left join counts using (doc_id)",
    ),
    "stream_throttle": (stream_throttle, f"{TIMED_THROTTLE} select event_id, user_id, accepted from r{UNTIMED_EVENTS}"),
    "stream_recent": (
        stream_recent,
        f"with {GAPPED} select user_id, row_number() over (partition by user_id order by ts desc nulls last, event_id desc) "
        "as recency, event_id from gapped qualify recency <= 50",
    ),
    "session_days": (
        session_days,
        f"with {SESSIONS} select strftime(day, '%Y-%m-%d') as day, count(*) as n_open from (select unnest(generate_series("
        "date_trunc('day', make_timestamp(first)), date_trunc('day', make_timestamp(over_at)), interval 1 day)) as day from sessions) group by day",
    ),
    "stream_sessions": (
        stream_sessions,
        f"with {SESSIONS} select user_id, first, over_at as over, n_events from sessions "
        "where over_at // 1000 <= (select max(t) // 1000 - 3600000 from heard)",
    ),
    "stream_expiry": (
        stream_expiry,
        f"with {HEARD}, batches as (select quarter, max(t) as latest from heard group by quarter), marks as ("
        "select q.quarter, (select max(latest) // 1000 - 3600000 from batches b where b.quarter < q.quarter) as mark "
        "from (select unnest(range(5)) as quarter) q), "
        "turns as (select user_id, quarter, max(t) as newest from heard where t is not null group by all), "
        f"earlier as (select *, max(newest) over past // 1000 + {TTL_DAYS * 86_400_000} as due from turns "
        "window past as (partition by user_id order by quarter rows between unbounded preceding and 1 preceding)), "
        "ends as (select user_id, e.quarter, coalesce(due <= mark, false) as ended from earlier e join marks using (quarter) "
        f"union all select user_id, 4, max(newest) // 1000 + {TTL_DAYS * 86_400_000} <= (select mark from marks where quarter = 4) "
        "from turns group by user_id), since as (select user_id, max(quarter) as q from ends where ended group by user_id), "
        "kept as (select h.user_id, event_id, row_number() over (partition by h.user_id order by t desc, event_id desc) as recency "
        "from heard h left join since s on s.user_id is not distinct from h.user_id where t is not null and "
        "h.quarter >= coalesce(s.q, 0) qualify recency <= 50) "
        "select user_id, 'kept' as kind, event_id, recency from kept union all "
        "select user_id, 'evicted', null, count(*) from ends where ended group by user_id union all "
        "select user_id, 'untimed', event_id, null from heard where t is null",
    ),
    "stream_closed_windows": (
        stream_closed_windows,
        f"with {QUARTERED}, sent as (select event_id, t, event_id % 5 as points, least(quarter + (event_id % 13 = 4)::int, 3) as part, "
        "t // 86400000000 * 86400000 as start from quartered), marks as (select p.part, "
        "(select max(t) // 1000 - 3600000 from sent s where s.part < p.part) as mark from (select unnest(range(5)) as part) p), "
        "judged as (select s.*, case when t is null then 'untimed' when start + 86400000 <= mark then 'late' "
        "when start + 86400000 <= (select mark from marks where part = 4) then 'closed' else 'open' end as kind "
        "from sent s join marks using (part)), lines as (select strftime(make_timestamp(start * 1000), '%Y-%m-%d') as day, * from judged) "
        "select day, kind, cast(null as bigint) as event_id, count(*) as n_rows, cast(sum(points) as bigint) as points "
        "from lines where kind <> 'open' group by day, kind union all "
        "select day, 'late row', event_id, 1, points from lines where kind = 'late'",
    ),
    "stream_windows": (
        stream_windows,
        f"with {BODY}, {COUNTS} select strftime(to_timestamp(1700000000 + doc_id * 3600) at time zone 'UTC', '%Y-%m-%d') as day, "
        "count(*) as n_docs, cast(sum(coalesce(removed_invisible, 0)) as bigint) as n_invisible, "
        "cast(sum(coalesce(removed_keyword, 0)) as bigint) as n_keyword from planted left join counts using (doc_id) group by 1",
    ),
    "stream_history": (
        stream_history,
        f"with {BODY}, {COUNTS} select source as session_id, row_number() over (partition by source order by doc_id desc) as recency, "
        "doc_id, filename, coalesce(removed_invisible, 0) + coalesce(removed_keyword, 0) as findings "
        "from planted left join counts using (doc_id) qualify recency <= 3",
    ),
}
