"""Recent history per key and a sliding-log throttle, over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# History length, dashboard length, request limit and its window, and how long a silent session lives.
HISTORY_LENGTH = 50
DASHBOARD_LENGTH = 25
REQUEST_LIMIT = 10
WINDOW_SECONDS = 60
SESSION_GAP = "7 days"


def latest(events: DataFrame, key: str, order: list[Column], n: int = HISTORY_LENGTH) -> DataFrame:
    """Newest ``n`` events per key with their rank.

    The rank test is a limit that Spark also applies before the shuffle, so a
    hot key sends at most ``n`` rows per input partition.
    """
    ranked = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("recency", F.row_number().over(ranked)).filter(F.col("recency") <= n)


def active_keys(events: DataFrame, key: str) -> DataFrame:
    return events.agg(F.count_distinct(key).alias("n_active"))


def gap_sessions(events: DataFrame, key: str, time: str, gap: str = SESSION_GAP) -> DataFrame:
    """Sessions per key: runs of events of which none is more than ``gap`` after the one before it.

    Columns: key, session_start, session_end (the last event's time plus the gap, when the session is over), n_events.
    Partial sessions are merged before the shuffle. A missing key is a key; events without a time are in no session.
    On a stream, give ``time`` a watermark: a session is told once, when the watermark passes its end.
    """
    counted = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n_events"))
    return counted.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def open_sessions(sessions: DataFrame) -> DataFrame:
    """How many sessions are open on each day, from the day of their start to that of their end."""
    first, last = F.to_date("session_start"), F.to_date("session_end")
    days = sessions.select(F.explode(F.sequence(first, last)).alias("day"))
    return days.groupBy("day").agg(F.count("*").alias("n_open"))


def admit(times: np.ndarray, recent: list[int], limit: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Which sorted times are admitted, given the last admitted ones; also the new last ones.

    Rejected times are not recorded. Runs of rejections are skipped by binary
    search, so the loop is as long as the number of admissions.
    """
    accepted = np.zeros(len(times), dtype=bool)
    log = list(recent)
    i = 0
    while i < len(times):
        if len(log) >= limit:
            i = max(i, int(np.searchsorted(times, log[-limit] + window, side="right")))
            if i >= len(times):
                break
        accepted[i] = True
        log.append(int(times[i]))
        i += 1
    return accepted, log[-limit:]


def _with_bursts(events: DataFrame, key: str, window: int) -> DataFrame:
    """Add a burst number per key: a pause longer than the window empties the log.

    Such a pause always crosses a boundary of window-sized slots, so bursts are
    found on one row per key and slot instead of by ordering all events of a key.
    """
    slots = events.groupBy(key, "_slot").agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count("*").alias("_n")
    )
    order = Window.partitionBy(key).orderBy("_slot")
    opened = slots.withColumn("_gap", F.col("_first") - F.lag("_last").over(order)).withColumn(
        "_burst",
        F.count_if(F.col("_gap").isNull() | (F.col("_gap") > window)).over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    whole = Window.partitionBy(key, "_burst")
    sized = opened.select(key, "_slot", "_burst", F.sum("_n").over(whole).alias("_burst_n"))
    return events.join(sized, [key, "_slot"])


def throttle(
    events: DataFrame,
    key: str,
    time: str,
    order: str,
    limit: int = REQUEST_LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    exempt: Column | None = None,
) -> DataFrame:
    """Events with ``accepted``: at most ``limit`` admissions per key in any sliding window.

    Admission depends on earlier admissions, so each burst of a key is one ordered pass over its times; bursts are
    independent and spread over tasks. A burst of at most ``limit`` events is admitted whole: no window inside it can
    hold more. The pass sees key, burst, time and ``order`` only, keeps ``limit`` times and sends back admitted events,
    which join the full rows by ``order`` (it tells the events of a key apart), so wide rows of a hot key never meet.
    Events without a key are one client; those without a time have a null ``accepted``. ``exempt`` events are admitted
    and leave no trace.
    """
    window = window_seconds * 1_000_000
    free = F.coalesce(exempt, F.lit(False)) if exempt is not None else F.lit(False)
    named = events.withColumns(
        {
            "_client": F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-")),
            "_t": F.unix_micros(F.col(time).cast("timestamp")),
        }
    )
    timed = named.filter(~free & F.col("_t").isNotNull()).select(
        "_client", "_t", F.col(order).alias("_order"), F.floor(F.col("_t") / window).alias("_slot")
    )
    burst = _with_bursts(timed, "_client", window)
    calm = burst.filter(F.col("_burst_n") <= limit).select("_client", "_order")
    busy = burst.filter(F.col("_burst_n") > limit).select("_client", "_burst", "_t", "_order")
    ordered = busy.repartition("_client", "_burst").sortWithinPartitions("_client", "_burst", "_t", "_order")
    schema = busy.select("_client", "_order").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, []
        for frame in batches:
            times = frame["_t"].to_numpy()
            keys, numbers = frame["_client"].to_numpy(), frame["_burst"].to_numpy()
            accepted = np.zeros(len(frame), dtype=bool)
            fresh = (keys[1:] != keys[:-1]) | (numbers[1:] != numbers[:-1])
            edges = [0, *(np.flatnonzero(fresh) + 1).tolist(), len(frame)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                group = (keys[start], numbers[start])
                if group != current:
                    current, recent = group, []
                accepted[start:end], recent = admit(times[start:end], recent, limit, window)
            yield frame.loc[accepted, ["_client", "_order"]]

    admitted = calm.unionByName(ordered.mapInPandas(run, schema)).withColumns(
        {"_admitted": F.lit(True), "_whose": F.col("_client"), "_which": F.col("_order")}
    ).select("_whose", "_which", "_admitted")
    same = (F.col("_client") == F.col("_whose")) & F.col(order).eqNullSafe(F.col("_which"))
    judged = named.join(admitted, same, "left")
    verdict = F.when(free, True).when(F.col("_t").isNotNull(), F.coalesce("_admitted", F.lit(False)))
    return judged.select(*events.columns, verdict.alias("accepted"))
