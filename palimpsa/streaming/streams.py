"""The same column functions on streams, plus keyed state for throttling and history."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsa.operators.activity import HISTORY_LENGTH, REQUEST_LIMIT, WINDOW_SECONDS, admit
from palimpsa.operators.clean import clean
from palimpsa.operators.detect import DetectionConfig, add_findings, count_kind
from palimpsa.sources.documents import DOCUMENT_SCHEMA

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
HISTORY_TTL_MS = 7 * 24 * 60 * 60 * 1000
UNTIMED = int(np.iinfo(np.int64).min)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def document_stream(
    spark: SparkSession, path: str, files_per_trigger: int = 1000, schema: T.StructType = DOCUMENT_SCHEMA
) -> DataFrame:
    """Documents as they arrive, in micro-batches of bounded size."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events with a zoned time, which watermarks need."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def scanned_stream(documents: DataFrame, config: DetectionConfig) -> DataFrame:
    """Stateless per document, so the batch function serves as it is."""
    return add_findings(documents, config)


def cleaned_stream(documents: DataFrame, config: DetectionConfig) -> DataFrame:
    return clean(documents, config)


def finding_windows(scanned: DataFrame, time: str, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Documents and findings per time window; windows close once the watermark passes."""
    return (
        scanned.withWatermark(time, lateness)
        .groupBy(F.window(time, width).alias("w"))
        .agg(
            F.count("*").alias("n_docs"),
            F.sum(count_kind(F.col("findings"), "invisible")).alias("n_invisible"),
            F.sum(count_kind(F.col("findings"), "keyword")).alias("n_keyword"),
        )
        .select(F.col("w.start").alias("window_start"), "n_docs", "n_invisible", "n_keyword")
    )


def _times(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds, and which rows have a time at all."""
    return column.to_numpy().astype("datetime64[us]").astype(np.int64), column.notna().to_numpy()


# A keyed operator takes no missing number as its key, so keys go in as text.
CLIENT = "_client"
CLIENT_FIELD = T.StructField(CLIENT, T.StringType())


def _client(key: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-")).alias(CLIENT)


def _decoded(told: DataFrame, field: T.StructField) -> DataFrame:
    """The key's own values in place of the text."""
    value = F.when(F.col(CLIENT) != "-", F.expr(f"substr({CLIENT}, 2)")).cast(field.dataType).alias(field.name)
    return told.select(value, *[c for c in told.columns if c != CLIENT])


class ThrottleProcessor(StatefulProcessor):
    """State per key: at most ``limit`` admitted times. Micro-batch size bounds what is sorted."""

    def __init__(self, time: str, order: str, limit: int, window_seconds: int, ttl_ms: int | None) -> None:
        self.time, self.order, self.ttl_ms = time, order, ttl_ms
        self.limit, self.window = limit, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("admitted", "t long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # Two numbers per event of this key and micro-batch; nothing else of a row is kept.
        parts = [_times(f[self.time]) + (f[self.order].to_numpy(),) for f in rows]
        times, timed, numbers = (np.concatenate(column) for column in zip(*parts))
        # As in the batch form, an event without a time is neither admitted nor refused and leaves no trace.
        for start in range(0, int((~timed).sum()), 10_000):
            part = numbers[~timed][start : start + 10_000]
            yield pd.DataFrame({CLIENT: [key[0]] * len(part), self.order: part, "accepted": [None] * len(part)})
        times, numbers = times[timed], numbers[timed]
        sorted_by_time = np.lexsort((numbers, times))
        times, numbers = times[sorted_by_time], numbers[sorted_by_time]
        recent = [row[0] for row in self.log.get()]
        accepted, kept = admit(times, recent, self.limit, self.window)
        self.log.put([(int(t),) for t in kept])
        for start in range(0, len(times), 10_000):
            part = slice(start, start + 10_000)
            yield pd.DataFrame(
                {CLIENT: [key[0]] * len(times[part]), self.order: numbers[part], "accepted": accepted[part]}
            )

    def close(self) -> None:
        pass


def throttled_stream(
    events: DataFrame,
    key: str = "user_id",
    time: str = "ts",
    order: str = "event_id",
    limit: int = REQUEST_LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    ttl_ms: int | None = None,
) -> DataFrame:
    """Admission per event. Needs the RocksDB state store (``use_keyed_state``).

    With a continuous trigger over events as they happen, a ``ttl_ms`` of at least the window drops the logs of keys
    that have gone silent; it needs the processing-time mode, so a bounded trigger goes without.
    """
    schema = T.StructType([CLIENT_FIELD, events.schema[order], T.StructField("accepted", T.BooleanType())])
    processor = ThrottleProcessor(time, order, limit, window_seconds, ttl_ms)
    told = (
        events.select(_client(key), time, order)
        .groupBy(CLIENT)
        .transformWithStateInPandas(
            processor, schema, outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime"
        )
    )
    return _decoded(told, events.schema[key])


class HistoryProcessor(StatefulProcessor):
    """State per key: the newest entries, dropped when a key stays silent past the time to live."""

    def __init__(self, time: str, order: str, length: int, ttl_ms: int | None) -> None:
        self.time, self.order, self.length, self.ttl_ms = time, order, length, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "t long, id long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = [(int(t), int(i)) for t, i in self.entries.get()]
        for frame in rows:
            # Events without a time are the oldest, whatever is known of the others.
            times, timed = _times(frame[self.time])
            newest += list(zip(np.where(timed, times, UNTIMED).tolist(), frame[self.order].tolist()))
            newest = sorted(newest)[-self.length :]
        self.entries.put(newest)
        listed = newest[::-1]
        yield pd.DataFrame(
            {
                CLIENT: [key[0]] * len(listed),
                self.order: [i for _, i in listed],
                "recency": list(range(1, len(listed) + 1)),
            }
        )

    def close(self) -> None:
        pass


def history_stream(
    events: DataFrame,
    key: str = "user_id",
    time: str = "ts",
    order: str = "event_id",
    length: int = HISTORY_LENGTH,
    ttl_ms: int | None = HISTORY_TTL_MS,
) -> DataFrame:
    """The current history of every key that had events in the micro-batch.

    A time to live needs the processing-time mode, which keeps running empty
    micro-batches: use it with a continuous trigger, and ``None`` with a bounded one.
    """
    schema = T.StructType([CLIENT_FIELD, events.schema[order], T.StructField("recency", T.IntegerType())])
    told = (
        events.select(_client(key), time, order)
        .groupBy(CLIENT)
        .transformWithStateInPandas(
            HistoryProcessor(time, order, length, ttl_ms),
            schema,
            outputMode="Update",
            timeMode="None" if ttl_ms is None else "ProcessingTime",
        )
    )
    return _decoded(told, events.schema[key])


class WindowProcessor(StatefulProcessor):
    """State per part of a window: its counts, until the watermark passes its end; then they are told once and go."""

    def __init__(self, order: str, sums: list[str], width_ms: int) -> None:
        self.order, self.sums, self.width = order, sums, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"c{i} long" for i in range(len(self.sums) + 1))
        self.counts = handle.getValueState("counts", columns)

    def _told(self, key: Any, kind: str, orders: list, columns: list[list[int]]) -> pd.DataFrame:
        told = {CLIENT: [key[0]] * len(orders), "kind": [kind] * len(orders), self.order: orders}
        return pd.DataFrame(told | dict(zip(["n_rows", *self.sums], columns)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        start = None if key[0] == "-" else int(key[0][1:])
        end = None if start is None else start + self.width
        kind = "untimed" if start is None else "late" if end <= timerValues.getCurrentWatermarkInMs() else None
        if kind is not None:  # each such row is listed, no window is opened again
            for frame in rows:
                ones = [[1] * len(frame), *(frame[c].tolist() for c in self.sums)]
                yield self._told(key, kind, frame[self.order].tolist(), ones)
            return
        if self.counts.exists():
            counts = [int(c) for c in self.counts.get()]
        else:
            counts = [0] * (len(self.sums) + 1)
            self.handle.registerTimer(end)
        for frame in rows:
            counts = [c + n for c, n in zip(counts, [len(frame), *(int(frame[c].sum()) for c in self.sums)])]
        self.counts.update(tuple(counts))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        counts = [[int(c)] for c in self.counts.get()]
        self.counts.clear()
        yield self._told(key, "closed", [None], counts)

    def close(self) -> None:
        pass


def closing_windows(
    rows: DataFrame, time: str, order: str, sums: list[str], width_seconds: int = 86_400, lateness: str = "1 hour",
    parts: int = 16,
) -> DataFrame:
    """Row counts and sums per time window, told once when the watermark passes a window's end, and every late row.

    Columns: window_start (milliseconds), kind, ``order``, n_rows and ``sums``. ``closed`` lines are parts of windows,
    one at most for each part; ``merged_windows`` adds them up. ``late`` lines are rows whose window had ended when
    they came: the watermark is the latest time of earlier micro-batches less ``lateness``. ``untimed`` lines are rows
    without a time. State holds open windows only, ``parts`` for each, so a window with most rows is many tasks.
    Append mode; needs the RocksDB state store (``use_keyed_state``).
    """
    width = width_seconds * 1000
    start = F.floor(F.unix_millis(time) / width) * width
    # The time itself is left out, else the engine would drop late rows unseen before they get here.
    thin = rows.withWatermark(time, lateness).select(
        start.cast("long").alias("window_start"), F.pmod(F.xxhash64(order), F.lit(parts)).alias("part"), order, *sums
    ).withColumn(CLIENT, _client("window_start"))
    schema = T.StructType(
        [
            CLIENT_FIELD, T.StructField("kind", T.StringType()), rows.schema[order],
            *[T.StructField(c, T.LongType()) for c in ("n_rows", *sums)],
        ]
    )
    told = thin.groupBy(CLIENT, "part").transformWithStateInPandas(
        WindowProcessor(order, sums, width), schema, outputMode="Append", timeMode="EventTime"
    )
    return _decoded(told, T.StructField("window_start", T.LongType()))


def merged_windows(told: DataFrame, sums: list[str]) -> DataFrame:
    """Closed windows whole, and the number and sums of late and untimed rows by the window that they missed."""
    return told.groupBy("window_start", "kind").agg(*[F.sum(c).alias(c) for c in ("n_rows", *sums)])


# Stands for a missing number of an event; a column of numbers with gaps would come as floats.
UNNUMBERED = UNTIMED
# Later times than the year 2115 count as that for the watermark: twice as far is the last that pandas can hold.
AHEAD_DAYS = 53_000
AHEAD = AHEAD_DAYS * 86_400_000_000


PART = "_part"
LINES = 50_000  # lines of one output frame
STORED = "clients string, owner binary, entries binary"


class Histories:
    """The newest entries of each key of a part: keys, and time and number of every entry with its key's index."""

    def __init__(self, length: int, ttl_ms: int, stored: tuple[str, bytes, bytes] | None) -> None:
        self.length, self.ttl = length, ttl_ms
        clients, owner, entries = stored or ("[]", b"", b"")
        self.clients: list[str] = json.loads(clients)
        self.owner = np.frombuffer(owner, np.int64)
        self.entries = np.frombuffer(entries, np.int64).reshape(-1, 2)
        self.index = {client: i for i, client in enumerate(self.clients)}

    def stored(self) -> tuple[str, bytes, bytes]:
        """Keys that still have entries, in the order of their indexes."""
        used, owner = np.unique(self.owner, return_inverse=True)
        clients = [self.clients[i] for i in used.tolist()]
        return json.dumps(clients), owner.astype(np.int64).tobytes(), self.entries.tobytes()

    def ends(self) -> np.ndarray:
        """Milliseconds at which each key's history is over; the least number for a key without one."""
        newest = np.full(len(self.clients), UNTIMED)
        np.maximum.at(newest, self.owner, self.entries[:, 0])
        return np.where(newest == UNTIMED, UNTIMED, newest // 1000 + self.ttl)

    def expire(self, now: int) -> np.ndarray:
        """Take out the histories that are over at ``now``, and tell the indexes of their keys."""
        over = self.ends() <= now
        gone = over[self.owner]
        ended = np.unique(self.owner[gone])
        self.owner, self.entries = self.owner[~gone], self.entries[~gone]
        return ended

    def indexes(self, clients: pd.Series) -> np.ndarray:
        codes, names = pd.factorize(clients)
        for name in names:
            if self.index.setdefault(name, len(self.clients)) == len(self.clients):
                self.clients.append(name)
        return np.array([self.index[name] for name in names], np.int64)[codes]

    def add(self, owner: np.ndarray, times: np.ndarray, numbers: np.ndarray) -> None:
        owner = np.concatenate([self.owner, owner])
        entries = np.concatenate([self.entries, np.stack([times, numbers], axis=1)])
        order = np.lexsort((entries[:, 1], entries[:, 0], owner))
        owner, entries = owner[order], entries[order]
        kept = self._ranks(owner) <= self.length
        self.owner, self.entries = owner[kept], entries[kept]

    @staticmethod
    def _ranks(owner: np.ndarray) -> np.ndarray:
        """Of sorted entries, each one's place from its key's newest, which is 1."""
        return np.searchsorted(owner, owner, side="right") - np.arange(len(owner))

    def of(self, heard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, number and rank of all entries of the keys ``heard``, a key's newest first."""
        picked = np.flatnonzero(np.isin(self.owner, heard))[::-1]
        return self.owner[picked], self.entries[picked, 1], self._ranks(self.owner)[picked]


def _expiring(order: str, length: int, ttl_ms: int):
    """State per part of the keys: their newest entries, and a timeout at the first moment at which one is over.

    All keys of a part go through one call, as arrays.
    """

    def told(known: Histories, kind: str, owner: np.ndarray, numbers: np.ndarray, ranks: np.ndarray | None = None):
        absent = np.zeros(len(owner), np.int64)
        ranks = absent if ranks is None else ranks
        for start in range(0, len(owner), LINES):
            part = slice(start, start + LINES)
            yield pd.DataFrame(
                {
                    CLIENT: [known.clients[i] for i in owner[part].tolist()], "kind": kind,
                    order: pd.arrays.IntegerArray(numbers[part], numbers[part] == UNNUMBERED),
                    "recency": pd.arrays.IntegerArray(ranks[part].astype(np.int32), ranks[part] == 0),
                }
            )

    def remember(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        known = Histories(length, ttl_ms, tuple(state.get) if state.exists else None)
        unnumbered = lambda owner: np.full(len(owner), UNNUMBERED)
        ended = known.expire(now)
        yield from told(known, "evicted", ended, unnumbered(ended))
        heard = np.zeros(0, np.int64)
        for frame in () if state.hasTimedOut else rows:
            owner, timed = known.indexes(frame[CLIENT]), frame["_timed"].to_numpy(bool)
            numbers = frame[order].to_numpy(np.int64)
            yield from told(known, "untimed", owner[~timed], numbers[~timed])
            known.add(owner[timed], frame["_micros"].to_numpy(np.int64)[timed], numbers[timed])
            heard = np.union1d(heard, owner)
        # What came too late to be remembered is over at once.
        known.expire(now)
        owner, numbers, ranks = known.of(heard)
        yield from told(known, "kept", owner, numbers, ranks)
        empty = np.setdiff1d(heard, owner)
        yield from told(known, "kept", empty, unnumbered(empty))
        if len(known.owner):
            ends = known.ends()
            state.update(known.stored())
            # Times out once the watermark is later than this.
            state.setTimeoutTimestamp(max(int(ends[ends > now].min()) - 1, 1))
        elif state.exists:
            state.remove()

    return remember


def expiring_history(
    events: DataFrame, key: str = "user_id", time: str = "ts", order: str = "event_id", length: int = HISTORY_LENGTH,
    ttl_ms: int = HISTORY_TTL_MS, lateness: str = "1 hour", parts: int = 1024,
) -> DataFrame:
    """The current history of every key with events in the micro-batch, and every history that ends.

    Columns: key, kind, ``order``, recency. A micro-batch's ``kept`` lines are the whole history of a key (one line
    without ``order`` when nothing is left). A key whose newest event is ``ttl_ms`` older than the watermark is
    ``evicted`` by an event-time timeout, whether or not it is heard of again; if so, it starts empty. Events without a
    time are ``untimed`` lines and in no history. Runs with any trigger; the RocksDB state store (``use_keyed_state``)
    keeps the histories out of the heap.

    Keys are dealt to ``parts``, each with one state and one call in a micro-batch, so calls are bounded and a key costs
    array work only. A part's state is written whole, 24 bytes an entry: live keys / ``parts`` * ``length`` entries.
    """
    schema = T.StructType(
        [CLIENT_FIELD, T.StructField("kind", T.StringType()), events.schema[order], T.StructField("recency", T.IntegerType())]
    )
    micros = F.unix_micros(time)
    # The engine drops rows whose watermarked time is late before they are seen here. So the watermark is kept on a time
    # moved ahead, with a lateness longer by as much: it is the same, and no row is late. Times before 1970 never move it.
    ahead = F.when(micros >= 0, F.timestamp_micros(F.least(micros, F.lit(AHEAD)) + F.lit(AHEAD)))
    timed = events.select(
        _client(key), F.coalesce(micros, F.lit(0)).alias("_micros"), micros.isNotNull().alias("_timed"),
        F.coalesce(order, F.lit(UNNUMBERED)).alias(order), ahead.alias("_ahead"),
    ).withWatermark("_ahead", f"{lateness} {AHEAD_DAYS} days")
    told = timed.withColumn(PART, F.pmod(F.xxhash64(CLIENT), F.lit(parts))).groupBy(PART).applyInPandasWithState(
        _expiring(order, length, ttl_ms), schema, STORED, "append", GroupStateTimeout.EventTimeTimeout
    )
    return _decoded(told, events.schema[key])


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


COMMIT_SCHEMA = "batch bigint, attempt string"


def _commit_folder(results_path: str) -> str:
    return f"{results_path}/_commits"  # readers of files pass over names with a first underscore


def _is_committed(spark: SparkSession, results_path: str, number: int) -> bool:
    entries = spark._jvm.org.apache.hadoop.fs.Path(f"{_commit_folder(results_path)}/{number}/part-*")
    found = entries.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(entries)
    return found is not None and len(found) > 0


def _commit(spark: SparkSession, results_path: str, number: int, attempt: str) -> None:
    """One row in one file, which appears by a rename."""
    entry = spark.createDataFrame([(number, attempt)], COMMIT_SCHEMA).coalesce(1)
    entry.write.mode("overwrite").parquet(f"{_commit_folder(results_path)}/{number}")


def _history(written: DataFrame, session: str, time: str, filename: str) -> DataFrame:
    return written.select(
        F.col(session).alias("session_id"), "doc_id", F.col(filename).alias("filename"), F.col(time).alias("ts"),
        F.size("findings").alias("findings"),
    )


def write_with_history(
    scanned: DataFrame, results_path: str, history_path: str, checkpoint: str, session: str = "source",
    time: str = "ts", filename: str = "filename",
) -> StreamingQuery:
    """Results and history rows of one micro-batch together, for readers that come at any time.

    Each attempt at a batch writes both into folders of its own, and only then a line of the commit list that names it,
    so ``committed_rows`` sees both or neither. A batch that has its line is never written again, whatever is replayed;
    what an attempt without one left stays on disk and is not read. History comes from the results that were written, so
    findings are computed once; its rows carry time and filename, which the newest-N rule needs.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, attempt = batch.sparkSession, uuid.uuid4().hex
        if _is_committed(spark, results_path, number):
            return
        path = f"{results_path}/batch={number}/attempt={attempt}"
        batch.write.parquet(path)
        written = spark.read.schema(batch.schema).parquet(path)
        _history(written, session, time, filename).write.parquet(f"{history_path}/batch={number}/attempt={attempt}")
        _commit(spark, results_path, number, attempt)

    return (
        scanned.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def committed_rows(spark: SparkSession, path: str, schema: T.StructType, results_path: str) -> DataFrame:
    """Rows of results or history of the committed batches, with ``batch``; none before the first is committed.

    The commit list is read before the files are listed, so every batch that it names is there in whole.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{_commit_folder(results_path)}/*/part-*")
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    if listed is None or len(listed) == 0:
        return spark.createDataFrame([], T.StructType([*schema, T.StructField("batch", T.LongType())]))
    commits = spark.read.schema(COMMIT_SCHEMA).parquet(*[entry.getPath().toString() for entry in listed])
    marks = [T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType())]
    rows = spark.read.schema(T.StructType([*schema, *marks])).parquet(path)
    return rows.join(commits, ["batch", "attempt"], "left_semi").select(*schema.names, "batch")


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Each micro-batch under its number; a repeated one overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
