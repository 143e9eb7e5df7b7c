"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsa.session import checkpoint_dir

SLICE_BYTES = 1 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(frame: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: its lineage ends there and any executor can read it.

    The folder goes when the driver's JVM ends.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/palimpsa-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    back = spark.read.schema(frame.schema).parquet(path)
    back._step = path
    return back


def discard(*steps: DataFrame) -> None:
    """Delete settled steps. Only those that no step still to be computed reads, directly or not."""
    for step in steps:
        spark = step.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(step._step)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let the driver find exchanges that nothing refers to any more; their files on the executors go then."""
    spark.sparkContext._jvm.System.gc()


def whole(text: str = "text") -> Column:
    """The text itself; a missing one is empty."""
    return F.coalesce(F.col(text), F.lit(""))


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key written as text, modulo a small number; a missing key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text: one row at least, and always whole texts."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one run of UTF-8 bytes, and the bounds of each row in it (missing texts are empty)."""
    filled = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(filled.buffers()[1], np.int64, len(filled) + 1, filled.offset * 8)
    data = filled.buffers()[2]
    run = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return run[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits (one-to-one)."""
    out = values.astype(np.uint64, copy=True)
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Rows written in the order of ``order`` within ``group`` (missing values first), with two more columns.

    ``_at`` counts from 0 within the group and ``_n`` is the group's size. Ranges of (group, order) are sorted by as
    many tasks as there are, so a group of any size is dealt to many; only one line per group and task is summed.
    ``order`` must end in a column that tells equal rows apart where a third of the rows may be equal in the others.
    """
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = settle(placed.withColumn("_seq", F.monotonically_increasing_id()), name)
    task = F.shiftright("_seq", 33)
    lines = placed.groupBy(F.col(group).alias("_group"), task.alias("_task")).agg(
        F.min("_seq").alias("_low"), F.count("*").alias("_rows")
    )
    whole_group = Window.partitionBy("_group")
    earlier = whole_group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select(
        "_group", "_task", F.sum("_rows").over(whole_group).alias("_n"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_low")).alias("_shift"),
    )
    met = placed.join(lines, placed[group].eqNullSafe(lines["_group"]) & (task == lines["_task"]))
    return met.withColumn("_at", F.col("_seq") + F.col("_shift")).drop("_seq", "_group", "_task", "_shift")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Consecutive rows with equal keys, as dicts; a run goes on over the bounds of batches."""
    held, own = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != own:
                yield held
                held = []
            own = key
            held.append(row)
    if held:
        yield held


BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers some megabytes at a time, unless the session has a limit of its own.

    Without it a batch is 10,000 rows, which executor and worker both hold whole, for each Python step of a task.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def pooled(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text, whatever the batches: small ones are put together."""
    held, size = [], 0
    for part in text_slices(batches, text, limit):
        own = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
        if held and size + own > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield pa.concat_batches(held)


def tidy() -> None:
    """Give back what a task's arrays held: Python workers stay alive beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def pack(arrays: dict[str, np.ndarray | bytes]) -> bytes:
    """Named arrays as one compressed run of bytes; whole numbers take as few bytes as their largest needs."""
    parts, heads = [], []
    for name, values in arrays.items():
        if isinstance(values, bytes):
            kind, raw = "S", values
        else:
            if values.dtype.kind in "ui" and len(values) and values.min() >= 0:
                values = values.astype(np.min_scalar_type(int(values.max())))
            # Bytes of equal weight stand together, which compresses better.
            kind, raw = values.dtype.str, values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
        packed = pa.compress(raw, "zstd", asbytes=True)
        heads.append((name, kind, len(raw), len(packed)))
        parts.append(packed)
    head = json.dumps(heads).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(parts)


def unpack(body: bytes) -> dict[str, np.ndarray | bytes]:
    start = 4 + int.from_bytes(body[:4], "little")
    out = {}
    for name, kind, size, length in json.loads(body[4:start]):
        raw = pa.decompress(body[start : start + length], size, "zstd", asbytes=True)
        start += length
        if kind == "S":
            out[name] = raw
        else:
            width = np.dtype(kind).itemsize
            out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)
    return out
