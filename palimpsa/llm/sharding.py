"""Shards of near equal bytes by sampled splitters: size-weighted key samples, quantile bounds, ranges, subdivision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsa.llm.common import settle, whole

SHARDS = 16
SAMPLES_PER_RANGE = 16
RANGES_PER_SHARD = 64
MAX_ROUNDS = 4


def _bounds(sample: pd.DataFrame, pieces: int) -> list[tuple[int, int]]:
    """Quantile bounds of a sorted, weighted sample. A bound begins a group, unless the group fills more than a range."""
    if sample.empty or pieces < 2:
        return []
    reached = sample["_mass"].cumsum().to_numpy()
    goals = np.arange(1, pieces) * (reached[-1] / pieces)
    picked = sample.iloc[np.minimum(np.searchsorted(reached, goals), len(sample) - 1)]
    out, last = [], None
    for group, rank in zip(picked["_group"], picked["_rank"], strict=True):
        out.append((int(group), int(rank) if group == last else np.iinfo(np.int64).min))
        last = group
    return sorted(set(out))


def _placer(bounds: list[tuple[int, int]]):
    """A column function: the number of bounds at or below (group, rank)."""
    groups = np.array([b[0] for b in bounds], np.int64)
    ranks = np.array([b[1] for b in bounds], np.int64)

    def place(group: pd.Series, rank: pd.Series) -> pd.Series:
        own, tie = group.to_numpy(np.int64), rank.to_numpy(np.int64)
        low, high = np.searchsorted(groups, own, "left"), np.searchsorted(groups, own, "right")
        at = low.copy()
        for value in np.unique(own[high > low]):
            rows = own == value
            first, stop = np.searchsorted(groups, value, "left"), np.searchsorted(groups, value, "right")
            at[rows] = first + np.searchsorted(ranks[first:stop], tie[rows], "right")
        return pd.Series(at)

    return F.pandas_udf(place, "long")


def _draw(thin: DataFrame, mass: int, wanted: int) -> pd.DataFrame:
    """About ``wanted`` keys, each row with a chance in proportion to its size (always when it is larger than a step)."""
    step = max(1.0, mass / wanted)
    chance = F.least(F.lit(1.0), F.col("size") / F.lit(step))
    draw = F.pmod(F.xxhash64("_group", "_rank", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = thin.filter(draw < chance).select("_group", "_rank", F.greatest("size", F.lit(step)).alias("_mass"))
    return rows.toPandas().sort_values(["_group", "_rank"], kind="stable").reset_index(drop=True)


def _measured(thin: DataFrame, bounds: list[tuple[int, int]]) -> tuple[DataFrame, pd.DataFrame]:
    """Rows with their range, and the bytes and rows of each range."""
    placed = thin.withColumn("_range", _placer(bounds)("_group", "_rank"))
    sums = placed.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return placed, sums.toPandas().sort_values("_range", ignore_index=True)


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    key: str = "doc_id",
    text: str = "text",
    ranges_per_shard: int = RANGES_PER_SHARD,
) -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus one (a missing text has none). Shards get nearly equal sums of sizes: rows
    stand in the order (hash of the text, hash of the key), so equal texts stand together, and a shard takes a
    stretch of that order. A group of equal texts stays in one shard unless it fills a range by itself
    (``1 / (shards * ranges_per_shard)`` of all bytes) and lies on a shard's bound. ``slot`` counts from 0 in each shard.
    Rows that repeat key and text are separate rows with slots of their own; a missing key is a key like others.
    An empty table gives an empty table; other columns are ignored.

    Only the sample of keys (a fixed number whatever the input), one sum per range and one bound per shard reach
    the driver. Ranges that hold more than twice their share are sampled and divided again.
    """
    value = whole(text)
    thin = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.xxhash64(value).alias("_group"),
        # The low ten bits only tell rows apart that repeat their key, so that a hot one can be divided too.
        (
            F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).bitwiseAND(F.lit(-1024))
            + F.monotonically_increasing_id() % 1024
        ).alias("_rank"),
    )
    spark = docs.sparkSession
    thin = settle(thin, "sizes")
    total = thin.agg(F.sum("size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    bounds = _bounds(_draw(thin, total, ranges * SAMPLES_PER_RANGE), ranges) if total else []
    placed, sums = _measured(thin, bounds)
    share = total / ranges
    for _ in range(MAX_ROUNDS):
        over = sums[(sums["bytes"] > 2 * share) & (sums["rows"] > 1)]
        if over.empty:
            break
        full = F.broadcast(spark.createDataFrame(over[["_range"]], "_range long"))
        mass = int(over["bytes"].sum())
        sample = _draw(placed.join(full, "_range", "left_semi"), mass, min(len(over) * 64, ranges * SAMPLES_PER_RANGE))
        bounds = sorted({*bounds, *_bounds(sample, max(2, int(2 * mass / share)))})
        placed, sums = _measured(thin, bounds)
    sums["_bytes_before"] = sums["bytes"].cumsum() - sums["bytes"]
    sums["_rows_before"] = sums["rows"].cumsum() - sums["rows"]
    starts = spark.createDataFrame(
        sums[["_range", "_bytes_before", "_rows_before"]], "_range long, _bytes_before long, _rows_before long"
    )
    order = Window.partitionBy("_range").orderBy("_group", "_rank")
    same = Window.partitionBy("_range", "_group")
    # A range is bounded, so are the groups within it; the window needs one exchange of thin rows.
    stood = (
        placed.withColumns(
            {
                "_end": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                "_nth": F.row_number().over(order),
            }
        )
        .withColumns({"_first": F.min(F.col("_end") - F.col("size")).over(same), "_last": F.max("_end").over(same)})
        .join(F.broadcast(starts), "_range")
    )
    small = F.col("_last") - F.col("_first") <= F.lit(max(1.0, total / ranges))
    middle = F.when(small, (F.col("_first") + F.col("_last")) / 2).otherwise(F.col("_end") - F.col("size") / 2)
    at = F.floor((F.col("_bytes_before") + middle) * shards / F.lit(float(max(1, total))))
    stood = stood.select(
        "_key", "size", "text_crc32", F.least(at, F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("_rows_before") + F.col("_nth") - 1).alias("_index"),
    )
    stood = settle(stood, "stood")
    begins = stood.groupBy("shard").agg(F.min("_index").alias("_begin"))
    return stood.join(F.broadcast(begins), "shard").select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_index") - F.col("_begin")).alias("slot")
    )
