"""Frequent items by group from summaries of fixed size that can be merged without reading texts again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summarize(counts: DataFrame, part: str, group: str, item: str, n: str, size: int) -> DataFrame:
    """The ``size`` largest counts of each (part, group), and the most that any other item has there.

    One line per kept item, with ``left_out``: no item that is not kept occurs more often than that in the part.
    ``counts`` has one row per (part, group, item); ties go by item. A part is a day or a micro-batch: its
    summary is written once and stays as it is.
    """
    largest = Window.partitionBy(part, group).orderBy(F.col(n).desc(), F.col(item))
    ranked = counts.withColumn("_rank", F.row_number().over(largest)).filter(F.col("_rank") <= size + 1)
    bound = F.sum(F.when(F.col("_rank") == size + 1, F.col(n)).otherwise(0)).over(Window.partitionBy(part, group))
    return ranked.withColumn("left_out", bound).filter(F.col("_rank") <= size).drop("_rank")


def merge(summaries: DataFrame, part: str, group: str, item: str, n: str) -> DataFrame:
    """Lower and upper bounds of each kept item's count over all parts, and ``missed`` for items that no part kept.

    An item occurs at least as often as the parts that kept it say, and at most that often plus what the other parts
    left out. Only ``size`` lines for each part and group are read.
    """
    parts = summaries.groupBy(part, group).agg(F.max("left_out").alias("left_out"))
    whole = parts.groupBy(F.col(group).alias("_group")).agg(F.sum("left_out").alias("missed"))
    kept = summaries.groupBy(group, item).agg(F.sum(n).alias("lower"), F.sum("left_out").alias("_own"))
    met = kept.join(whole, F.col(group).eqNullSafe(F.col("_group")))
    upper = (F.col("lower") + F.col("missed") - F.col("_own")).alias("upper")
    return met.select(group, item, "lower", upper, "missed")
