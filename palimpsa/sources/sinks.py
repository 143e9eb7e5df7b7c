"""Writers: nested results, cleaned corpora and quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsa.operators.validate import running_total, split_quarantine
from palimpsa.session import written

PACK_BYTES = 128 * 1024 * 1024
TASK_BYTES = 32 * 1024 * 1024


def clean_name(filename: Column) -> Column:
    return F.concat(F.lit("clean_"), filename)


def with_output_names(cleaned: DataFrame, key: str = "doc_id") -> DataFrame:
    """``clean_<filename>`` under a folder per key: equal names never collide, and no shuffle is spent on it."""
    name = clean_name(F.col("filename"))
    return cleaned.withColumn("out_name", name).withColumn("out_path", F.concat_ws("/", F.col(key), name))


def nested_result(scanned: DataFrame) -> DataFrame:
    """One struct per document, as a result record would be sent."""
    return scanned.select(
        "doc_id",
        F.struct(
            "filename",
            "file_type",
            F.length("text").alias("original_length"),
            F.filter("findings", lambda f: f["kind"] == "invisible").alias("invisible_chars"),
            F.filter("findings", lambda f: f["kind"] == "keyword").alias("keyword_matches"),
            F.size("findings").alias("total_findings"),
            (F.size("findings") == 0).alias("clean"),
            F.struct("score", "signals").alias("style"),
        ).alias("result"),
    )


def write_results(results: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = results.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_checked(checked: DataFrame, path: str) -> None:
    """Accepted and quarantined rows in one pass, kept apart by a partition column."""
    checked.write.mode("overwrite").partitionBy("status").parquet(path)


def write_split(checked: DataFrame, ok_path: str, quarantine_path: str) -> None:
    accepted, refused = split_quarantine(checked)
    accepted.drop("status", "message").write.mode("overwrite").parquet(ok_path)
    refused.write.mode("overwrite").parquet(quarantine_path)


def write_packs(
    documents: DataFrame, path: str, group: str, order: str, text: str = "text", pack_bytes: int = PACK_BYTES
) -> None:
    """Texts as files by ``group``, each of about ``pack_bytes``, whatever the size of a group or of its texts.

    A text goes where it begins in the run of its group's bytes, in the order of ``order`` (which tells the texts of a
    group apart): a pack goes over its size by less than its last text. Sizes are summed on thin rows; texts move once
    to meet their pack's number and once to their file, and no task holds a group. A task writes small packs one after
    another, up to about ``TASK_BYTES``, and moves them to their place itself: neither shuffle blocks nor the driver's
    share grow with the square or the number of packs.
    """
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1
    thin = documents.select(F.col(group).alias("_group"), F.col(order).alias("_order"), size.cast("long").alias("_size"))
    placed = running_total(thin, "_group", "_order", "_size", "_end")
    pack = F.floor((F.col("_end") - F.col("_size")) / pack_bytes).cast("long")
    packs = written(placed.select("_group", "_order", pack.alias("pack")), "packs")
    same = F.col(group).eqNullSafe(F.col("_group")) & F.col(order).eqNullSafe(F.col("_order"))
    dealt = documents.join(packs, same).select(group, "pack", F.col(text).alias("value"))
    files = packs.select("_group", "pack").distinct().count()
    cores = documents.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(files, max(cores, -(-files * pack_bytes // TASK_BYTES))))
    writer = dealt.repartition(tasks, group, "pack").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(group, "pack").text(path)
