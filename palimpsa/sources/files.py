"""Raw files: bytes to text, with the charset fallback done by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsa.operators.validate import MAX_FILE_BYTES
from palimpsa.sources.documents import file_label, file_route

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS = 64


def bytes_to_text(content: Column) -> Column:
    """UTF-8 when valid (a byte order mark stays in the text), else Latin-1, which never fails."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File metadata only: content is pruned, so limits can be applied before reading it."""
    return _files(spark, path).select("path", "filename", "bytes")


def _files(spark: SparkSession, path: str) -> DataFrame:
    # By default every folder is listed by a task of its own, up to 10,000 at a time; here a task takes many folders.
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(LISTING_TASKS))
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    finally:
        spark.conf.set(LISTING, before)
    return raw.select(
        "path",
        F.substring_index("path", "/", -1).alias("filename"),
        F.col("length").alias("bytes"),
        "content",
    )


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Text, label and status per file.

    The byte cap is a filter on ``length``, which this source pushes down: an
    oversized file is reported without being opened.
    """
    found = _files(spark, path)  # the folders are listed once
    fit = found.filter(F.col("bytes") <= max_bytes)
    route = file_route(F.col("filename"))
    readable = route.isin("text", "unknown_as_text")
    read = fit.select(
        "path",
        "filename",
        "bytes",
        file_label(F.col("filename")).alias("file_type"),
        F.when(readable, bytes_to_text(F.col("content"))).alias("text"),
        F.when(readable, "ok").otherwise("error").alias("status"),
        F.when(~readable, F.concat(F.lit("no_reader_for_"), route)).alias("message"),
    )
    too_big = found.select("path", "filename", "bytes").filter(F.col("bytes") > max_bytes)
    refused = too_big.select(
        "path",
        "filename",
        "bytes",
        file_label(F.col("filename")).alias("file_type"),
        F.lit(None).cast("string").alias("text"),
        F.lit("error").alias("status"),
        F.lit("too_many_bytes").alias("message"),
    )
    return read.unionByName(refused)
