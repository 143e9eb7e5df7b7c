"""Input limits as data: violations, quarantine, batch caps and byte budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsa.functions.texts import is_blank
from palimpsa.session import written

# Size limits.
MAX_TEXT_CHARS = 200_000
MAX_CODE_CHARS = 100_000
MAX_FILENAME_CHARS = 255
MAX_FILE_BYTES = 20 * 1024 * 1024
MAX_BATCH_FILES = 20
MAX_BATCH_BYTES = 50 * 1024 * 1024


def violations(
    text: Column, filename: Column | None = None, max_chars: int = MAX_TEXT_CHARS, max_bytes: int = MAX_FILE_BYTES
) -> Column:
    """Codes of the limits a document breaks; empty when it is acceptable."""
    tests = [
        F.when(F.length(text) > max_chars, "too_long"),
        F.when(is_blank(text), "blank"),
        F.when(F.octet_length(text) > max_bytes, "too_many_bytes"),
    ]
    if filename is not None:
        tests.append(F.when(F.length(filename) > MAX_FILENAME_CHARS, "filename_too_long"))
    return F.array_compact(F.array(*tests))


def code_violations(source: Column, max_chars: int | None = MAX_CODE_CHARS) -> Column:
    """Codes of the limits a source text breaks; with no ``max_chars`` none is too long."""
    tests = [] if max_chars is None else [F.when(F.length(source) > max_chars, "too_long")]
    return F.array_compact(F.array(*tests, F.when(is_blank(source), "blank")))


def with_status(documents: DataFrame, broken: Column) -> DataFrame:
    """Errors are data: every row keeps its place with a status and a message."""
    return (
        documents.withColumn("_broken", broken)
        .withColumn("status", F.when(F.size("_broken") > 0, "error").otherwise("ok"))
        .withColumn("message", F.when(F.size("_broken") > 0, F.array_join("_broken", ",")))
        .drop("_broken")
    )


def split_quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter(F.col("status") == "ok"), checked.filter(F.col("status") == "error")


def oversized_batches(files: DataFrame, batch: str = "batch", cap: int = MAX_BATCH_FILES) -> DataFrame:
    """Batches with more files than allowed; partial counts make a hot batch cheap. Files without a batch are one."""
    return files.groupBy(batch).agg(F.count("*").alias("n_files")).filter(F.col("n_files") > cap)


def flag_oversized_batches(files: DataFrame, batch: str = "batch", cap: int = MAX_BATCH_FILES) -> DataFrame:
    """Every file with ``status`` and ``message``: a batch with too many files is refused whole, row by row."""
    over = oversized_batches(files, batch, cap).select(F.col(batch).alias("_over"), F.lit(True).alias("_refused"))
    return (
        files.join(over, F.col(batch).eqNullSafe(F.col("_over")), "left")
        .withColumn("status", F.when(F.col("_refused"), "error").otherwise("ok"))
        .withColumn("message", F.when(F.col("_refused"), "too_many_files"))
        .drop("_over", "_refused")
    )


def running_total(rows: DataFrame, key: str, order: str, value: str, out: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative sum per key in the order of a column, safe for a hot key.

    Rows are dealt by ranges of (key, order, ties, row): bounds are quantiles of the rows themselves, so neither an
    outlying order, nor a key with most rows, nor a third of them without an order makes one range long. The ranges
    are written in order once; each is summed by itself and starts from the total of the key's earlier ranges, one
    line for each. A missing key is a key of its own; rows without an order come first in their key, and rows equal
    in order and ``ties`` stand in any one order.
    """
    numbered = rows.withColumn("_salt", F.monotonically_increasing_id())
    by = [key, order, *ties, "_salt"]
    sorted_rows = numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt")
    placed = written(sorted_rows.withColumn("_seq", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_range", F.shiftright("_seq", 33))
    totals = placed.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_key", "_at", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = (
        Window.partitionBy(key, "_range").orderBy("_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at"))
    return (
        placed.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, same)
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_seq", "_range", "_inside", "_offset", "_key", "_at")
    )


def apply_byte_budget(
    files: DataFrame, batch: str = "batch", order: str = "ord", size: str = "bytes", cap: int = MAX_BATCH_BYTES
) -> DataFrame:
    """Once a batch has passed its budget, that file and all later ones are errors.

    Bytes of files past the budget stay counted. Run it on file metadata,
    before any content is read.
    """
    totalled = running_total(files, batch, order, size, "running_bytes")
    return totalled.withColumn("status", F.when(F.col("running_bytes") > cap, "error").otherwise("ok")).withColumn(
        "message", F.when(F.col("running_bytes") > cap, "batch_budget_exceeded")
    )


def batch_verdicts(files: DataFrame, max_files: int = MAX_BATCH_FILES, max_bytes: int = MAX_BATCH_BYTES) -> DataFrame:
    """(batch, ord, running_bytes, status, message) of every file: too many files come before a spent budget."""
    flagged = flag_oversized_batches(files.select("batch", "ord", "bytes"), cap=max_files)
    totalled = running_total(flagged, "batch", "ord", "bytes", "running_bytes")
    spent = F.col("running_bytes") > max_bytes
    message = F.coalesce("message", F.when(spent, F.lit("batch_budget_exceeded")))
    return totalled.withColumn("message", message).withColumn(
        "status", F.when(F.col("message").isNull(), "ok").otherwise("error")
    ).drop("bytes")


def batch_summary(results: DataFrame, batch: str = "batch") -> DataFrame:
    """Files, errors and findings per batch; a refused batch is listed with as many errors as files."""
    return results.groupBy(batch).agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("status") == "error").alias("n_errors"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("total_findings"))), F.lit(0)).alias("total_findings"),
    )
