"""Deletion of flagged spans. Matching is always against the original text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsa.functions import chars, spans
from palimpsa.functions.scan import find_all
from palimpsa.operators.detect import DetectionConfig, each_keyword, usable_keywords

SPAN_TYPE = "array<struct<start:int,end:int>>"


def strip_invisible(text: Column, replace_spaces: str | None = None) -> Column:
    """Delete every flagged character in one pass, with no offsets.

    ``replace_spaces`` is opt-in: look-alike spaces become that text instead of
    vanishing, so neighbouring words stay apart.
    """
    if replace_spaces is not None:
        text = F.regexp_replace(text, chars.SPACE_CLASS, replace_spaces)
    return F.regexp_replace(text, chars.FLAGGED_CLASS, "")


def _as_spans(matches: Column) -> Column:
    return F.transform(
        matches,
        lambda m: F.struct(
            m["position"].alias("start"), (m["position"] + F.length(m["matched"])).alias("end")
        ),
    )


def invisible_spans(text: Column) -> Column:
    return _as_spans(find_all(text, chars.FLAGGED_CLASS))


def keyword_spans(text: Column, keywords: list[str], config: DetectionConfig) -> Column:
    """Spans of every keyword, keyword by keyword; equal spans are kept, they count separately."""
    if not keywords:
        return F.array().cast(SPAN_TYPE)
    return each_keyword(text, keywords, config, lambda ordinal, keyword, matches: _as_spans(matches))


def _chosen(spans_: Column, prefix: str, ids: str | None) -> Column:
    """Spans whose finding id is listed; a null list means all and an empty one none."""
    if ids is None:
        return spans_

    def listed(s: Column) -> Column:
        parts = [F.lit(prefix), s["start"]] + ([s["end"]] if prefix == "kw" else [])
        return F.array_contains(F.col(ids), F.concat_ws(":", *parts))

    return F.when(F.col(ids).isNull(), spans_).otherwise(F.filter(spans_, listed))


def removal_spans(
    documents: DataFrame, config: DetectionConfig, invisible_ids: str | None = None, keyword_ids: str | None = None
) -> DataFrame:
    """Chosen spans (unsorted, one per finding) and how many there are of each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keywords = usable_keywords(documents.sparkSession, config)
    invisible = invisible_spans(text) if config.detect_invisible else F.array().cast(SPAN_TYPE)
    return (
        documents.withColumn("_inv", _chosen(invisible, "inv", invisible_ids))
        .withColumn("_kw", _chosen(keyword_spans(text, keywords, config), "kw", keyword_ids))
        .select(
            *documents.columns,
            F.size("_inv").alias("removed_invisible"),
            F.size("_kw").alias("removed_keyword"),
            F.concat("_inv", "_kw").alias("spans"),
        )
    )


def clean(
    documents: DataFrame,
    config: DetectionConfig,
    invisible_ids: str | None = None,
    keyword_ids: str | None = None,
    with_preview: bool = True,
) -> DataFrame:
    """Cleaned text, counts of removed findings and a preview, per document, without a shuffle.

    ``invisible_ids`` and ``keyword_ids`` name array columns of chosen ids.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spanned = removal_spans(documents, config, invisible_ids, keyword_ids)
    merged = spanned.withColumn("spans", spans.merge(F.col("spans")))
    result = merged.withColumn("cleaned", spans.delete(text, F.col("spans")))
    if with_preview:
        result = result.withColumn("preview", spans.preview(text, F.col("spans")))
    return result.drop("spans")


def merge_span_table(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """Union of spans held in a table (key, start, end), as when findings were persisted.

    Gaps and islands: a span opens an island when it starts after everything
    before it has ended. One key is one document, so a window is bounded by it.
    """
    order = Window.partitionBy(key).orderBy("start", "end")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = table.select(
        key,
        "start",
        "end",
        F.coalesce((F.col("start") > F.max("end").over(earlier)).cast("int"), F.lit(1)).alias("opens"),
    )
    return (
        flagged.withColumn("island", F.sum("opens").over(upto))
        .groupBy(key, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )


def kept_segments(islands: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Complement of disjoint spans, piece by piece; documents without spans give one piece.

    The islands and one closing row per document share a window on the key, so the
    text itself is not moved.
    """
    ends = documents.select(
        key, F.length("text").alias("start"), F.length("text").alias("end"), F.lit(1).alias("closing")
    )
    order = Window.partitionBy(key).orderBy("start", "closing")
    return (
        islands.select(key, "start", "end", F.lit(0).alias("closing"))
        .unionByName(ends)
        .select(
            key,
            F.coalesce(F.lag("end").over(order), F.lit(0)).alias("seg_start"),
            F.col("start").alias("seg_end"),
            (F.row_number().over(order) - 1).alias("seg"),
        )
    )


def apply_span_table(documents: DataFrame, islands: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cut persisted, merged spans out of the texts; untouched documents pass through.

    Islands are disjoint, so what is gathered per document is bounded by its text.
    """
    gathered = islands.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("islands"))
    joined = documents.join(gathered, key, "left")
    cleaned = F.when(F.col("islands").isNull(), F.col("text")).otherwise(spans.delete(F.col("text"), F.col("islands")))
    return joined.withColumn("cleaned", cleaned).drop("islands")
