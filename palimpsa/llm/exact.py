"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import settle, whole

PREFIX_CHARS = 64
BROADCAST_CLASSES = 1 << 19  # 12 bytes each


def _refined(rows: DataFrame, text: Column, prefix_chars: int, digest_all: bool, thin: list[str] | None = None) -> DataFrame:
    """Rows with a ``_key`` and the text in some column, plus ``_sha``, ``_again`` and ``_row``.

    With ``thin`` only those columns are kept, and no text meets an exchange: where classes are too many to broadcast,
    whole texts are hashed in the scan, before rows meet their classes.
    """
    sized = rows.withColumns({"_size": F.octet_length(text), "_prefix": F.xxhash64(F.substring(text, 1, prefix_chars))})
    # Levels 1 and 2: lengths, then prefixes within them, that more than one row has. Summed first, no text moves.
    lengths = sized.groupBy("_size").agg(F.count("*").alias("_n")).filter("_n > 1").select("_size")
    classes = (
        sized.groupBy("_size", "_prefix")
        .agg(F.count("*").alias("_n"))
        .filter("_n > 1")
        .join(lengths, "_size", "left_semi")
        .select("_size", "_prefix", F.lit(True).alias("_again"))
    )
    # Written, so that the join has plain exchanges on both sides: only then can a hot class be split.
    classes = settle(classes, "classes")
    # Level 3: whole texts of the classes that are left.
    sha = F.sha2(text.cast("binary"), 256)
    if thin is not None:
        few = classes.count() <= BROADCAST_CLASSES
        early = digest_all or not few
        sized = sized.select(*thin, "_size", "_prefix", sha.alias("_sha")) if early else sized
        met = sized.join(F.broadcast(classes) if few else classes, ["_size", "_prefix"], "left")
        sha = F.col("_sha") if early else sha
    else:
        met = sized.join(classes, ["_size", "_prefix"], "left")
    wanted = F.lit(True) if digest_all else F.col("_again")
    marked = met.withColumns(
        {
            "_again": F.coalesce("_again", F.lit(False)),
            "_sha": F.when(wanted, sha),
            "_row": F.monotonically_increasing_id(),
        }
    )
    if thin is not None:
        marked = marked.select(*thin, "_size", "_prefix", "_again", "_sha", "_row")
    return settle(marked, "exact")


def _met(marked: DataFrame) -> DataFrame:
    """Rows alone in their class are done; the others meet by their whole hash."""
    one = {"_keep": F.col("_key"), "_members": F.lit(1).cast("long"), "_kept": F.lit(True)}
    alone = marked.filter("not _again").withColumns(one)
    shared = marked.filter("_again")
    groups = shared.groupBy("_size", "_prefix", "_sha").agg(
        F.max(F.struct("_key", "_row")).alias("_best"), F.count("*").alias("_members")
    )
    met = shared.join(settle(groups, "groups"), ["_size", "_prefix", "_sha"])
    met = met.withColumns({"_keep": F.col("_best._key"), "_kept": F.col("_best._row") == F.col("_row")}).drop("_best")
    return alone.unionByName(met)


def exact_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    digest_all: bool = False,
) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a missing text counts as empty. Of equal texts the row with the largest key
    stays; a missing key is less than any other, and of rows that repeat both text and key exactly one stays.
    Only rows that share length and prefix with another get their whole text hashed; for the others
    ``text_sha256`` is null unless ``digest_all``. Other columns are ignored. An empty table gives an empty table.

    Shuffles: counts per length and per prefix (summed before they move), one join of thin rows to the classes that occur
    more than once, one to their groups. Texts never move. Rows are on the streamed side of both, which adaptive joins split.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    marked = _refined(rows, whole("_text"), prefix_chars, digest_all, thin=["_key"])
    return _met(marked).select(
        F.col("_key").alias(key), F.col("_keep").alias("keep_id"), F.col("_members").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged, by the rules of ``exact_groups``; its columns may have any names."""
    names = docs.columns
    rows = docs.select(F.col(key).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_whole"))
    marked = _refined(rows, whole(f"_whole.`{text}`"), prefix_chars, digest_all=False)
    return _met(marked).filter("_kept").select(*[F.col(f"_whole.`{c}`") for c in names])
