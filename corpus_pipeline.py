"""The corpus pipeline: each stage is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsa.llm import exact, jaccard, leaks, pieces, toxicity
from palimpsa.llm.common import settle, table
from palimpsa.llm.queries import MODEL_FILE


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above go; it learns from the labelled ones among them."""
    model = toxicity.fit_from_labels(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.add_toxicity(docs, model, into="_toxicity")
    return scored.filter(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose sets of five words are alike by 0.8 or more, the row with the least id stays."""
    return jaccard.drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, and whether they decode to it.

    Encoded texts are written first: in one go each task would have a Python worker for either step beside the other's.
    """
    model = pieces.load_model(MODEL_FILE)
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), model)
    coded = pieces.decode(settle(encoded, "encoded"), model)
    restored = F.col("decoded").eqNullSafe(F.col("text"))
    return coded.select("doc_id", "lang", "source", "pieces", F.size("pieces").alias("n_pieces"), restored.alias("restored"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

# The classifier and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
