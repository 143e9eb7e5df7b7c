"""Sentence and word statistics and the heuristic 0-100 style score built on them.

The score is an inconclusive estimate from surface style, not a verdict.
Thresholds on ratios and deviations are tested in whole numbers, so the result
does not depend on floating-point summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsa.functions.arrays import array_total
from palimpsa.functions.texts import sentences, words

# Stock connector phrases.
CONNECTOR_PHRASES = [
    "en resumen",
    "es importante destacar",
    "en conclusión",
    "cabe mencionar",
    "cabe destacar",
    "en definitiva",
    "por otro lado",
    "en este sentido",
    "es fundamental",
    "en última instancia",
    "no obstante",
    "vale la pena mencionar",
    "es importante señalar",
    "en síntesis",
    "dicho esto",
    "en un mundo cada vez más",
    "es crucial",
    "a la hora de",
    "por lo tanto",
    "en el panorama actual",
]

# Weights and minimum sizes.
MIN_SENTENCES, MIN_WORDS = 3, 20
LENGTH_POINTS, DIVERSITY_POINTS, PHRASE_POINTS, PUNCTUATION_POINTS = 25, 25, 30, 20
HIGH_BAND, MEDIUM_BAND = 65, 35

FEATURES = [
    "n_sentences", "n_words", "n_distinct_words", "sum_len", "sum_len_sq",
    "n_period", "sum_commas", "sum_commas_sq", "phrases",
]


def present_phrases(lowered: Column, phrases: list[str] | None = None) -> Column:
    """Which phrases occur in a text already lower-cased, as plain substrings."""
    listed = CONNECTOR_PHRASES if phrases is None else phrases
    if not listed:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(p)), F.lit(p)) for p in listed]))


def add_features(documents: DataFrame, text: str = "text", phrases: list[str] | None = None) -> DataFrame:
    """Whole-number features per document; narrow projections only, no shuffle.

    Each stage names what the next one uses more than once, so sentences and
    words are found once per document.
    """
    base = documents.columns
    body = F.coalesce(F.col(text), F.lit(""))
    split = documents.withColumn("_sent", sentences(body)).withColumn("_lower", F.lower(body))
    counted = (
        split.withColumn("phrases", present_phrases(F.col("_lower"), phrases))
        .withColumn("_words", F.transform("_sent", words))
        .withColumn("_len", F.transform("_words", lambda w: F.size(w).cast("bigint")))
        .withColumn(
            "_commas",
            F.transform("_sent", lambda s: (F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))).cast("bigint")),
        )
        .withColumn("_flat", F.transform(F.flatten("_words"), F.lower))
    )
    return counted.select(
        *base,
        F.size("_sent").alias("n_sentences"),
        F.size("_flat").alias("n_words"),
        F.size(F.array_distinct("_flat")).alias("n_distinct_words"),
        array_total(F.col("_len")).alias("sum_len"),
        array_total(F.transform("_len", lambda n: n * n)).alias("sum_len_sq"),
        F.size(F.filter("_sent", lambda s: F.endswith(s, F.lit(".")))).alias("n_period"),
        array_total(F.col("_commas")).alias("sum_commas"),
        array_total(F.transform("_commas", lambda n: n * n)).alias("sum_commas_sq"),
        "phrases",
    )


def length_points() -> Column:
    """Coefficient of variation of words per sentence below 0.35, else below 0.55."""
    spread = F.col("n_sentences") * F.col("sum_len_sq") - F.col("sum_len") * F.col("sum_len")
    scaled = F.col("sum_len") * F.col("sum_len")
    return (
        F.when(F.col("n_sentences") < MIN_SENTENCES, 0)
        .when((F.col("sum_len") == 0) | (400 * spread < 49 * scaled), 25)
        .when(400 * spread < 121 * scaled, 12)
        .otherwise(0)
    )


def diversity_points() -> Column:
    """Distinct words over words below 0.4, else below 0.55."""
    distinct, total = F.col("n_distinct_words"), F.col("n_words")
    return (
        F.when(total < MIN_WORDS, 0).when(5 * distinct < 2 * total, 25).when(20 * distinct < 11 * total, 12).otherwise(0)
    )


def phrase_points() -> Column:
    return F.least(F.lit(PHRASE_POINTS), 10 * F.size("phrases"))


def punctuation_points() -> Column:
    """Over 90 % of sentences end in a period with even commas, else over 75 %."""
    n, periods = F.col("n_sentences"), F.col("n_period")
    spread = n * F.col("sum_commas_sq") - F.col("sum_commas") * F.col("sum_commas")
    return (
        F.when(n < MIN_SENTENCES, 0)
        .when((10 * periods > 9 * n) & (spread < n * n), 20)
        .when(4 * periods > 3 * n, 10)
        .otherwise(0)
    )


def max_points() -> Column:
    structured = F.when(F.col("n_sentences") >= MIN_SENTENCES, LENGTH_POINTS + PUNCTUATION_POINTS).otherwise(0)
    worded = F.when(F.col("n_words") >= MIN_WORDS, DIVERSITY_POINTS).otherwise(0)
    return structured + worded + PHRASE_POINTS


def add_score(documents: DataFrame, text: str = "text", phrases: list[str] | None = None) -> DataFrame:
    """Features, points per signal, ``score`` and the codes of the signals that fired."""
    pointed = (
        add_features(documents, text, phrases)
        .withColumn("length_points", length_points())
        .withColumn("diversity_points", diversity_points())
        .withColumn("phrase_points", phrase_points())
        .withColumn("punctuation_points", punctuation_points())
        .withColumn("max_points", max_points())
    )
    points = sum((F.col(f"{k}_points") for k in ("diversity", "phrase", "punctuation")), F.col("length_points"))
    return pointed.withColumn("score", F.round(points * 100.0 / F.col("max_points"), 1)).withColumn(
        "signals", signals()
    )


def signals() -> Column:
    """Codes instead of sentences: the numbers behind them are columns of their own."""

    def level(name: str, strong: int) -> Column:
        points = F.col(f"{name}_points")
        return F.when(points >= strong, f"{name}_strong").when(points > 0, f"{name}_moderate")

    fired = F.array_compact(
        F.array(
            level("length", 25),
            level("diversity", 25),
            F.when(F.col("phrase_points") > 0, "phrases"),
            level("punctuation", 20),
        )
    )
    return F.when(F.size(fired) == 0, F.array(F.lit("none"))).otherwise(fired)


def band(score: Column) -> Column:
    return F.when(score >= HIGH_BAND, "high").when(score >= MEDIUM_BAND, "medium").otherwise("low")


def ratios(features: DataFrame) -> DataFrame:
    """Readable ratios for reports: mean and deviation of sentence length, type-token ratio."""
    n, total = F.col("n_sentences"), F.col("sum_len")
    mean = total / n
    return (
        features.withColumn("mean_len", F.when(n > 0, mean))
        .withColumn("stdev_len", F.when(n > 0, F.sqrt((n * F.col("sum_len_sq") - total * total) / (n * n))))
        .withColumn("type_token", F.when(F.col("n_words") > 0, F.col("n_distinct_words") / F.col("n_words")))
    )


def compare(documents: DataFrame, before: str, after: str) -> DataFrame:
    """Scores of two versions of a text side by side, the change and its direction."""
    kept = documents.columns
    first = add_score(documents, before).select(*kept, F.col("score").alias("score_before"))
    second = add_score(first, after).select(*kept, "score_before", F.col("score").alias("score_after"))
    delta = F.round(F.col("score_after") - F.col("score_before"), 1)
    return (
        second.withColumn("delta", delta)
        .withColumn("direction", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("flat"))
        .withColumn("band_before", band(F.col("score_before")))
        .withColumn("band_after", band(F.col("score_after")))
    )


def band_transitions(compared: DataFrame) -> DataFrame:
    """How many documents move from one band to another."""
    return (
        compared.groupBy("band_before")
        .pivot("band_after", ["low", "medium", "high"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )
