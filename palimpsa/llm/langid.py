"""Language by string kernels: n-gram presence, landmarks (Nystroem) and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import whole
from palimpsa.llm.streams import BLANK, array_slices, gram_hashes, letter_stream, letter_table

ORDERS = range(1, 5)
BITS = 13  # buckets of the presence vector
LANDMARKS = 64  # of each language
SAMPLE = 1500  # labelled rows of each language, about
RIDGE = 1e-3
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    landmarks: np.ndarray  # presence vectors, one row each, scaled to length one
    weights: np.ndarray  # kernel values of a text to a value for each language

    def scores(self, presence: np.ndarray) -> np.ndarray:
        return kernel(presence, self.landmarks) @ self.weights


def presence_vectors(texts: list[str], letters: np.ndarray) -> np.ndarray:
    """Which buckets the n-grams of the blended spectrum of each text fall in."""
    stream, owner = letter_stream(texts, letters)
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    flat = out.reshape(-1)
    for text, bucket in gram_hashes(stream, owner, ORDERS, BITS):
        flat[(text << BITS) + bucket] = 1
    return out


def unit(presence: np.ndarray) -> np.ndarray:
    return presence / np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))


def kernel(presence: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of both counts."""
    return unit(presence) @ landmarks.T


def _solve(names: list[str], language: np.ndarray, presence: np.ndarray, landmarks: int) -> LanguageModel:
    chosen = np.concatenate([np.flatnonzero(language == i)[:landmarks] for i in range(len(names))])
    points = unit(presence[chosen])
    own = (points @ points.T).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # the Nystroem map of kernel values
    mapped = kernel(presence, points).astype(np.float64) @ root
    counts = np.bincount(language, minlength=len(names))
    weight = (1 / counts)[language]  # each language weighs the same
    goal = (language[:, None] == np.arange(len(names))).astype(np.float64)
    left = (mapped * weight[:, None]).T @ mapped + RIDGE * np.eye(mapped.shape[1])
    right = (mapped * weight[:, None]).T @ goal
    return LanguageModel(tuple(names), points.astype(np.float32), (root @ np.linalg.solve(left, right)).astype(np.float32))


def fit_languages(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    sample: int = SAMPLE, landmarks: int = LANDMARKS,
) -> LanguageModel | None:
    """A model from rows with a language; None without any.

    About ``sample`` rows of each language are used, drawn by a hash of the key and the text, whole texts each; the
    first ``landmarks`` of them are landmarks. Rows without text or language are left out.
    """
    rows = labelled.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(key, text).alias("_draw"))
    rows = rows.filter("_lang is not null and _text is not null")
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rate = F.lit(0.0)
    for name, n in counts.items():
        rate = F.when(F.col("_lang") == name, min(1.0, sample / n)).otherwise(rate)
    drawn = rows.filter(F.pmod("_draw", F.lit(1 << 30)) / float(1 << 30) < rate)

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for frame in frames:
            for start in range(0, len(frame), 64):
                part = frame.iloc[start : start + 64]
                bits = np.packbits(presence_vectors(list(part["_text"]), letters).astype(bool), axis=1)
                yield pd.DataFrame({"_lang": part["_lang"], "_draw": part["_draw"], "_bits": [b.tobytes() for b in bits]})

    got = drawn.mapInPandas(packed, "_lang string, _draw long, _bits binary").toPandas().sort_values(["_draw", "_lang"])
    names = sorted(got["_lang"].unique())
    bits = np.stack([np.frombuffer(b, np.uint8) for b in got["_bits"]])
    language = np.searchsorted(names, got["_lang"].to_numpy())
    return _solve(names, language, np.unpackbits(bits, axis=1).astype(np.float32), landmarks)


def add_language(docs: DataFrame, model: LanguageModel | None, text: str = "text", into: str = "language") -> DataFrame:
    """All columns of ``docs`` plus ``into``: a struct of name and score (0 to 1) from the whole text.

    A missing text or one without a letter is ``und`` with score 0, and so is any text without a model. A narrow step;
    an existing column ``into`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters, own = letter_table(), shared.value
        for column in batches:
            names: list[str] = []
            values: list[float] = []
            for part in array_slices(column):
                texts = part.to_pylist()
                if own is None:
                    names += [UNKNOWN] * len(texts)
                    values += [0.0] * len(texts)
                    continue
                presence = presence_vectors(texts, letters)
                scores = own.scores(presence)
                best = scores.argmax(axis=1)
                stream, owner = letter_stream(texts, letters)
                lettered = np.bincount(owner[stream != BLANK], minlength=len(texts)) > 0
                names += [own.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                values += np.where(lettered, np.clip(scores.max(axis=1), 0, 1), 0.0).tolist()
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(values, pa.float64())], ["name", "score"]
            )

    named.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, F.arrow_udf(named, "name string, score double")(whole(text)))
