"""Toxicity: a classifier on n-gram presence whose score must not change when identity terms are swapped."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import settle, small_batches, tidy, whole
from palimpsa.llm.streams import array_slices, gram_hashes, letter_stream, letter_table

ORDERS = range(5, 7)
BITS = 62  # of a gram's hash: different grams must not share a feature
FIRST_BITS = 22  # of the table that most grams are turned away by
FEATURES = 1024
SAMPLE = 6000  # labelled rows of each class, about
RIDGE = 1e-4
FAIRNESS = 10.0  # weight of the counterfactual penalty
PAIRS = 4  # sentences of a drawn text, at most, that counterfactual pairs are made of
STEPS = 20  # Newton steps at most
THRESHOLD = 0.3

# Groups of identity terms; a term is swapped for the next of its group.
IDENTITIES = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("africans", "europeans", "asians", "americans"),
    ("african", "european", "american"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "blind", "deaf"),
    ("old", "young"),
    ("mujeres", "hombres"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
)
NEXT_TERM = {t: group[(i + 1) % len(group)] for group in IDENTITIES for i, t in enumerate(group)}
TERM = re.compile(r"\b(?:" + "|".join(sorted(NEXT_TERM, key=len, reverse=True)) + r")\b", re.I)
TERMS = tuple(NEXT_TERM)
SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass(frozen=True)
class ToxicityModel:
    grams: np.ndarray  # the hash of each feature, no two with the same first bits
    weights: np.ndarray
    bias: float
    pairs: int = 0  # counterfactual pairs of sentences that it was fitted with

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """First bits of a hash to its feature (-1 where there is none), and the hashes of features."""
        out = np.full(1 << FIRST_BITS, -1, np.int16)
        out[self.grams >> (BITS - FIRST_BITS)] = np.arange(len(self.grams))
        return out, self.grams


def swapped(text: str) -> str | None:
    """The text with each identity term swapped for the next of its group; None without any."""
    out, n = TERM.subn(lambda m: NEXT_TERM[m.group().lower()], text)
    return out if n else None


def counterfactuals(text: str, most: int = PAIRS) -> list[tuple[str, str]]:
    """Pairs of sentences that differ in their identity terms only, from up to ``most`` sentences of the text.

    Sentences that name a group come first, with their terms swapped. In others a slot between two words, drawn by a hash
    of the sentence, is filled with a term and with the next of its group. A text without words is the slot alone.
    """
    found = {s.strip(): None for s in SENTENCE.findall(text)}
    drawn = sorted(found, key=lambda s: (TERM.search(s) is None, zlib.crc32(s.encode("utf-8", "replace")), s))
    pairs = []
    for sentence in [s for s in drawn if s][:most] or [""]:
        other = swapped(sentence)
        if other is None:
            words, draw = sentence.split(), zlib.crc32(sentence.encode("utf-8", "replace"))
            at, term = draw % (len(words) + 1), TERMS[draw // (len(words) + 1) % len(TERMS)]
            sentence, other = (" ".join([*words[:at], t, *words[at:]]) for t in (term, NEXT_TERM[term]))
        pairs.append((sentence, other))
    return pairs


def text_features(
    texts: list[str], letters: np.ndarray, lookup: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once."""
    stream, owner = letter_stream(texts, letters)
    first, grams = lookup
    pairs = []
    for text, gram in gram_hashes(stream, owner, ORDERS, BITS):
        feature = first[gram >> (BITS - FIRST_BITS)]
        near = np.flatnonzero(feature >= 0)
        near = near[grams[feature[near]] == gram[near]]
        pairs.append(text[near] * FEATURES + feature[near])
    found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return found // FEATURES, found % FEATURES


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of either class that have each gram, summed by parts of a task."""
    letters = letter_table()
    for frame in frames:
        for start in range(0, len(frame), 256):
            part = frame.iloc[start : start + 256]
            found: list[list[np.ndarray]] = [[], []]
            for label, text in zip(part["_label"], part["_text"], strict=True):
                stream, owner = letter_stream([text], letters)
                found[label] += [np.unique(gram) for _, gram in gram_hashes(stream, owner, ORDERS, BITS)]
            for label, name in enumerate(("_clean", "_toxic")):
                if found[label]:
                    grams, n = np.unique(np.concatenate(found[label]), return_counts=True)
                    yield pd.DataFrame({"_gram": grams, "_toxic": 0, "_clean": 0} | {name: n})
    tidy()


def _solved(x: np.ndarray, y: np.ndarray, weight: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps; ``change``: mean outer product of the feature changes of pairs."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = (weight / weight.sum()).astype(np.float32)
    held = np.diag(np.append(np.full(x.shape[1] - 1, RIDGE), 1e-9))
    held[:-1, :-1] += 2 * FAIRNESS * change

    def loss(w: np.ndarray) -> float:
        raw = x @ w.astype(np.float32)
        return float(share @ (np.logaddexp(0, raw) - y * raw)) + 0.5 * float(w @ held @ w)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        slope = x.T @ (share * (p - y)).astype(np.float32) + held @ w
        bend = (x * (share * p * (1 - p)).astype(np.float32)[:, None]).T @ x + held
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        if now - then < 1e-7:
            break
        w, now = w - size * step, then
    return w[:-1], float(w[-1])


def fit_toxicity(
    labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = SAMPLE
) -> ToxicityModel | None:
    """A model from rows with a label of 0 or 1; None unless both occur.

    About ``sample`` rows of each class are used, drawn by a hash of the key, whole texts each, and weighted so that
    classes count as in all rows. Features are the ``FEATURES`` letter 5- and 6-grams whose log-odds between
    toxic and other rows are surely the greatest. The loss adds ``FAIRNESS`` times the mean squared change of the raw
    score between the sentences of a pair (``counterfactuals``, up to ``PAIRS`` sentences of each drawn text), over the pairs
    that differ in any feature. ``pairs`` of the model counts all of them; it is never 0.
    """
    rows = labelled.select(F.col(label).cast("int").alias("_label"), whole(text).alias("_text"), F.xxhash64(key).alias("_draw"))
    rows = rows.filter("_label in (0, 1)")
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    return _fit(rows.filter(_is_drawn(counts, sample)), counts, sample)


def fit_from_labels(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = SAMPLE
) -> ToxicityModel | None:
    """The same from a table of texts and one of labels. Keys are drawn first, so no other text meets its label.

    Of repeated labels of a key the largest counts; keys that are missing on either side join nothing. The drawn keys,
    about ``sample`` a class, are broadcast.
    """
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    known = settle(known.withColumn("_draw", F.xxhash64("_key")), "labels")
    there = docs.select(F.col(key).alias("_key")).join(known, "_key")
    counts = {r["_label"]: r["n"] for r in there.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    drawn = F.broadcast(known.filter(_is_drawn(counts, sample)))
    rows = docs.select(F.col(key).alias("_key"), whole(text).alias("_text")).join(drawn, "_key")
    return _fit(rows.select("_label", "_text", "_draw"), counts, sample)


def _is_drawn(counts: dict[int, int], sample: int) -> Column:
    rate = F.when(F.col("_label") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0]))
    return F.pmod(F.col("_draw"), F.lit(1 << 30)) / float(1 << 30) < rate


def _fit(rows: DataFrame, counts: dict[int, int], sample: int) -> ToxicityModel | None:
    drawn = settle(rows.repartition(8, "_draw"), "drawn")
    sizes = {0: min(sample, counts[0]), 1: min(sample, counts[1])}

    def odds(n: str, size: int) -> Column:
        return F.log((F.col(n) + 0.5) / (F.greatest(F.lit(size) - F.col(n), F.lit(0)) + 0.5))

    # The least log-odds that the counts leave room for; a mere significance would choose common grams of long texts.
    spread = F.sqrt(1 / (F.col("_toxic") + 0.5) + 1 / (F.col("_clean") + 0.5))
    sure = odds("_toxic", sizes[1]) - odds("_clean", sizes[0]) - 2 * spread
    chosen = (
        drawn.mapInPandas(_counted, "_gram long, _toxic long, _clean long")
        .groupBy("_gram").agg(F.sum("_toxic").alias("_toxic"), F.sum("_clean").alias("_clean"))
        .filter("_toxic >= 4")
        .select("_gram", sure.alias("_sure"))
        .orderBy(F.desc("_sure"), "_gram").limit(FEATURES)
    )
    grams = np.array([r["_gram"] for r in chosen.collect()], np.int64)
    grams = grams[np.unique(grams >> (BITS - FIRST_BITS), return_index=True)[1]]
    draft = ToxicityModel(grams, np.zeros(len(grams)), 0.0)
    shared = drawn.sparkSession.sparkContext.broadcast(draft)

    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, lookup = letter_table(), shared.value.lookup()

        def bits(texts: list[str]) -> np.ndarray:
            rows = np.zeros((len(texts), FEATURES), bool)
            rows[text_features(texts, letters, lookup)] = True
            return rows

        def changes(pairs: list[tuple[str, str]]) -> bytes:
            """Both sides of the pairs that differ in features, packed one after the other."""
            sides = bits([s for pair in pairs for s in pair]).reshape(len(pairs), 2, FEATURES)
            return np.packbits(sides[(sides[:, 0] != sides[:, 1]).any(axis=1)], axis=-1).tobytes()

        for frame in frames:
            pairs = [counterfactuals(t) for t in frame["_text"]]
            yield pd.DataFrame(
                {
                    "_draw": frame["_draw"], "_label": frame["_label"],
                    "_own": [np.packbits(bits([t])).tobytes() for t in frame["_text"]],
                    "_pairs": [len(p) for p in pairs], "_changes": [changes(p) for p in pairs],
                }
            )
        tidy()

    got = drawn.mapInPandas(described, "_draw long, _label int, _own binary, _pairs long, _changes binary").toPandas()
    got = got.sort_values(["_draw", "_label"], ignore_index=True)
    y = got["_label"].to_numpy()
    if len(set(y)) < 2:
        return None

    def unpacked(packed: bytes) -> np.ndarray:
        rows = np.frombuffer(packed, np.uint8).reshape(-1, FEATURES // 8)
        return np.unpackbits(rows, axis=1)[:, : len(grams)].astype(np.float32)

    change, moved = np.zeros((len(grams), len(grams))), 0
    for start in range(0, len(got), 1024):
        sides = unpacked(b"".join(got["_changes"].iloc[start : start + 1024]))
        step = sides[0::2] - sides[1::2]
        change += step.T @ step
        moved += len(step)
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    weights, bias = _solved(unpacked(b"".join(got["_own"])), y, weight, change / max(1, moved))
    return ToxicityModel(grams, weights.astype(np.float64), bias, int(got["_pairs"].sum()))


def add_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text", into: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` plus ``into``: the chance (0 to 1) that the whole text is toxic.

    A missing or empty text has the score of a text without features; without a model the score is 0. A narrow step;
    an existing column ``into`` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        letters, lookup = letter_table(), own.lookup() if own else None
        for column in batches:
            out = []
            for part in array_slices(column):
                raw = np.zeros(len(part))
                if own:
                    row, feature = text_features(part.to_pylist(), letters, lookup)
                    raw = np.bincount(row, own.weights[feature], minlength=len(part)) + own.bias
                out.append(1 / (1 + np.exp(-raw)) if own else raw)
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
        tidy()

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, F.arrow_udf(scored, "double")(whole(text)))
