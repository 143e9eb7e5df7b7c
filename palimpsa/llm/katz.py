"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, recursion per token.

Texts are read once, into chunks of some megabytes: a dictionary of the chunk's words and a number per token. For each
order every chunk sends each of its distinct n-grams once, dealt by its history, and gets back the corpus's count and
the history's sums. A word, and then each n-gram, is named by a number that is unique in the corpus, so an n-gram of
order k is a pair (number of its history, number of its word) and nothing rests on hashes being different.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import GOLD, discard, mix, pack, pooled, release, settle, small_batches, tidy, unpack

CHUNK_BYTES = 4 << 20  # text of a chunk, if it is more than one row
BUCKET_TOKENS = 2 << 20  # tokens for each bucket of n-grams
DISCOUNTED = 5  # counts up to this one are discounted
END = b" "  # no word holds a blank
OPENING = 0  # the number of what stands before the first token

CHUNK = "_chunk long, _tokens long, _body binary"
ENTRY = "_bucket long, _chunk long, _body binary"
ANSWER = "_kind string, _chunk long, _bucket long, _body binary"


@dataclass
class Order:
    """What all n-grams of one order say: discount by count, and sums of histories too frequent for one bucket."""

    discounts: np.ndarray
    hot: dict[int, np.ndarray] = field(default_factory=dict)


def discounts(of_counts: list[int]) -> np.ndarray:
    """Good-Turing factor for counts 0 to ``DISCOUNTED`` (0 unused), from the numbers of n-grams seen 1, 2, ... times.

    Katz's rule: (r* / r - m) / (1 - m) with r* = (r + 1) n(r+1) / n(r) and m = (k + 1) n(k+1) / n(1). Where the
    numbers do not allow it (none of some count, or a factor outside 0 to 1), that count stays as it is.
    """
    out = np.ones(DISCOUNTED + 1)
    n = [0, *of_counts]
    common = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        if n[r] and n[r + 1] and common < 1:
            factor = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            if 0 < factor < 1:
                out[r] = factor
    return out


def _words_of(text: bytes) -> Iterator[list[bytes]]:
    """A text's words (bytes.split cuts at exactly the six blanks), some megabytes of it at a time."""
    start = 0
    while start < len(text):
        cut = re.compile(rb"[ \t-\r]").search(text, start + CHUNK_BYTES) if len(text) - start > CHUNK_BYTES else None
        stop = cut.end() if cut else len(text)
        yield text[start:stop].split()
        start = stop


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("_chunk", pa.int64()), ("_tokens", pa.int64()), ("_body", pa.binary())])
    number = TaskContext.get().partitionId() << 32
    for part in pooled(batches, "_text", CHUNK_BYTES):
        known: dict[bytes, int] = {END: 0}
        tokens: list[np.ndarray] = []
        sizes = np.zeros(part.num_rows, np.int64)

        def number_words(words: list[bytes], known=known, tokens=tokens) -> None:
            coded = pa.array(words, pa.binary()).dictionary_encode()
            named = [known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()]
            tokens.append(np.array(named, np.uint32)[coded.indices.to_numpy()])

        held: list[bytes] = []
        for i, text in enumerate(part.column("_text")):
            # bytes.lower changes A to Z only
            for words in _words_of((text.as_py() or "").encode().lower()):
                sizes[i] += len(words)
                held += words
                if len(held) > 1 << 19:
                    number_words(held)
                    held = []
            held.append(END)
            sizes[i] += 1
        number_words(held)
        ids = part.column("_key")
        body = {
            "ids": ids.fill_null(0).to_numpy().astype(np.int64), "missing": ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
            "held": part.column("_held").to_numpy(zero_copy_only=False).astype(np.uint8), "sizes": sizes,
            "at": np.concatenate(tokens), "lengths": np.array([len(w) for w in known], np.int64), "words": b"".join(known),
        }
        yield pa.RecordBatch.from_pylist([{"_chunk": number, "_tokens": int(sizes.sum()), "_body": pack(body)}], schema)
        number += 1
        del known, tokens, held, body
        tidy()


def _words(body: dict) -> pa.Array:
    """The chunk's words as an array of byte strings."""
    ends = np.concatenate([[0], np.cumsum(body["lengths"], dtype=np.int64)])
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body["words"])]
    return pa.Array.from_buffers(pa.large_binary(), len(body["lengths"]), buffers)


def _word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words.to_pylist()), np.int64, len(words)) % buckets


def _trained(body: dict) -> np.ndarray:
    """Which tokens the model learns from."""
    return np.repeat(body["held"] == 0, body["sizes"])


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


ENTRY_ARROW = pa.schema([("_bucket", pa.int64()), ("_chunk", pa.int64()), ("_body", pa.binary())])
ANSWER_ARROW = pa.schema([("_kind", pa.string()), ("_chunk", pa.int64()), ("_bucket", pa.int64()), ("_body", pa.binary())])


def _split(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Bounds of equal values of a sorted array."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def _each(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Values of a batch, one row after the other: bodies are large and never copied all at once."""
    for values in zip(*[batch.column(name) for name in names], strict=True):
        yield tuple(v.as_py() for v in values)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Consecutive rows of one ``key``: (chunk, body) each."""
    own, held = None, []
    for batch in batches:
        for name, chunk, body in _each(batch, key, "_chunk", "_body"):
            if held and name != own:
                yield own, held
                held = []
                tidy()
            own = name
            held.append((chunk, body))
    if held:
        yield own, held
    tidy()


def _word_entries(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packed in _each(batch, "_chunk", "_body"):
                body = unpack(packed)
                words = _words(body)
                place = _word_buckets(words, buckets)
                every = np.bincount(body["at"], minlength=len(words))
                learnt = np.bincount(body["at"][_trained(body)], minlength=len(words))
                order = np.argsort(place, kind="stable")
                out = []
                for bucket, part in _split(place[order]):
                    own = order[part]
                    picked = words.take(pa.array(own))
                    sent = {
                        "lengths": body["lengths"][own], "words": b"".join(picked.to_pylist()), "all": every[own], "n": learnt[own],
                    }
                    out.append({"_bucket": bucket, "_chunk": chunk, "_body": pack(sent)})
                yield _rows(out, ENTRY_ARROW)
                del body, words, place, every, learnt, order, out
                tidy()

    return send


def _of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(counts[(counts > 0) & (counts <= DISCOUNTED + 1)], minlength=DISCOUNTED + 2)[1:].tolist()


def _word_answers(buckets: int, tokens: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "_bucket"):
            bodies = [unpack(b) for _, b in rows]
            coded = pa.concat_arrays([_words(b) for b in bodies]).dictionary_encode()
            at, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            counts, every = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(counts, at, np.concatenate([b["n"] for b in bodies]).astype(np.int64))
            np.add.at(every, at, np.concatenate([b["all"] for b in bodies]).astype(np.int64))
            ids = 1 + np.arange(n, dtype=np.int64) * buckets + bucket
            start, out = 0, []
            for (chunk, _), body in zip(rows, bodies, strict=True):
                own = at[start : start + len(body["n"])]
                start += len(own)
                out.append({"_kind": "reply", "_chunk": chunk, "_bucket": bucket, "_body": pack({"id": ids[own], "c": counts[own]})})
            listed = coded.dictionary.to_pylist()
            stored = {"words": b"".join(listed), "lengths": np.array([len(w) for w in listed]), "id": ids, "c": counts}
            out.append({"_kind": "table", "_chunk": -1, "_bucket": bucket, "_body": pack(stored)})
            # Frequent words as histories are dealt by the next word too.
            said = {
                "of": _of_counts(counts), "tokens": int(counts.sum()), "types": int((counts > 0).sum()),
                "hot": ids[every * buckets > tokens].tolist(),
            }
            out.append({"_kind": "sums", "_chunk": -1, "_bucket": bucket, "_body": json.dumps(said).encode()})
            yield _rows(out, ANSWER_ARROW)

    return answer


def _class_sums(leads: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """A row per history (its n-grams begin at ``leads``): sums of counts of its seen n-grams by their count (1 to
    ``DISCOUNTED``, then all greater ones), and of the counts one order below by those."""
    width = DISCOUNTED + 1
    out = np.zeros((len(leads), 2 * width), np.int64)
    of_history = np.repeat(np.arange(len(leads)), np.diff([*leads, len(counts)])) * 2 * width
    for first, values in ((0, counts), (width, lower)):
        seen = (counts > 0) & (values > 0)
        np.add.at(out.reshape(-1), of_history[seen] + first + np.minimum(values[seen], width) - 1, values[seen])
    return out


def _by_pair(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order of pairs; numbers below 2 ** 32 are joined, which sorts faster."""
    if len(history) and max(history.max(), word.max()) < 1 << 32:
        return np.argsort((history.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), kind="stable")
    return np.lexsort((word, history))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    fresh = np.ones(len(columns[0]), bool)
    if len(fresh):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return fresh


def _grams(body: dict, order: int) -> dict[str, np.ndarray]:
    """Distinct n-grams of a chunk in the order of (history, word), and for each token the index of its n-gram, or -1.

    ``body`` knows the numbers of words, and those of n-grams of the order below.
    """
    at, sizes = body["at"].astype(np.int64), body["sizes"].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    place = np.arange(len(at)) - np.repeat(first, sizes)
    below = at if order == 2 else body[f"gram{order - 1}"].astype(np.int64) - 1
    number = body["id1"] if order == 2 else body[f"id{order - 1}"]
    history = np.zeros(len(at), np.int64)
    history[1:] = below[:-1] + 1
    history[place == 0] = 0  # the opening
    whole = place >= order - 2
    pairs = history[whole] * len(body["id1"]) + at[whole]
    distinct, back = np.unique(pairs, return_inverse=True)
    own, word = distinct // len(body["id1"]), distinct % len(body["id1"])
    named = np.concatenate([[OPENING], number.astype(np.int64)])[own]
    words = body["id1"].astype(np.int64)[word]
    sorted_ = _by_pair(named, words)
    rank = np.empty(len(sorted_), np.int64)
    rank[sorted_] = np.arange(len(sorted_))
    gram = np.full(len(at), -1, np.int64)
    gram[whole] = rank[back]
    lower = np.zeros(len(distinct), np.int64)
    lower[gram[whole]] = (body["c1"][at] if order == 2 else body[f"c{order - 1}"][below])[whole]
    learnt = np.bincount(gram[whole & _trained(body)], minlength=len(distinct))
    return {"history": named[sorted_], "word": words[sorted_], "lower": lower, "n": learnt, "gram": gram}


def _gram_buckets(history: np.ndarray, word: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    key = history.astype(np.uint64) * GOLD
    frequent = np.isin(history, hot)
    key[frequent] ^= mix(word[frequent].astype(np.uint64) + np.uint64(1))
    return (mix(key) % np.uint64(buckets)).astype(np.int64)


def _gram_entries(order: int, buckets: int, hot: np.ndarray):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packed in _each(batch, "_chunk", "_body"):
                grams = _grams(unpack(packed), order)
                place = _gram_buckets(grams["history"], grams["word"], buckets, hot)
                by = np.argsort(place, kind="stable")
                out = []
                for bucket, part in _split(place[by]):
                    own = by[part]
                    history = grams["history"][own]
                    begins = np.flatnonzero(_starts(history))
                    sent = {
                        "history": history[begins], "run": np.diff([*begins, len(history)]), "word": grams["word"][own],
                        "lower": grams["lower"][own], "n": grams["n"][own],
                    }
                    out.append({"_bucket": bucket, "_chunk": chunk, "_body": pack(sent)})
                yield _rows(out, ENTRY_ARROW)
                del grams, place, by, out
                tidy()

    return send


def _gram_answers(buckets: int, hot: np.ndarray, named: bool):
    def answered(bucket: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        chunks, bodies = [c for c, _ in rows], [unpack(b) for _, b in rows]
        rows.clear()
        join = lambda name: np.concatenate([b[name] for b in bodies]).astype(np.int64)
        history, word = np.repeat(join("history"), join("run")), join("word")
        order = _by_pair(history, word)
        history, word = history[order], word[order]
        fresh = _starts(history, word)
        firsts = np.flatnonzero(fresh)
        histories, words = history[firsts], word[firsts]
        del history, word
        counts = np.add.reduceat(join("n")[order], firsts)
        lower = join("lower")[order[firsts]]
        at = np.empty(len(order), np.int32)  # a bucket has a few million n-grams
        at[order] = np.cumsum(fresh, dtype=np.int32) - 1
        del order, fresh, firsts
        starts = _starts(histories)
        leads = np.flatnonzero(starts)
        sums = _class_sums(leads, counts, lower)
        of_history = np.cumsum(starts, dtype=np.int32) - 1
        del lower, starts
        start, out = 0, []
        for chunk, body in zip(chunks, bodies, strict=True):
            own = at[start : start + len(body["n"])]
            begins = np.cumsum(body["run"], dtype=np.int64) - body["run"]
            start += len(own)
            told = {"c": counts[own], "run": body["run"]}
            for i, column in enumerate(sums[of_history[own[begins]]].T):
                told[f"s{i}"] = column
            if named:
                told["id"] = 1 + own.astype(np.int64) * buckets + bucket
            out.append({"_kind": "reply", "_chunk": chunk, "_bucket": bucket, "_body": pack(told)})
        stored = {"history": histories[leads], "run": np.diff([*leads, len(histories)]), "word": words, "c": counts}
        out.append({"_kind": "table", "_chunk": -1, "_bucket": bucket, "_body": pack(stored)})
        split = [[int(histories[leads[i]]), *sums[i].tolist()] for i in np.flatnonzero(np.isin(histories[leads], hot))]
        said = {"of": _of_counts(counts), "split": split}
        out.append({"_kind": "sums", "_chunk": -1, "_bucket": bucket, "_body": json.dumps(said).encode()})
        return _rows(out, ANSWER_ARROW)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "_bucket"):
            yield answered(bucket, rows)  # its arrays are gone before the next bucket comes

    return answer


def _told(body: dict, replies: list[bytes], place: np.ndarray, names: list[str]) -> dict[str, np.ndarray]:
    """Replies of all buckets, in the order of what was sent to them, back in the chunk's own order."""
    parts = [unpack(r) for r in replies]
    back = np.argsort(place, kind="stable")
    out = {}
    for name in names:
        values = np.empty(len(place), np.int64)
        values[back] = np.concatenate(
            [np.repeat(p[name], p["run"]) if name.startswith("s") else p[name] for p in parts]
        )
        out[name] = values
    return out


def _met(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each chunk and the replies to it, one after the other, in as many tasks as there are chunks."""
    replies = answers.filter("_kind = 'reply'").select("_chunk", "_bucket", "_body")
    own = chunks.select("_chunk", F.lit(-1).cast("long").alias("_bucket"), "_body")
    return own.unionByName(replies).repartition("_chunk").sortWithinPartitions("_chunk", "_bucket")


def _named_words(buckets: int):
    """Chunks that know numbers and counts of their words; the words themselves go."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_chunk", pa.int64()), ("_tokens", pa.int64()), ("_body", pa.binary())])
        for chunk, rows in _groups(batches, "_chunk"):
            body = unpack(rows[0][1])
            told = _told(body, [b for _, b in rows[1:]], _word_buckets(_words(body), buckets), ["id", "c"])
            body = {k: v for k, v in body.items() if k not in ("words", "lengths")} | {"id1": told["id"], "c1": told["c"]}
            yield _rows([{"_chunk": chunk, "_tokens": int(body["sizes"].sum()), "_body": pack(body)}], schema)

    return name


SUMS = [f"s{i}" for i in range(2 * (DISCOUNTED + 1))]


def _extended(body: dict, replies: list[bytes], order: int, buckets: int, model: list[Order], named: bool) -> dict:
    """A chunk with the n-grams of one more order: index of each token's, counts and sums of their histories."""
    grams = _grams(body, order)
    hot = np.array(sorted(model[order - 1].hot), np.int64)
    place = _gram_buckets(grams["history"], grams["word"], buckets, hot)
    told = _told(body, replies, place, ["c", *SUMS, *(["id"] if named else [])])
    sums = np.stack([told[s] for s in SUMS], axis=1)
    for number, total in model[order - 1].hot.items():
        sums[grams["history"] == number] = total
    body = body | {f"gram{order}": grams["gram"] + 1, f"c{order}": told["c"]}
    for i in range(sums.shape[1]):
        body[f"s{order}.{i}"] = sums[:, i]
    if named:
        body[f"id{order}"] = told["id"]
    return body


def _mass(sums: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """Total of a history, and the part of it that discounts leave to unseen words.

    Where no discount applies one more count is left to them, so that they always have a share.
    """
    left = sums[:, :DISCOUNTED] @ (1 - order.discounts[1:])
    total = sums.sum(axis=1).astype(float)
    spare = (left <= 0) & (total > 0)
    return total + spare, np.where(spare, 1.0, left)


def _kept(counts: np.ndarray, order: Order) -> np.ndarray:
    """Discounted counts."""
    return counts * order.discounts[np.where(counts <= DISCOUNTED, counts, 0)]


def log_probabilities(body: dict, orders: int, model: list[Order], tokens: int, of_words: np.ndarray) -> np.ndarray:
    """log10 of each token's probability: of its longest seen n-gram, else the history's weight and the order below.

    ``of_words`` has the sums of counts of all words, by class as ``_class_sums``.
    """
    total, left = _mass(of_words[None, :], model[0])
    total, left = (float(total[0]), float(left[0])) if tokens else (1.0, 1.0)
    count = body["c1"].astype(np.int64)
    log = np.log10(np.where(count > 0, _kept(count, model[0]), left) / total)[body["at"]]
    # Total of the history one order below, for each token.
    under = np.full(len(log), total)
    for order in range(2, orders + 1):
        gram = body[f"gram{order}"].astype(np.int64) - 1
        here = gram >= 0
        if not len(body[f"c{order}"]):
            continue
        sums = np.stack([body[f"s{order}.{i}"] for i in range(2 * (DISCOUNTED + 1))], axis=1).astype(np.int64)
        count = body[f"c{order}"].astype(np.int64)
        total, left = _mass(sums[:, : DISCOUNTED + 1], model[order - 1])
        base = np.ones(len(count))
        base[gram[here]] = under[here]
        seen_below = sums[:, DISCOUNTED + 1 :] @ np.append(model[order - 2].discounts[1:], 1.0) / base
        known = total > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(known, left / total / (1 - seen_below), 1.0)
            found = np.log10(_kept(count, model[order - 1]) / total)
            back = np.log10(weight)
        log[here] = np.where(count > 0, found, back)[gram[here]] + np.where(count > 0, 0.0, 1.0)[gram[here]] * log[here]
        under[here] = total[gram[here]]
    return log


OUT = (
    "_key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _scored(orders: int, buckets: int, model: list[Order], tokens: int, types: int, of_words: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "_chunk"):
            body = unpack(rows[0][1])
            if orders > 1:
                body = _extended(body, [b for _, b in rows[1:]], orders, buckets, model, named=False)
            log = log_probabilities(body, orders, model, tokens, of_words)
            count = body["c1"].astype(np.int64)
            base = np.log10((count + 1) / (tokens + types + 1))[body["at"]]
            begins = np.cumsum(body["sizes"], dtype=np.int64) - body["sizes"]
            add = lambda values: np.add.reduceat(values, begins)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(body["ids"].astype(np.int64), mask=body["missing"].astype(bool)),
                    pa.array(body["held"].astype(bool)), pa.array(body["sizes"].astype(np.int64)),
                    pa.array(add((count > 0)[body["at"]].astype(np.int64))),
                    pa.array(np.full(len(begins), tokens, np.int64)), pa.array(add(base)), pa.array(add(log)),
                ],
                names=["_key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return score


def _answered(entries: DataFrame, buckets: int, answer, name: str) -> tuple[DataFrame, list[dict]]:
    """The written answers (their ``table`` rows are the model), and what the buckets say of all n-grams."""
    dealt = entries.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "_chunk")
    answers = settle(dealt.mapInArrow(answer, ANSWER), name)
    said = [json.loads(r["_body"]) for r in answers.filter("_kind = 'sums'").select("_body").toLocalIterator()]
    return answers, said


def _summed(said: list[dict]) -> list[int]:
    return np.sum([s["of"] for s in said], axis=0).tolist() if said else [0] * (DISCOUNTED + 1)


def score_texts(
    docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", order: int = 2,
    bucket_tokens: int = BUCKET_TOKENS,
) -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words between blanks (A-Z as a-z) and an end after the last; a missing text is empty and has the end
    alone. The model learns from the rows for which ``held_out`` is not true: counts of n-grams up to ``order``, none
    left out. ``score`` is the log10 probability of a text's tokens by the model, ``base_score`` by counts of words
    with one added; unseen words are one class. A history's probabilities over all words and that class add up to 1.
    Repeated rows count each time; a missing key is kept. An empty table gives an empty table.

    Shuffles: every chunk's distinct n-grams once for each order, packed, dealt by history (those frequent enough to
    fill a bucket by history and word) to as many buckets as tokens need, and the replies. To the driver come sums of
    buckets, and sums of the frequent histories, fewer than buckets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    thin = docs.select(
        F.col(key).cast("long").alias("_key"), F.coalesce(held_out, F.lit(False)).alias("_held"), F.col(text).alias("_text")
    )
    chunks = settle(thin.mapInArrow(_chunked, CHUNK), "chunks")
    every = chunks.agg(F.sum("_tokens")).first()[0] or 0
    buckets = max(1, -(-every // bucket_tokens))
    entries = chunks.select("_chunk", "_body").mapInArrow(_word_entries(buckets), ENTRY)
    answers, said = _answered(entries, buckets, _word_answers(buckets, every), "words")
    tokens, types = (sum(s[n] for s in said) for n in ("tokens", "types"))
    of = _summed(said)
    small = np.arange(1, DISCOUNTED + 1) * np.array(of[:DISCOUNTED])
    of_words = np.append(small, tokens - small.sum()).astype(np.int64)
    model = [Order(discounts(of))]
    frequent = np.array(sorted({OPENING, *(h for s in said for h in s["hot"])}), np.int64)
    named = settle(_met(chunks, answers).mapInArrow(_named_words(buckets), CHUNK), "named")
    discard(chunks)
    release(spark)
    for k in range(2, order + 1):
        hot = frequent if k == 2 else np.zeros(0, np.int64)
        entries = named.select("_chunk", "_body").mapInArrow(_gram_entries(k, buckets, hot), ENTRY)
        answers, said = _answered(entries, buckets, _gram_answers(buckets, hot, k < order), "grams")
        release(spark)
        sums: dict[int, np.ndarray] = {int(h): np.zeros(len(SUMS), np.int64) for h in hot}
        for s in said:
            for h, *values in s["split"]:
                sums[h] += np.array(values, np.int64)
        model.append(Order(discounts(_summed(said)), sums))
        if k < order:
            grown = settle(_met(named, answers).mapInArrow(_grown(k, buckets, list(model)), CHUNK), "named")
            discard(named)
            named = grown
    joined = _met(named, answers) if order > 1 else named.select("_chunk", "_body")
    scored = joined.mapInArrow(_scored(order, buckets, model, tokens, types, of_words), OUT)
    return scored.withColumnRenamed("_key", key)


def _grown(order: int, buckets: int, model: list[Order]):
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_chunk", pa.int64()), ("_tokens", pa.int64()), ("_body", pa.binary())])
        for chunk, rows in _groups(batches, "_chunk"):
            body = _extended(unpack(rows[0][1]), [b for _, b in rows[1:]], order, buckets, model, named=True)
            yield _rows([{"_chunk": chunk, "_tokens": int(body["sizes"].sum()), "_body": pack(body)}], schema)

    return grow
