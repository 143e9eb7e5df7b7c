"""Repeated byte strings: a deep-shallow suffix sort of the windows around shared anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import GOLD, mix, settle, text_bytes, text_slices, whole

LENGTH = 200
GRAM = 40  # bytes of an anchor
SHALLOW = 4  # words of eight bytes that the quicksort looks at; blind tries go on from there
CHUNK = 1 << 20  # window starts of a long text that are looked at together
SORTED_AT_ONCE = 1 << 17  # windows
GROUP_CONTEXTS = 1 << 15  # contexts of an anchor that one task sorts; more of them meet by fingerprints
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Fingerprints:
    """Hashes of any stretch of a run of bytes, from one pass over it."""

    def __init__(self, run: np.ndarray, seed: int = 1) -> None:
        values = mix((np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000)) * GOLD)
        self.sums = np.zeros(len(run) + 1, np.uint64)
        np.cumsum(values[run] * _powers(BASE, len(run))[:-1], out=self.sums[1:])
        self.down = _powers(pow(BASE, -1, 1 << 64), len(run))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values side by side."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(run: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The anchor contexts of a run of texts: for each, the text and stretch of windows that choose the same anchor.

    A window's anchor is its gram of the least hash, the leftmost of equal ones, so equal windows have equal anchors
    at equal places. ``low``/``count``: first window and how many; ``at``: the anchor; all as positions in the run.
    """
    wide = length - gram + 1
    if len(run) < length:
        return {k: np.zeros(0, np.int64) for k in ("text", "low", "count", "at", "anchor", "context")}
    prints = Fingerprints(run)
    place = np.arange(len(run) - gram + 1)
    hashes = prints.of(place, place + gram)
    ranked = (hashes & ~np.uint64((1 << 24) - 1)) | place.astype(np.uint64)
    chosen = (sliding_least(ranked, wide) & np.uint64((1 << 24) - 1)).astype(np.int64)
    # Windows inside one text only.
    text = np.searchsorted(bounds, np.arange(len(chosen)), "right") - 1
    valid = np.arange(len(chosen)) + length <= bounds[text + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return {k: np.zeros(0, np.int64) for k in ("text", "low", "count", "at", "anchor", "context")}
    own = chosen[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (text[start[1:]] != text[start[:-1]])
    first = np.flatnonzero(fresh)
    low, at = start[first], own[first]
    count = np.diff(np.append(first, len(start)))
    inner = prints.of(low, low + count + length - 1) + mix((at - low).astype(np.uint64) * GOLD + count.astype(np.uint64))
    return {
        "text": text[low], "low": low, "count": count, "at": at,
        "anchor": hashes[at].astype(np.int64), "context": inner.astype(np.int64),
    }


def _pieces(part: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, row of each text, offset of each text) of a slice; a long text comes in overlapping chunks."""
    run, bounds = text_bytes(part.column("_text"))
    if len(run) <= 4 * CHUNK:
        yield run, bounds, np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
        return
    for row in range(part.num_rows):
        for start in range(bounds[row], max(bounds[row] + 1, bounds[row + 1] - length + 1), CHUNK):
            piece = run[start : min(bounds[row + 1], start + CHUNK + length - 1)]
            yield piece, np.array([0, len(piece)]), np.array([row]), np.array([start - bounds[row]])


ROW = "_one long, _two long, _anchor long, _context long, _low int, _count int, _left int"


def _anchored(length: int, gram: int):
    """Anchor contexts of every text. ``_sure``: the anchor repeats in this slice; ``_probe``: only tells others so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_text"):
            one, two = (part.column(c).to_numpy() for c in ("_one", "_two"))
            for data, bounds, rows, offsets in _pieces(part, length):
                found = anchors(data, bounds, length, gram)
                if not len(found["low"]):
                    continue
                row = rows[found["text"]]
                low = found["low"] - bounds[found["text"]] + offsets[found["text"]]
                _, first, inverse, times = np.unique(
                    found["anchor"], return_index=True, return_inverse=True, return_counts=True
                )
                sure = times[inverse] > 1
                probes = first[times > 1]
                pick = np.concatenate([np.arange(len(low)), probes])
                probe = np.zeros(len(pick), bool)
                probe[len(low) :] = True
                columns = {
                    "_one": one[row], "_two": two[row], "_anchor": found["anchor"], "_context": found["context"],
                    "_low": low.astype(np.int32), "_count": found["count"].astype(np.int32),
                    "_left": (found["at"] - found["low"]).astype(np.int32), "_sure": sure,
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[pick]) for v in columns.values()] + [pa.array(probe)], [*columns, "_probe"]
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows: those whose anchor another row has too, or that are sure of it; probes go."""
    names = [c.split()[0] for c in ROW.split(", ")]
    held: pa.Table | None = None
    before = None

    def judge(rows: pa.Table, before: int | None, final: bool) -> tuple[pa.Table, pa.Table, int | None]:
        anchor = rows.column("_anchor").to_numpy()
        stop = len(anchor) if final else len(anchor) - 1
        same = np.zeros(len(anchor) + 1, bool)
        same[1:-1] = anchor[1:] == anchor[:-1]
        same[0] = before is not None and len(anchor) > 0 and anchor[0] == before
        sure, probe = (rows.column(c).to_numpy() for c in ("_sure", "_probe"))
        keep = (sure | same[:-1] | same[1:]) & ~probe
        out = rows.slice(0, stop).filter(pa.array(keep[:stop])).select(names)
        return out, rows.slice(stop), int(anchor[stop - 1]) if stop > 0 else before

    for batch in batches:
        table = pa.Table.from_batches([batch])
        rows = table if held is None else pa.concat_tables([held, table])
        if len(rows):
            out, held, before = judge(rows, before, False)
            yield from out.to_batches()
    if held is not None:
        yield from judge(held, before, True)[0].to_batches()


def _context_bytes(length: int):
    """The bytes of the contexts that a text stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_text"):
            data, bounds = text_bytes(part.column("_text"))
            lists = part.column("_stands")
            flat = lists.flatten()
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            names = ["_anchor", "_context", "_low", "_count", "_left", "_times"]
            anchor, context, low, count, left, times = (flat.field(n) for n in names)
            start = bounds[row] + low.to_numpy()
            size = count.to_numpy() + length - 1
            ends = np.cumsum(size, dtype=np.int64)
            index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
            offsets = np.concatenate([[0], ends]).astype(np.int64)
            body = pa.Array.from_buffers(
                pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[index])]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [anchor, context, count, left, times, body], ["_anchor", "_context", "_count", "_left", "_times", "_body"]
            )

    return run


def words_at(run: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number in byte order."""
    padded = np.concatenate([run, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(run), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(run)]
    return out


def tied_windows(run: np.ndarray, start: np.ndarray, group: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """Which windows have an equal one in their group, or stand for several places.

    A deep-shallow sort. Shallow: a multikey quicksort that splits every group by one word of eight bytes after the
    other, dropping windows that are alone. Deep: a blind trie for each group that is left, all grown at once level by
    level: a word that all members share is skipped, one that differs makes a branch; members of a leaf are equal.
    """
    words = words_at(run)
    depths = [*range(0, length - 7, 8)]
    if length % 8:
        depths.append(length - 8)
    live = np.argsort(group, kind="stable")
    segment = group[live]
    repeated = np.zeros(len(start), bool)

    def compact(live: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of segments with more than one member, and the number of the segment of each."""
        number = np.cumsum(fresh) - 1
        many = np.bincount(number)[number] > 1
        return live[many], number[many]

    fresh = np.ones(len(live), bool)
    fresh[1:] = segment[1:] != segment[:-1]
    live, segment = compact(live, fresh)
    for level, depth in enumerate(depths):
        if not len(live):
            break
        word = words[start[live] + depth]
        heads = np.ones(len(live), bool)
        heads[1:] = segment[1:] != segment[:-1]
        if level < SHALLOW:
            order = np.lexsort((word, segment))
            live, segment, word = live[order], segment[order], word[order]
        else:
            first = np.flatnonzero(heads)
            number = np.cumsum(heads) - 1
            apart = np.bincount(number, word != word[first][number]) > 0
            branch = np.flatnonzero(apart[number])
            if not len(branch):
                continue
            order = branch[np.lexsort((word[branch], segment[branch]))]
            live[branch], word[branch] = live[order], word[order]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (segment[1:] != segment[:-1]) | (word[1:] != word[:-1])
        live, segment = compact(live, fresh)
    repeated[live] = True
    return repeated | (times > 1)


def _packed(flags: np.ndarray, counts: np.ndarray) -> list[bytes]:
    cuts = np.concatenate([[0], np.cumsum(counts)])
    return [np.packbits(flags[a:b], bitorder="little").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _sorted_contexts(length: int):
    """Rows in order of anchors: the repeated windows of each context as bits. A group's windows are sorted together."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        anchor = table.column("_anchor").to_numpy()
        count, left, times = (table.column(c).to_numpy().astype(np.int64) for c in ("_count", "_left", "_times"))
        run, bounds = text_bytes(table.column("_body").combine_chunks())
        number = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])]) if len(anchor) else anchor
        # Windows at another distance from the anchor differ, so a distance is sorted by itself.
        which = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        distance = left[which] - nth
        flags = np.zeros(len(which), bool)
        order = np.lexsort((distance, number[which]))
        key = number[which][order] * (1 << 20) + distance[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        at = 0
        while at < len(cuts) - 1:
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + SORTED_AT_ONCE, "right")) - 1)
            part = order[cuts[at] : cuts[to]]
            flags[part] = tied_windows(
                run, bounds[which[part]] + nth[part], key[cuts[at] : cuts[to]], times[which[part]], length
            )
            at = to
        names = [table.column(c).combine_chunks() for c in ("_anchor", "_context")]
        out = pa.RecordBatch.from_arrays(
            [*names, pa.array(_packed(flags, count), pa.binary())], ["_anchor", "_context", "_bits"]
        )
        some = np.bincount(which, flags, minlength=len(count)) > 0
        yield out.filter(pa.array(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in text_slices(iter([batch]), "_body", 1 << 18):
                held.append(part)
                size += part.num_rows
                if size < 1024:
                    continue
                table = pa.Table.from_batches(held)
                anchor = table.column("_anchor").to_numpy()
                last = int(np.searchsorted(anchor, anchor[-1], "left"))  # the last group may go on
                if last:
                    yield from solve(table.slice(0, last))
                    held = table.slice(last).to_batches()
                    size = len(anchor) - last
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _fingerprinted(length: int):
    """Windows of contexts as 128-bit fingerprints, with their place in the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_body", 1 << 17):
            data, bounds = text_bytes(part.column("_body"))
            count = part.column("_count").to_numpy().astype(np.int64)
            which = np.repeat(np.arange(len(count)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            start = bounds[which] + nth
            one, two = (Fingerprints(data, s).of(start, start + length).astype(np.int64) for s in (1, 2))
            columns = [part.column(c).take(pa.array(which)) for c in ("_anchor", "_context", "_times")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(nth.astype(np.int32)), pa.array(one), pa.array(two)],
                ["_anchor", "_context", "_times", "_nth", "_x", "_y"],
            )

    return run


def _cleared(length: int):
    """What is left of each text without the bytes that repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_text"):
            data, bounds = text_bytes(part.column("_text"))
            windows = np.zeros(len(data) + 1, np.int64)  # one where a repeated window starts
            lists = part.column("_hits")
            flat = lists.flatten()
            if len(flat):
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                low = bounds[row] + flat.field("_low").to_numpy()
                packed, cuts = text_bytes(flat.field("_bits"))
                sizes = 8 * np.diff(cuts)
                flags = np.unpackbits(packed, bitorder="little").astype(bool)
                places = np.arange(len(flags)) + np.repeat(low - 8 * cuts[:-1], sizes)
                windows[places[flags] + 1] = 1
            np.cumsum(windows, out=windows)
            covered = windows[1:].copy()
            covered[length:] -= windows[1:][:-length] if len(data) > length else 0
            covered = covered > 0
            begins = covered.copy()
            begins[1:] &= ~covered[:-1]
            starts = bounds[:-1][bounds[:-1] < len(data)]
            begins[starts] = covered[starts]
            removed = np.concatenate([[0], np.cumsum(covered)])
            spans = np.concatenate([[0], np.cumsum(begins)])
            kept = [data[a:b][~covered[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_key"), pa.array(np.diff(bounds)), pa.array(np.diff(removed[bounds])),
                    pa.array(np.diff(spans[bounds])), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                    pa.array(kept, pa.binary()),
                ],
                ["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left).

    Texts are UTF-8 bytes (a missing one is empty). A byte goes when a string of ``length`` bytes that covers it also
    starts elsewhere, in the same or another text; strings never cross texts, overlaps count, and all strings are judged
    on the input. A span is a maximal run of bytes that go. Rows may repeat: each is a text of its own. Texts shorter
    than ``length`` stay whole. Other columns are ignored; an empty table gives an empty table. ``kept`` may end inside
    a sign of several bytes.

    Every window of ``length`` bytes chooses an anchor in itself by its bytes alone, so equal windows have equal anchors
    and only stretches (contexts) around anchors that occur twice are looked at. Equal contexts count once, with how
    often they occur. Each anchor's contexts are sorted in one task; an anchor with more than ``GROUP_CONTEXTS`` different
    contexts has its windows counted by 128-bit fingerprints instead, which any number of tasks share.
    """
    named = docs.select(F.col(key).alias("_key"), whole(text).alias("_text"))
    named = named.select(
        "_key", F.xxhash64("_key", F.lit(1)).alias("_one"), F.xxhash64("_text", F.lit(2)).alias("_two"), "_text"
    )
    shape = f"{ROW}, _sure boolean, _probe boolean"
    marked = named.select("_one", "_two", "_text").mapInArrow(_anchored(length, gram), shape)
    # Rows that are sure already are dealt anywhere; so a hot anchor sends one row per slice to its own partition.
    alone = F.col("_sure") & ~F.col("_probe")
    dealt = marked.repartition(F.when(alone, F.xxhash64("_one", "_low")).otherwise(F.col("_anchor")))
    dealt = dealt.sortWithinPartitions("_anchor")
    found = settle(dealt.mapInArrow(_repeated, ROW), "anchors")

    contexts = found.groupBy("_anchor", "_context").agg(
        F.count("*").alias("_times"), F.min(F.struct("_one", "_two", "_low", "_count", "_left")).alias("_stand")
    )
    contexts = contexts.select("_anchor", "_context", "_times", "_stand.*")
    stands = contexts.groupBy("_one", "_two").agg(
        F.collect_list(F.struct("_anchor", "_context", "_low", "_count", "_left", "_times")).alias("_stands")
    )
    once = named.select("_one", "_two", "_text").join(stands, ["_one", "_two"])
    # Rows that repeat key and text stand for the same contexts: one of them is enough.
    bodies = once.select("_text", "_stands").mapInArrow(
        _context_bytes(length), "_anchor long, _context long, _count int, _left int, _times long, _body binary"
    )
    bodies = settle(bodies.dropDuplicates(["_anchor", "_context"]), "contexts")

    crowded = bodies.groupBy("_anchor").agg(F.count("*").alias("_n")).filter(F.col("_n") > GROUP_CONTEXTS)
    crowded = settle(crowded.select("_anchor"), "crowded")
    few = bodies.join(crowded, "_anchor", "left_anti").repartition("_anchor").sortWithinPartitions("_anchor")
    solved = few.mapInArrow(_sorted_contexts(length), "_anchor long, _context long, _bits binary")
    windows = bodies.join(crowded, "_anchor", "left_semi").mapInArrow(
        _fingerprinted(length), "_anchor long, _context long, _times long, _nth int, _x long, _y long"
    )
    equal = windows.groupBy("_x", "_y").agg(F.sum("_times").alias("_n")).filter("_n > 1").select("_x", "_y")
    counted = windows.join(equal, ["_x", "_y"]).groupBy("_anchor", "_context").agg(F.collect_list("_nth").alias("_nths"))
    counted = counted.mapInArrow(_bits, "_anchor long, _context long, _bits binary")
    flagged = settle(solved.unionByName(counted), "flagged")

    hits = found.join(flagged, ["_anchor", "_context"]).groupBy("_one", "_two").agg(
        F.collect_set(F.struct("_low", "_bits")).alias("_hits")
    )
    judged = named.join(hits, ["_one", "_two"], "left").select("_key", "_text", "_hits")
    kind = dict(docs.dtypes)[key]
    out = judged.mapInArrow(
        _cleared(length),
        f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
    return out.withColumnRenamed("_key", key)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in a context as bits."""
    for batch in batches:
        out = []
        for places in batch.column("_nths").to_pylist():
            flags = np.zeros(max(places) + 1, bool)
            flags[places] = True
            out.append(np.packbits(flags, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_anchor"), batch.column("_context"), pa.array(out, pa.binary())], ["_anchor", "_context", "_bits"]
        )
