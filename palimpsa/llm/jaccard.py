"""Near duplicates: an exact Jaccard join of shingle sets by whole parts, in size-banded tiles with bitmap signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import discard, mix, release, settle, small_batches, text_slices, tidy, whole
from palimpsa.llm.components import components
from palimpsa.llm.shingles import set_id, set_key, shingle_sets

BUCKET_BITS = 22  # counters by which shingles are ordered, rare ones first: 16 MB, whatever the input
CHUNK = 1 << 14
MIN_WIDTH, MAX_WIDTH = 512, 8192  # bits of a signature
BLOCK = 2048  # entries of a tile's side
BROADCAST_PAIRS = 500_000  # 32 bytes each
SLICE = 1 << 19  # bytes of text that a task shingles at a time, if they are more than one text
FILL = 2  # least mean of members that a part has
SEEN = 50_000  # sets that a task remembers so as not to repeat their entries


KEY = np.dtype([("x", "<u8"), ("y", "<u8")])  # the 16 bytes that name a set


def to_keys(names: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Names of sets as a column of bytes."""
    offsets = np.arange(len(names) + 1, dtype=np.int32) * 16
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(names).tobytes())]
    out = pa.Array.from_buffers(pa.binary(), len(names), buffers)
    return out if missing is None else pc.if_else(pa.array(missing), pa.scalar(None, pa.binary()), out)


def from_keys(column: pa.ChunkedArray) -> np.ndarray:
    """The names in a column of bytes; all of them are there and have 16 bytes."""
    parts = []
    for c in column.chunks:
        if len(c):
            start = np.frombuffer(c.buffers()[1], np.int32, 1, c.offset * 4)[0]
            parts.append(np.frombuffer(c.buffers()[2], KEY, len(c), int(start)))
    return np.concatenate(parts) if parts else np.zeros(0, KEY)


@dataclass(frozen=True)
class Threshold:
    """Sets link when ``over * intersection >= under * union``: the similarity is under / over."""

    under: int
    over: int

    def least_partner(self, n: int) -> int:
        return -(-self.under * n // self.over)

    def prefix(self, n: int) -> int:
        """So many of the first members in any common order hold one of each partner's."""
        return n - self.least_partner(n) + 1

    def holds(self, common: np.ndarray | int, sizes: np.ndarray | int) -> np.ndarray | bool:
        """``sizes`` is the sum of both sizes."""
        return (self.over + self.under) * common >= self.under * sizes

    def apart(self, sizes: np.ndarray | int) -> np.ndarray | int:
        """The most members that only one of two linked sets may have."""
        return sizes * (self.over - self.under) // (self.over + self.under)

    @lru_cache(maxsize=4)  # noqa: B019
    def families(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of sizes up to ``largest`` by their least size, and the gap and parts of the family of each.

        A partner's size is in the same class or a neighbouring one. Linked sets of a class, or of it and the one above,
        differ in at most ``gap`` members; so if one of them has more filled parts than that, the other has one of
        those parts just the same. There are no parts where a part would have fewer than ``FILL`` members.
        """
        starts, gaps, parts = [], [], []
        size = 1
        while size <= largest:
            after = max(size + 1, self.over * (size - 1) // self.under + 1)
            gap = self.apart(after - 1 + self.over * (after - 1) // self.under)
            count = gap + 1
            for _ in range(9):  # parts that chance leaves empty come on top
                empty = count * math.exp(-size / count)
                count = gap + 1 + int(empty + 2 * math.sqrt(empty))
            starts.append(size)
            gaps.append(gap)
            parts.append(count if count * FILL <= size else 0)
            size = after
        return np.array(starts, np.int64), np.array(gaps, np.int64), np.array(parts, np.int64)


def signature(values: np.ndarray) -> bytes:
    """A bitmap in which each member flips the bit of its hash; it has about as many bits as members."""
    width = MIN_WIDTH
    while width < min(len(values), MAX_WIDTH):
        width *= 2
    flips = np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((flips & 1).astype(bool), bitorder="little").tobytes()


def folded(bitmap: bytes, width: int) -> np.ndarray:
    """The bitmap at a smaller width: its halves flip each other."""
    words = np.frombuffer(bitmap, np.uint64)
    while len(words) * 64 > width:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def folded_all(bitmaps: list[bytes]) -> np.ndarray:
    """All bitmaps at the least width, a row each."""
    out = np.empty((len(bitmaps), MIN_WIDTH // 64), np.uint64)
    sizes = np.array([len(b) for b in bitmaps])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        words = np.frombuffer(b"".join(bitmaps[i] for i in rows), np.uint64).reshape(len(rows), -1)
        while words.shape[1] > out.shape[1]:
            half = words.shape[1] // 2
            words = words[:, :half] ^ words[:, half:]
        out[rows] = words
    return out


def may_link(a: bytes, b: bytes, sizes: int, rule: Threshold) -> bool:
    """Whether the signatures at their common width leave room for a link."""
    width = 8 * min(len(a), len(b))
    return int(np.bitwise_count(folded(a, width) ^ folded(b, width)).sum()) <= rule.apart(sizes)


def _describe(words: int):
    """Per text its set's size, key and signature, and per task the shingle counters in chunks."""
    shift = np.uint64(64 - BUCKET_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int32)
        for part in text_slices(batches, "_text", SLICE):
            sets = shingle_sets(part.column("_text"), words)
            for values in sets:
                np.add.at(counts, (values >> shift).astype(np.int64), 1)
            names = [set_key(v) for v in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_key"),
                    part.column("_hash"),
                    pa.array([len(v) for v in sets], pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array([set_id(k) for k in names], pa.int64()),
                    pa.array([signature(v) for v in sets], pa.binary()),
                    pa.array([-1] * len(sets), pa.int32()),
                ],
                ["_key", "_hash", "_n", "_set", "_id", "_bits", "_chunk"],
            )
        chunks = counts.reshape(-1, CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(used), pa.int64()),
                pa.nulls(len(used), pa.int64()),
                pa.array([0] * len(used), pa.int64()),
                pa.array([b""] * len(used), pa.binary()),
                pa.nulls(len(used), pa.int64()),
                pa.array([chunks[i].astype(np.min_scalar_type(chunks[i].max())).tobytes() for i in used], pa.binary()),
                pa.array(used.astype(np.int32), pa.int32()),
            ],
            ["_key", "_hash", "_n", "_set", "_id", "_bits", "_chunk"],
        )
        del chunks, counts
        tidy()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, bits in zip(batch.column("_chunk").to_pylist(), batch.column("_bits"), strict=True):
            # Counters of a task come as narrow as they fit.
            own = np.frombuffer(bits.as_buffer(), f"<u{len(bits.as_buffer()) // CHUNK}").astype(np.int64)
            sums[chunk] = sums[chunk] + own if chunk in sums else own
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(sums), pa.int32()),
            pa.array([np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in sums.values()], pa.binary()),
        ],
        ["_chunk", "_bits"],
    )


def _part_keys(rule: Threshold, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the parts of each set and the index of its set, and which sets have too few filled parts in a family."""
    sizes = np.array([len(v) for v in sets], np.int64)
    starts, gaps, parts = rule.families(1 << int(sizes.max(initial=1)).bit_length())
    own = np.searchsorted(starts, sizes, "right") - 1
    values = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    high, mixed = values >> np.uint64(32), mix(values)
    few = np.zeros(len(sets), bool)
    keys, holders = [], []
    for family in (own, own - 1):
        used = (family >= 0) & (gaps[family] > 0)
        rows = np.flatnonzero((used & (parts[family] > 0))[owner])
        of = owner[rows]
        # Members are sorted, so those of a part stand side by side.
        part = (high[rows] * parts[family].astype(np.uint64)[of]) >> np.uint64(32)
        first = np.ones(len(rows), bool)
        first[1:] = (of[1:] != of[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(first)
        if len(at):
            name = mix((family[of[at]].astype(np.uint64) << np.uint64(32)) + part[at] + np.uint64(1))
            keys.append(mix(np.add.reduceat(mixed[rows], at) + name))
            holders.append(of[at])
        few |= used & (np.bincount(of[at], minlength=len(sets)) <= gaps[family])
    none = np.zeros(0, np.int64)
    return np.concatenate([*keys, none.astype(np.uint64)]), np.concatenate([*holders, none]), few


def _entries(words: int, rule: Threshold, counters):
    """(key, set) for the parts of each set, or also its rarest shingles if they are too few; a task sends a set once."""
    shift = np.uint64(64 - BUCKET_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        counts = counters.value
        for part in text_slices(batches, "_text", SLICE):
            sets, ids = [], []
            for values in shingle_sets(part.column("_text"), words):
                key = set_key(values)
                if len(values) == 0 or key in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(key)
                sets.append(values)
                ids.append(set_id(key))
            if not sets:
                continue
            keys, owner, few = _part_keys(rule, sets)
            tokens, holders = [keys], [owner]
            for i in np.flatnonzero(few).tolist():
                values = sets[i]
                rank = np.argsort(counts[(values >> shift).astype(np.int64)], kind="stable")
                tokens.append(values[rank[: rule.prefix(len(values))]])
                holders.append(np.full(len(tokens[-1]), i))
            names = np.array(ids, np.int64)[np.concatenate(holders)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(names)], ["_token", "_id"]
            )
        tidy()

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries: those whose key another set has too, each but the first with the first such set."""
    held = pa.schema([("_token", pa.int64()), ("_id", pa.int64())]).empty_table()
    last = None  # key and first set of the last judged entry

    def cut(rows: pa.Table, before, final: bool) -> tuple[pa.RecordBatch | None, pa.Table, object]:
        token, ids = rows.column("_token").to_numpy(), rows.column("_id").to_numpy()
        # Copies of a set's entry stand side by side; the first of them counts.
        first = np.ones(len(rows), bool)
        first[1:] = (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])
        rows, token, ids = rows.filter(pa.array(first)), token[first], ids[first]
        # The last row is judged when the one after it is known.
        stop = len(token) if final else len(token) - 1
        if stop <= 0:
            return None, rows, before
        same = np.zeros(len(token) + 1, bool)
        same[1:-1] = token[1:] == token[:-1]
        same[0] = before is not None and before[0] == token[0]
        heads = np.maximum.accumulate(np.where(same[:-1], -1, np.arange(len(token))))
        head = ids[np.maximum(heads, 0)]
        if before is not None:
            head[heads < 0] = before[1]
        # An entry is kept if another set has its key too.
        keep = np.flatnonzero((same[:-1] | same[1:])[:stop])
        out = pa.RecordBatch.from_arrays(
            [pa.array(token[keep]), pa.array(ids[keep]), pa.array(head[keep], mask=~same[keep])],
            ["_token", "_id", "_before"],
        )
        return out, rows.slice(stop), (token[stop - 1], head[stop - 1])

    for batch in batches:
        out, held, last = cut(pa.concat_tables([held, pa.Table.from_batches([batch])]), last, False)
        if out is not None:
            yield out
    out, held, last = cut(held, last, True)
    if out is not None:
        yield out


PAIR = "a binary, b binary"
SIGNED = "_set binary, _id long, _n long, _bits binary, _hash long"
TILE = ["_token", "_band", "_low", "_high"]


def _tiles(rule: Threshold, one_each: bool):
    """Sorted tile members: pairs of different components that sizes and signatures allow to link.

    ``one_each``: only the nearest such partner above each member.
    """

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        tile = np.stack([rows.column(c).to_numpy() for c in TILE], axis=1)
        n, side = (rows.column(c).to_numpy() for c in ("_n", "_side"))
        names, root = from_keys(rows.column("_set")), from_keys(rows.column("_root"))
        bits = folded_all(rows.column("_short").to_pylist())
        number = np.concatenate([[0], np.cumsum((tile[1:] != tile[:-1]).any(axis=1))])
        end = np.searchsorted(number, number, "right")
        out = []
        live, step = np.arange(len(n)), 1
        met = np.zeros(len(n), bool)
        # Members of a tile stand by size: once a member's partner is too large, so are all after it.
        while len(live):
            live = live[live + step < end[live]]
            live = live[rule.under * n[live + step] <= rule.over * n[live]]
            i, j = live, live + step
            near = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] == 2))
            i, j = i[near], j[near]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            near = apart <= rule.apart(n[i] + n[j])
            out.append(np.stack([i[near], j[near]], axis=1))
            if one_each:
                met[i[near]] = True
                live = live[~met[live]]
            step += 1
        found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        x, y = names[found[:, 0]], names[found[:, 1]]
        return pa.RecordBatch.from_arrays([to_keys(x), to_keys(y)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 4 * BLOCK or not batch.num_rows:
                continue
            table = pa.Table.from_batches(held)
            same = np.ones(size, bool)
            for c in TILE:
                values = table.column(c).to_numpy()
                same &= values == values[-1]
            last = int(np.argmax(same))  # the last tile may go on
            if last:
                yield pairs(table.slice(0, last))
                held, size = table.slice(last).to_batches(), size - last
        if size:
            yield pairs(pa.Table.from_batches(held))

    return run


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures with a second one of the least width, which tiles compare."""
    for batch in batches:
        short = folded_all(batch.column("_bits").to_pylist())
        values = pa.array([row.tobytes() for row in short], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "_short"])


def _possible(rule: Threshold):
    """Pairs whose signatures leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("_bits_a").to_pylist(), batch.column("_bits_b").to_pylist()
            sizes = batch.column("_n_a").to_numpy() + batch.column("_n_b").to_numpy()
            apart = np.bitwise_count(folded_all(left) ^ folded_all(right)).sum(axis=1, dtype=np.int64)
            near = apart <= rule.apart(sizes)
            for i in np.flatnonzero(near):
                near[i] = may_link(left[i], right[i], int(sizes[i]), rule)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _verified(words: int, rule: Threshold):
    """Pairs of texts whose sets really link: an intersection of sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_text_a", 1 << 19):
            left = shingle_sets(part.column("_text_a"), words)
            right = shingle_sets(part.column("_text_b"), words)
            linked = np.zeros(part.num_rows, bool)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                both = np.sort(np.concatenate([x, y]))
                linked[i] = rule.holds(int((both[1:] == both[:-1]).sum()), len(x) + len(y))
            yield part.select(["a", "b"]).filter(pa.array(linked))

    return run


def _links(pairs: DataFrame, rows: DataFrame, signed: DataFrame, words: int, rule: Threshold, name: str) -> DataFrame:
    """The pairs that link. Only texts that they need are fetched, by a hash of the text; the others stay in place."""
    pairs = settle(pairs, "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("_set")).distinct()
    hashes = needed.join(signed.select("_set", "_hash"), "_set").select("_hash").distinct()
    if pairs.count() <= BROADCAST_PAIRS:
        needed, hashes = F.broadcast(needed), F.broadcast(hashes)
    fetched = rows.select("_hash", "_text").join(hashes, "_hash", "left_semi").select("_text")
    # Another text may have the hash of a needed one, so the sets decide.
    named = fetched.mapInArrow(_named(words), "_set binary, _text string").join(needed, "_set", "left_semi")
    texts = settle(named.dropDuplicates(["_set"]), "texts")
    sides = [texts.select(F.col("_set").alias(s), F.col("_text").alias(f"_text_{s}")) for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "_text_a", "_text_b")
    links = settle(joined.mapInArrow(_verified(words, rule), PAIR), name)
    discard(pairs, texts)
    release(pairs.sparkSession)
    return links


def similarity_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 5,
    similarity: tuple[int, int] = (80, 100),
) -> DataFrame:
    """One row per input row: key, n_shingles, component_id.

    A text's set is its distinct shingles of ``words`` words (bytes other than blanks and tab to carriage return, A-Z
    as a-z); with fewer words its whole sequence is one, without words the set is empty. Texts link when
    ``100 * intersection >= 80 * union`` (both numbers by ``similarity``); an empty set links with nothing.
    ``component_id`` is the least key that links lead to, the row's own included; a missing key is passed over unless
    the component has no other. Rows may repeat: rows with an empty set are alone, others share their component.
    Keys are whole numbers. Other columns are ignored; an empty table gives an empty table.

    Texts with equal sets count once from the first step on, so copies never meet each other. A set is dealt to parts
    by the hashes of its shingles, more parts than linked sets may have different shingles, so partners have a whole
    part in common, which texts that share some shingles by chance do not. A set sends the hashes of its parts; one that
    fills too few of them also its rarest shingles (a prefix that any partner must touch), as all do where the
    similarity is so low that parts would be nearly empty. Keys of one set drop out, and candidates are verified by
    their whole sets: first each set against the first one that shares keys with it, which joins
    most groups, then whatever tiles of different components still allow. Tiles of a hot key are split into bands of sizes and blocks of at most ``BLOCK`` sets.
    """
    rule = Threshold(*similarity)
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.xxhash64(whole(text)).alias("_hash"), whole(text).alias("_text"))
    shape = "_key long, _hash long, _n long, _set binary, _id long, _bits binary, _chunk int"
    described = settle(rows.mapInArrow(_describe(words), shape), "sets")
    thin = described.filter("_chunk < 0").select("_key", "_n", "_set")
    chunks = described.filter("_chunk >= 0").select("_chunk", "_bits").repartition("_chunk")
    counts = np.zeros(1 << BUCKET_BITS, np.int32)
    for row in chunks.mapInArrow(_summed, "_chunk int, _bits binary").collect():  # 256 chunks of 64 KB
        counts[row["_chunk"] * CHUNK : (row["_chunk"] + 1) * CHUNK] = np.frombuffer(row["_bits"], np.int32)
    counters = spark.sparkContext.broadcast(counts)

    # Most entries of the table meet no other; they are sorted as two numbers, and only those that meet get the set's name.
    sent = rows.mapInArrow(_entries(words, rule, counters), "_token long, _id long")
    sorted_entries = sent.repartition("_token").sortWithinPartitions("_token", "_id")
    meetings = settle(sorted_entries.mapInArrow(_neighbours, "_token long, _id long, _before long"), "meetings")
    release(spark)
    wanted = meetings.select("_id").distinct()

    signed = described.filter("_n > 0").select("_set", "_id", "_n", "_bits", "_hash").join(wanted, "_id", "left_semi")
    signed = signed.select("_set", "_id", "_n", "_bits", "_hash")
    signed = settle(signed.dropDuplicates(["_set"]).mapInArrow(_shortened, f"{SIGNED}, _short binary"), "signed")
    entries = meetings.select("_token", "_id").join(signed.select("_id", "_set", "_n"), "_id")
    entries = settle(entries.select("_token", "_set", "_n"), "entries")

    def possible(pairs: DataFrame) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(signed.select(F.col("_set").alias(s), F.col("_n").alias(f"_n_{s}"), F.col("_bits").alias(f"_bits_{s}")), s)
        return pairs.mapInArrow(_possible(rule), PAIR)

    # Pairs with one shared key only are left to the tiles; most of them do not link.
    heads = meetings.filter("_before is not null").groupBy("_id", "_before").agg(F.count("*").alias("_shared"))
    heads = heads.filter("_shared > 1")
    for s, i in (("a", "_id"), ("b", "_before")):
        heads = heads.join(signed.select(F.col("_id").alias(i), F.col("_set").alias(s)), i)
    heads = heads.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = _links(possible(heads), rows, signed, words, rule, "first-links")
    discard(meetings)
    roots = components(first)

    def swept(roots: DataFrame, one_each: bool) -> DataFrame:
        """Links that the tiles of shingles with sets of different components still allow."""
        placed = entries.select("_token", "_set", "_n").join(roots.withColumnRenamed("node", "_set"), "_set", "left")
        placed = placed.select("_token", "_set", "_n", F.coalesce("root", "_set").alias("_root"))
        split = placed.groupBy("_token").agg(F.min("_root").alias("_x"), F.max("_root").alias("_y")).filter("_x <> _y")
        open_entries = settle(placed.join(split.select("_token"), "_token", "left_semi"), "open")
        ratio = float(np.log(rule.over / rule.under)) * (1 + 1e-9)  # rounding must not push partners two bands apart
        banded = open_entries.withColumn("_band", F.floor(F.log(F.col("_n").cast("double")) / ratio).cast("long"))
        # A set meets its own band (as the upper side, with the band below as the lower side of the same tile).
        homes = banded.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_up"))
        homes = homes.withColumn("_band", F.col("_band") + F.col("_up"))
        loads = homes.groupBy("_token", "_band").agg(F.count("*").alias("_load"), F.max(F.col("_up") == 0).alias("_used"))
        loads = loads.filter("_load > 1 and _used").select("_token", "_band", F.ceil(F.col("_load") / BLOCK).alias("_blocks"))
        members = homes.join(loads, ["_token", "_band"]).withColumn("_own", F.pmod(F.xxhash64("_set"), F.col("_blocks")))
        members = members.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        tiles = (
            members.select(
                "_token", "_band", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"),
                "_set", "_n", "_root",
                F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1).alias("_side"),
            )
            .join(signed.select("_set", "_short"), "_set")
            .repartition(*TILE)
            .sortWithinPartitions(*TILE, "_n", "_set")
        )
        found = tiles.mapInArrow(_tiles(rule, one_each), PAIR)
        candidates = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = _links(possible(candidates), rows, signed, words, rule, "tile-links")
        discard(open_entries)
        return links

    # One partner for each member first: it joins what is left of large groups, so that the whole sweep finds few pairs.
    links = first.unionByName(swept(roots, one_each=True))
    links = links.unionByName(swept(components(links), one_each=False))
    discard(entries, signed)
    roots = components(links)

    ids = thin.join(roots.withColumnRenamed("node", "_set"), "_set", "left")
    alone = F.col("_n") == 0
    ids = ids.select("_key", "_n", F.when(~alone, F.coalesce("root", "_set")).alias("_root"))
    least = ids.filter("_root is not null").groupBy("_root").agg(F.min("_key").alias("_least"))
    linked = ids.filter("_root is not null").join(least, "_root")
    out = linked.select("_key", "_n", "_least").unionByName(
        ids.filter("_root is null").select("_key", "_n", F.col("_key").alias("_least"))
    )
    return out.select(
        F.col("_key").alias(key), F.col("_n").alias("n_shingles"), F.col("_least").alias("component_id")
    )


def _named(words: int):
    """(set, text), each set once per task as far as its memory of sets reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in text_slices(batches, "_text", SLICE):
            keys = [set_key(v) for v in shingle_sets(part.column("_text"), words)]
            fresh = []
            for k in keys:
                fresh.append(k not in seen)
                if len(seen) < SEEN:
                    seen.add(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), part.column("_text")], ["_set", "_text"]
            ).filter(pa.array(fresh))

    return run


def drop_near(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: tuple[int, int] = (80, 100)
) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: of each component exactly one, the row with the least key.

    A missing key comes after all others; of rows that repeat the least key one stays (which one is not defined). Rows
    with an empty set all stay. Rows are told apart by a number that is written with them.
    """
    names = docs.columns
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_id"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_whole"),
    )
    rows = settle(rows, "rows")
    bodies = rows.select("_row", F.col(f"_whole.`{text}`").alias("_body"))
    classes = settle(similarity_classes(bodies, "_row", "_body", words, similarity).filter("n_shingles > 0"), "classes")
    order = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row")
    stay = classes.join(rows.select("_row", "_id"), "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    gone = settle(classes.select("_row").join(stay.select("_row"), "_row", "left_anti"), "gone")
    discard(classes)
    release(docs.sparkSession)
    return rows.join(gone, "_row", "left_anti").select(*[F.col(f"_whole.`{c}`") for c in names])
