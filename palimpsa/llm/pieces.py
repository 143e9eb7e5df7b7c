"""SentencePiece encoding and decoding: Viterbi over all words of a length at once, in numpy.

For a unigram model the best path has the greatest sum of scores. For a BPE model sums of scores are not what the model
means (its scores are ranks of merges), so there the path is the one whose neighbours are all compatible: two pieces
next to each other are what the merges make of their own two strings. Every prefix has exactly one such path, and it is
the one that merging gives, so both kinds of model take the same tables, rounds and backpointers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import GOLD, mix, small_batches, tidy
from palimpsa.llm.streams import array_slices

MARK = 0x2581  # stands for a blank inside pieces
LITERAL = 0x110000  # stands for that sign itself in a text, so that it is not taken for a blank
UNKNOWN_PENALTY = 10.0
NEVER = np.int64(2**62)
FACTOR = np.uint64(0x100000001B3)
SLICE_BYTES, SLICE_ROWS = 1 << 20, 2048
ROUND, LONG_ROUND = 1 << 19, 1 << 21  # entries of the tables of a round
MAY_BITS = 20
LONG = 2048  # signs from which a word is cut into segments
SEGMENT, LEAD = 512, 64  # signs of a segment, and before it
HASHED = 64  # signs up to which words are hashed together, and remembered


@dataclass(frozen=True)
class Merges:
    """What a BPE model's pieces are made of, by piece id."""

    rank: np.ndarray  # when a piece is made; -1 for single signs
    left: np.ndarray  # the two pieces it is made of at last
    right: np.ndarray
    pairs: np.ndarray  # pairs that merge (left << 32 | right), in order
    made: np.ndarray  # the rank of what each pair makes

    def meets(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which two neighbours merge, or the largest number."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the strings of both pieces together leaves just these two.

        Goes back in time from both pieces: while two neighbours at the bound both stand there, they must not merge
        before either is used up on its own side. On equal ranks the pair further left comes first.
        """
        out = np.ones(len(left), bool)
        live = np.arange(len(left))
        a, b, limit = left.copy(), right.copy(), np.full(len(left), NEVER)
        while len(live):
            crossed = self.meets(a, b) < limit
            out[live[crossed]] = False
            more = ~crossed & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            live, a, b = live[more], a[more], b[more]
            undo = self.rank[a] > self.rank[b]
            limit = np.where(undo, self.rank[a], self.rank[b] + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out


@dataclass(frozen=True)
class PieceModel:
    """Pieces of a model file by number, and their hashes in order for the search."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    unknown: float
    byte_ids: np.ndarray
    texts: tuple[bytes, ...]  # what each piece decodes to
    merges: Merges | None = None

    @cached_property
    def may_be(self) -> np.ndarray:
        """Whether any key begins with these bits."""
        out = np.zeros(1 << MAY_BITS, bool)
        out[self.keys >> np.uint64(64 - MAY_BITS)] = True
        return out


class Memory:
    """What a task has found out: words by hash, and compatible pairs in a table of fixed size."""

    WORDS, PAIRS = 100_000, 1 << 20

    def __init__(self) -> None:
        self.words: dict[int, np.ndarray] = {}
        self.pairs = np.full(self.PAIRS, -1, np.int64)
        self.fits = np.zeros(self.PAIRS, bool)

    def compatible(self, left: np.ndarray, right: np.ndarray, merges: Merges) -> np.ndarray:
        key = (left << 32) | right
        slot = ((key.astype(np.uint64) * GOLD) >> np.uint64(44)).astype(np.int64)
        missed = self.pairs[slot] != key
        if missed.any():
            fresh = np.unique(key[missed])
            ok = merges.compatible(fresh >> 32, fresh & 0xFFFFFFFF)
            out = self.fits[slot]
            out[missed] = ok[np.searchsorted(fresh, key[missed])]
            place = ((fresh.astype(np.uint64) * GOLD) >> np.uint64(44)).astype(np.int64)
            self.pairs[place], self.fits[place] = fresh, ok
            # Of two new pairs with one place the last is stored with its own answer.
            self.fits[place] = ok[np.searchsorted(fresh, self.pairs[place])]
            return out
        return self.fits[slot]


def load_model(path: str) -> PieceModel:
    """Read a unigram or BPE model file that leaves texts as they are (identity normaliser) and has byte pieces."""
    import pathlib

    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(pathlib.Path(path).read_bytes())
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("the model's normaliser changes texts")
    if not proto.trainer_spec.byte_fallback:
        raise ValueError("the model has no byte pieces")
    plain: dict[str, tuple[int, float]] = {}
    byte_ids, texts = np.zeros(256, np.int64), []
    for i, piece in enumerate(proto.pieces):
        if piece.type == kinds.BYTE:
            byte_ids[int(piece.piece[1:-1], 16)] = i
            texts.append(bytes([int(piece.piece[1:-1], 16)]))
        elif piece.type == kinds.NORMAL or piece.type == kinds.USER_DEFINED:
            plain[piece.piece] = (i, piece.score)
            texts.append(piece.piece.replace(chr(MARK), " ").encode())
        else:
            texts.append(b"")
    merges = None
    unknown = min(score for _, score in plain.values()) - UNKNOWN_PENALTY
    if proto.trainer_spec.model_type == proto.trainer_spec.BPE:
        merges, made = _merges(plain, len(texts))
        plain = {p: (i, 0.0) for p, (i, _) in plain.items() if p in made}
        unknown = 0.0
    ids = np.array([i for i, _ in plain.values()], np.int64)
    scores = np.array([score for _, score in plain.values()])
    keys = np.array([_piece_hash(p) for p in plain], np.uint64)
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two pieces share a hash")
    order = np.argsort(keys)
    longest = max(map(len, plain))
    return PieceModel(keys[order], ids[order], scores[order], longest, unknown, byte_ids, tuple(texts), merges)


def _merges(plain: dict[str, tuple[int, float]], size: int) -> tuple[Merges, set[str]]:
    """How merging makes each piece, and which pieces it can make at all."""
    ranked = {p: r for r, p in enumerate(sorted(plain, key=lambda p: (-plain[p][1], plain[p][0])))}
    rank, left, right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
    made = set()
    pairs = []
    for piece in plain:
        number = plain[piece][0]
        parts = list(piece)
        last = None
        while len(parts) > 1:
            options = [(ranked.get(x + y, size), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(options)
            if best == size:
                break
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) > 1:
            continue
        made.add(piece)
        if last and all(x in plain for x in last):
            rank[number] = ranked[piece]
            left[number], right[number] = plain[last[0]][0], plain[last[1]][0]
        for i in range(1, len(piece)):
            if piece[:i] in plain and piece[i:] in plain:
                pairs.append(((plain[piece[:i]][0] << 32) | plain[piece[i:]][0], ranked[piece]))
    found = np.array(sorted(pairs), np.int64)
    return Merges(rank, left, right, found[:, 0].copy(), found[:, 1].copy()), made


def _piece_hash(piece: str) -> int:
    value = np.zeros(1, np.uint64)
    for c in piece:
        value = value * FACTOR + np.uint64(ord(c) + 1)
    return int(mix(value + np.uint64(len(piece)))[0])


def _stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after a mark, blanks as marks; and where each text begins (one more at the end)."""
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) + (len(c) > 0) for c in codes], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    stream = np.empty(bounds[-1], np.uint32)
    for code, start in zip(codes, bounds[:-1], strict=True):
        if len(code):
            stream[start] = MARK
            stream[start + 1 : start + 1 + len(code)] = np.where(code == 32, MARK, np.where(code == MARK, LITERAL, code))
    return stream, bounds


def _words(stream: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where words begin: at a mark after another sign, and at each text. No piece has a mark after another sign."""
    begins = np.zeros(len(stream), bool)
    marks = stream == MARK
    begins[1:] = marks[1:] & ~marks[:-1]
    starts = bounds[:-1]
    begins[starts[starts < len(stream)]] = True
    return np.flatnonzero(begins)


def _forward(
    codes: np.ndarray, model: PieceModel, memory: Memory, known: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of one length, a row each, by where a prefix ends: its best score, last piece, and that piece's size.

    ``known`` has the scores and pieces of the first columns where a run goes on from another. A sign that no piece
    covers is kept as minus two minus its code point. Of equal scores the shorter last piece wins.
    """
    rows, length = codes.shape
    longest = min(model.longest, length)
    best = np.full((length + 1, rows), -np.inf)
    best[0] = 0
    back = np.zeros((length + 1, rows), np.int32)
    chosen = np.full((length + 1, rows), -1, np.int32)
    first = 1
    if known:
        first = len(known[0])
        best[:first], chosen[:first] = known
    # Hashes of the substrings that begin at each place grow by one sign per round; tables go by where substrings end.
    signs = np.ascontiguousarray(codes.T).astype(np.uint64) + np.uint64(1)
    scores = np.full((length, longest, rows), -np.inf)
    found = np.zeros((length, longest, rows), np.int32)
    hashed = np.zeros((length, rows), np.uint64)
    for size in range(1, longest + 1):
        hashed = hashed[: length - size + 1] * FACTOR + signs[size - 1 :]
        key = mix(hashed + np.uint64(size))
        # Most substrings are no piece; only those that may be one are searched for.
        place, row = np.nonzero(model.may_be[key >> np.uint64(64 - MAY_BITS)])
        key = key[place, row]
        at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
        hit = model.keys[at] == key
        place, row, at = place[hit] + size - 1, row[hit], at[hit]
        if size == 1:
            scores[:, 0] = model.unknown
            found[:, 0] = -2 - codes.T.astype(np.int64)
        scores[place, size - 1, row] = model.scores[at]
        found[place, size - 1, row] = model.ids[at]
    every = np.arange(rows)
    for end in range(first, length + 1):
        sizes = min(longest, end)
        # Pieces of one sign first, then of two, and so on.
        options = best[end - sizes : end][::-1] + scores[end - 1, :sizes]
        own = found[end - 1]
        if model.merges and end > 1:
            n = min(sizes, end - 1)
            before = chosen[end - n : end][::-1]
            size_at, row_at = np.nonzero((options[:n] > -np.inf) & (before >= 0) & (own[:n] >= 0))
            fits = memory.compatible(
                before[size_at, row_at].astype(np.int64), own[size_at, row_at].astype(np.int64), model.merges
            )
            options[size_at[~fits], row_at[~fits]] = -np.inf
        pick = options.argmax(axis=0)
        best[end] = options[pick, every]
        back[end] = pick + 1
        chosen[end] = own[pick, every]
    return best, chosen, back


def _best_paths(codes: np.ndarray, model: PieceModel, memory: Memory) -> np.ndarray:
    """For words of one length, a row each: the id of each chosen piece where it begins, -1 elsewhere."""
    rows, length = codes.shape
    _, chosen, back = _forward(codes, model, memory)
    out = np.full((rows, length), -1, np.int64)
    place = np.full(rows, length)
    open_rows = np.arange(rows)
    while len(open_rows):
        end = place[open_rows]
        start = end - back[end, open_rows]
        out[open_rows, start] = chosen[end, open_rows]
        place[open_rows] = start
        open_rows = open_rows[start > 0]
    return out


def _long_path(codes: np.ndarray, model: PieceModel, memory: Memory) -> np.ndarray:
    """The ids of a word of any length under a BPE model, as ``_best_paths`` finds them, in time linear in its length.

    The word is cut into segments that are advanced together, each from a little before its begin. A prefix's last piece
    depends on those of the prefixes up to the longest piece before it, so a segment that agrees there with the one
    before it is right from there on. One that does not goes on from the one before it instead.
    """
    width, length = model.longest, len(codes)
    lead = max(LEAD, width)
    ends, sizes = np.full(length + 1, -1, np.int32), np.zeros(length + 1, np.int32)
    scores = np.full(length + 1, -np.inf)

    def put(at: int, columns: tuple[np.ndarray, ...]) -> None:
        """Columns of one run for the prefixes that end from ``at`` on."""
        for into, column in zip((scores, ends, sizes), columns, strict=True):
            into[at : at + len(column)] = column

    put(0, tuple(c[:, 0] for c in _forward(codes[None, : min(length, SEGMENT)], model, memory)))
    # Bounds the arrays of a round; the last segment is shorter.
    starts = np.arange(SEGMENT, length - SEGMENT + 1, SEGMENT)
    step = max(1, LONG_ROUND // ((lead + SEGMENT) * width))
    for i in range(0, len(starts), step):
        block = starts[i : i + step]
        runs = _forward(codes[block[:, None] + np.arange(-lead, SEGMENT)], model, memory)
        for j, start in enumerate(block.tolist()):
            meet = slice(start - width + 1, start + 1)
            agree = np.array_equal(runs[1][lead - width + 1 : lead + 1, j], ends[meet])
            if agree and np.array_equal(runs[0][lead - width + 1 : lead + 1, j], scores[meet]):
                put(start + 1, tuple(c[lead + 1 :, j] for c in runs))
            else:
                _go_on(codes, start, start + SEGMENT, scores, ends, put, model, memory)
    done = int(starts[-1]) + SEGMENT if len(starts) else min(length, SEGMENT)
    if done < length:
        _go_on(codes, done, length, scores, ends, put, model, memory)
    picks, at, steps = [], length, sizes.tolist()
    while at > 0:
        picks.append(at)
        at -= steps[at]
    return ends[picks[::-1]].astype(np.int64)


def _go_on(codes, start, stop, scores, ends, put, model: PieceModel, memory: Memory) -> None:
    """One segment from what is known before it."""
    known = slice(start - model.longest, start + 1)
    run = _forward(codes[None, known.start : stop], model, memory, (scores[known, None], ends[known, None]))
    put(start + 1, tuple(c[model.longest + 1 :, 0] for c in run))


def _spelled(ids: np.ndarray, owner: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Signs that no piece covers become the pieces of their UTF-8 bytes."""
    unknown = ids <= -2
    if not unknown.any():
        return ids, owner
    code = np.where(unknown, -2 - ids, 0)
    code = np.where(code == LITERAL, MARK, code)
    counts = np.where(unknown, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
    which = np.repeat(np.arange(len(ids)), counts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    size, sign = counts[which], code[which]
    lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0])[size] | (sign >> (6 * (size - 1)))
    trail = 0x80 | ((sign >> (6 * (size - 1 - nth))) & 0x3F)
    byte = np.where(nth == 0, lead, trail)
    return np.where(unknown[which], model.byte_ids[byte & 255], ids[which]), owner[which]


def _gathered(offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the members of picked runs one after another, and the size of each picked run."""
    sizes = (offsets[1:] - offsets[:-1])[picks]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1][picks] - (ends - sizes), sizes), sizes


def encode_texts(texts: list[str | None], model: PieceModel, memory: Memory | None = None) -> list[np.ndarray]:
    """The ids of each text."""
    memory = memory or Memory()
    stream, bounds = _stream(texts)
    if not len(stream):
        return [np.zeros(0, np.int32) for _ in texts]
    starts = _words(stream, bounds)
    sizes = np.diff(np.append(starts, len(stream)))
    # Equal words are solved once, and remembered as long as there is room.
    hashed = np.zeros(len(starts), np.uint64)
    live = np.flatnonzero(sizes <= HASHED)
    for i in range(HASHED):
        live = live[sizes[live] > i]
        if not len(live):
            break
        hashed[live] = mix(hashed[live] * FACTOR + stream[starts[live] + i] + np.uint64(1))
    for word in np.flatnonzero(sizes > HASHED).tolist():
        run = stream[starts[word] : starts[word] + sizes[word]]
        hashed[word] = xxhash.xxh64_intdigest(run.tobytes(), int(sizes[word]))
    names, firsts, inverse = np.unique(hashed, return_index=True, return_inverse=True)
    solved: list[np.ndarray | None] = [memory.words.get(name) for name in names.tolist()]
    new = np.array([i for i, ids in enumerate(solved) if ids is None], np.int64)
    lengths = sizes[firsts[new]]
    for size in np.unique(lengths):
        same = new[lengths == size]
        if size > LONG and model.merges:
            for word in same.tolist():
                start = starts[firsts[word]]
                path = _long_path(stream[start : start + size], model, memory)
                solved[word] = _spelled(path, np.zeros(len(path), np.int64), model)[0].astype(np.int32)
            continue
        step = max(1, ROUND // int(size * min(size, model.longest)))  # bounds the arrays of a round
        for i in range(0, len(same), step):
            part = same[i : i + step]
            paths = _best_paths(stream[starts[firsts[part]][:, None] + np.arange(size)], model, memory)
            row, place = np.nonzero(paths != -1)
            flat, owner = _spelled(paths[row, place], row, model)
            cuts = np.searchsorted(owner, np.arange(len(part) + 1))
            for j, word in enumerate(part.tolist()):
                solved[word] = flat[cuts[j] : cuts[j + 1]].astype(np.int32)
    if len(memory.words) < memory.WORDS:
        memory.words.update((int(names[i]), solved[i]) for i in new[lengths <= HASHED].tolist())
    offsets = np.concatenate([[0], np.cumsum([len(ids) for ids in solved])])
    positions, lengths = _gathered(offsets, inverse)
    out = np.concatenate(solved)[positions]
    text_first = np.searchsorted(starts, bounds)
    cuts = np.concatenate([[0], np.cumsum(lengths)])[text_first]
    return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def decode_ids(rows: list[np.ndarray | None], model: PieceModel) -> list[str]:
    """The text of each run of ids: the blank before the first word goes; numbers without a piece are nothing."""
    blob = np.frombuffer(b"".join(model.texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in model.texts])])
    rows = [np.zeros(0, np.int64) if r is None else np.asarray(r, np.int64) for r in rows]
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    known = (flat >= 0) & (flat < len(model.texts))
    flat = np.where(known, flat, 0)
    positions, sizes = _gathered(offsets, flat)
    data = blob[positions].tobytes()
    cuts = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *[len(r) for r in rows]])]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        value = data[a:b].decode("utf-8", "replace")
        out.append(value[1:] if value.startswith(" ") else value)
    return out


def encode(docs: DataFrame, model: PieceModel, text: str = "text", into: str = "pieces") -> DataFrame:
    """All columns of ``docs`` plus ``into``: the ids of the pieces of the whole text.

    The text is read as in the model file: a blank is put before it, blanks become marks, and the pieces are those of
    the greatest sum of scores (equal sums: the shorter last piece) or, for a BPE model, those of its merges. A sign without a piece becomes the pieces of its
    UTF-8 bytes. A null text has null, an empty one no pieces. ``decode`` gives back every text exactly, also one that
    holds the mark's own sign. Time and memory are linear in a text's length, also of one without any blank under a BPE
    model: such a word is cut into segments (``_long_path``). A narrow step; an existing column ``into`` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = Memory()
        for column in batches:
            # What a slice gives goes on at once; a task holds the pieces of one slice.
            for part in array_slices(column, SLICE_BYTES, SLICE_ROWS):
                ids = encode_texts(part.to_pylist(), shared.value, memory)
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
                yield pc.if_else(part.is_null(), pa.scalar(None, out.type), out) if part.null_count else out
                del ids, out
            tidy()

    encoded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, F.arrow_udf(encoded, "array<int>")(F.col(text)))


def decode(docs: DataFrame, model: PieceModel, pieces: str = "pieces", into: str = "decoded") -> DataFrame:
    """All columns of ``docs`` plus ``into``: the text of the ids; null ids give null."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for start in range(0, len(column), 512):
                part = column.slice(start, 512)
                # Null rows may have members in between; each row is cut from the flat values by its own bounds.
                flat = part.values.to_numpy(zero_copy_only=False)
                offsets = part.offsets.to_numpy()
                valid = part.is_valid().to_numpy(zero_copy_only=False)
                texts = decode_ids([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], shared.value)
                yield pa.array([t if ok else None for t, ok in zip(texts, valid, strict=True)], pa.string())
                del flat, texts
            tidy()

    decoded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, F.arrow_udf(decoded, "string")(F.col(pieces)))
