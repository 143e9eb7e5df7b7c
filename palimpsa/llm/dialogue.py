"""Repair of conversations: damage and faults by row, and the cheapest edits by depth-first branch-and-bound.

A conversation's rows stand in order of their turns and are cut into segments of bounded length. For each segment the
least cost from each state to each other is known from its rows alone; a sweep from the last segment back gives the
least cost that follows each segment, the lower bound of its search. Each segment is then searched by itself, and a
sweep forward picks the path that begins where the one before it ended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import ranked, runs, settle

SEGMENT = 1024

# Costs of the edits, and the rules of damage.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
DROPPED, EMPTIED, UNSTOPPED, REPEATED, MADE_USER = range(5)
DAMAGE_SPAN = 20

BLANKS = r"\x20\x09-\x0D"
# Where a conversation can stand: nothing yet, after its system row, after a user row, after an assistant row.
START, OPENED, ASKED, ANSWERED = range(4)
STATES = range(4)
FAR = 1 << 60
# The state after a row with this role initial, where the grammar allows one.
AFTER = {(START, "s"): OPENED, (START, "u"): ASKED, (OPENED, "u"): ASKED, (ANSWERED, "u"): ASKED, (ASKED, "a"): ANSWERED}
# The role that may come next where one is put in or changed.
WANTED = {START: "u", OPENED: "u", ASKED: "a", ANSWERED: "u"}
NAMES = {"u": "user", "a": "assistant"}
# What closes a conversation: inserted rows until it is empty or ends in an assistant row.
CLOSING = {START: "", OPENED: "ua", ASKED: "a", ANSWERED: ""}
LAWFUL = {"su", "ua", "au"}


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """``_conv, _turn, _role, _text`` of the rows that are left after the damage that their keys draw."""
    draw = F.crc32(F.concat(_spaced(conversation), F.lit(":"), _spaced(turn)).cast("binary")) % DAMAGE_SPAN
    words = _spaced(text)
    left = rows.select(
        F.col(f"`{conversation}`").alias("_conv"), F.col(f"`{turn}`").cast("long").alias("_turn"), draw.alias("_draw"),
        F.when(draw == MADE_USER, "user").otherwise(_spaced(role)).alias("_role"),
        F.when(draw == EMPTIED, "").when(draw == UNSTOPPED, F.translate(words, ".!?", "")).otherwise(words).alias("_text"),
    ).filter(F.col("_draw") != DROPPED)
    copies = F.when(F.col("_draw") == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_copy", F.explode(copies)).drop("_draw", "_copy")


def _coded(rows: DataFrame) -> DataFrame:
    """Role initial and fault as two letters: ``s u a x`` (another role), then ``k b d t`` (no fault, blank, ...)."""
    first = rows.groupBy("_conv", "_role", "_digest").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    first = first.filter("_n > 1").select(F.col("_conv").alias("_c"), F.col("_role").alias("_r"), F.col("_digest").alias("_d"), "_first")
    first = settle(first, "firsts")  # a plain exchange on its side of the join, so that a hot text can be divided
    same = rows["_conv"].eqNullSafe(first["_c"]) & (rows["_role"] == first["_r"]) & (rows["_digest"] == first["_d"])
    met = rows.join(first, same, "left")
    initial = F.substring("_role", 1, 1)
    fault = (
        F.when(F.col("_last") == "", "b").when(F.col("_at") > F.col("_first"), "d")
        .when(~F.col("_last").isin(".", "!", "?"), "t").otherwise("k")
    )
    return met.withColumn("_code", F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault))


def _moves(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of one row in a state, in order of their letters: letter, cost, next state."""
    yield "D", DELETE, state
    if code[1] in "bd":
        return
    worn = TRUNCATED if code[1] == "t" else 0
    kept = AFTER.get((state, code[0]))
    if kept is not None:
        yield "K", KEEP + worn, kept
    role = WANTED[state]
    if role != code[0]:
        yield "R", REROLE + worn, AFTER[state, role]


def _inserted(state: int) -> int:
    return AFTER[state, WANTED[state]]


def _settled(costs: list[int]) -> list[int]:
    """Rows may be put in before going on: a chain leads from each state to one that goes round in two."""
    for _ in STATES:
        costs = [min(costs[s], INSERT + costs[_inserted(s)]) for s in STATES]
    return costs


def suffix_bounds(codes: list[str], after: list[int]) -> list[list[int]]:
    """Least cost of all that follows, for each row and state; ``after`` holds beyond the last row."""
    bounds = [after]
    for code in reversed(codes):
        ahead = bounds[-1]
        bounds.append(_settled([min(cost + ahead[to] for _, cost, to in _moves(code, s)) for s in STATES]))
    bounds.reverse()
    return bounds


def cheapest_edits(codes: list[str], entry: int, after: list[int]) -> tuple[str, int, int]:
    """The edits of least cost, of those the first by their letters: (letters, cost, state at the end).

    Depth first by an explicit stack, letters in order; ``after`` counts what follows the last row. A prefix goes no
    further when its cost and the lower bound of its suffix exceed the incumbent's cost, or when the node (row,
    state) has been reached by a prefix of less cost, or of equal cost and lesser letters. Neither of two equal
    prefixes of a node begins the other, since a row that is put in costs something, so the lesser stays lesser
    whatever follows. The search ends when the stack is empty: the incumbent is then proved.
    """
    bounds = suffix_bounds(codes, after)
    best: tuple[int, str, int, int] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    limit = bounds[0][entry]
    while stack:
        row, state, cost, letters = stack.pop()
        if cost + bounds[row][state] > (best[0] if best else limit):
            continue
        known = seen.get((row, state))
        if known is not None and known <= (cost, letters):
            continue
        seen[row, state] = (cost, letters)
        if row == len(codes):
            found = (cost + after[state], letters, cost, state)
            best = found if best is None else min(best, found)
            continue
        nexts = [(row + 1, to, cost + price, letters + letter) for letter, price, to in _moves(codes[row], state)]
        # A row put in here stands before this one: its letter follows D and precedes K and R.
        nexts.insert(1, (row, _inserted(state), cost + INSERT, letters + "I"))
        stack.extend(reversed(nexts))
    _, letters, cost, state = best
    return letters, cost, state


def _through(codes: list[str]) -> list[list[int]]:
    """Least cost through a segment from each state to each other."""
    columns = [suffix_bounds(codes, [0 if s == end else FAR for s in STATES])[0] for end in STATES]
    return [[min(FAR, columns[end][s]) for end in STATES] for s in STATES]


def _pairs(text: str) -> list[str]:
    return [text[i : i + 2] for i in range(0, len(text), 2)]


def _closing_costs() -> list[int]:
    return [INSERT * len(CLOSING[s]) for s in STATES]


SEGMENTS = "_conv {conv}, _seg long, _codes string, _through array<long>"
BOUNDED = "_conv {conv}, _seg long, _codes string, _after array<long>"
SCRIPTS = "_conv {conv}, _seg long, _codes string, _letters array<string>, _ends array<long>, _costs array<long>"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _scripts(coded: DataFrame, conv: str, arrow: pa.DataType) -> DataFrame:
    """For each segment and each state it may begin in: the letters of its edits, their cost and the state after it."""
    longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
    lead = [("_conv", arrow), ("_seg", pa.int64()), ("_codes", pa.string())]

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r | {"_through": sum(_through(_pairs(r["_codes"])), [])} for r in batch.to_pylist()]
            yield _batch(rows, pa.schema([*lead, ("_through", longs)]))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Last segment first: the least cost that follows each."""
        conv, after, fresh = None, None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if fresh or row["_conv"] != conv:
                    conv, after, fresh = row["_conv"], _closing_costs(), False
                    after = _settled(after)
                out.append({k: row[k] for k in ("_conv", "_seg", "_codes")} | {"_after": after})
                cross = row["_through"]
                after = [min(cross[4 * s + e] + after[e] for e in STATES) for s in STATES]
            yield _batch(out, pa.schema([*lead, ("_after", longs)]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                codes = _pairs(row["_codes"])
                entries = STATES if row["_seg"] else [START]
                found = [cheapest_edits(codes, s, row["_after"]) for s in entries]
                out.append(
                    {k: row[k] for k in ("_conv", "_seg", "_codes")}
                    | {"_letters": [f[0] for f in found], "_costs": [f[1] for f in found], "_ends": [f[2] for f in found]}
                )
            yield _batch(out, pa.schema([*lead, ("_letters", strings), ("_ends", longs), ("_costs", longs)]))

    segment = F.floor(F.col("_at") / SEGMENT).cast("long")
    members = F.sort_array(F.collect_list(F.struct("_at", "_code")))
    segments = coded.groupBy("_conv", segment.alias("_seg")).agg(
        F.array_join(F.transform(members, lambda m: m["_code"]), "").alias("_codes")
    )
    swept = (
        segments.mapInArrow(crossed, SEGMENTS.format(conv=conv))
        .repartition("_conv").sortWithinPartitions("_conv", F.desc("_seg"))
        .mapInArrow(bounded, BOUNDED.format(conv=conv))
    )
    return swept.repartition("_conv", "_seg").mapInArrow(searched, SCRIPTS.format(conv=conv))


REPAIRS = (
    "_conv {conv}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


class _Repair:
    """One conversation as its segments and rows stream by."""

    def __init__(self):
        self.state, self.cost, self.audit = START, 0, []
        self.counts = dict.fromkeys("bdt", 0)
        self.illegal, self.before = 0, None
        self.hash, self.lines = hashlib.sha256(), 0
        self.letters, self.place = "", 0
        self.role_state = START

    def segment(self, row: dict) -> None:
        entry = self.state if row["_seg"] else 0
        self.letters, self.place = row["_letters"][entry], 0
        self.audit.append(self.letters)
        self.cost += row["_costs"][entry]
        self.state = row["_ends"][entry]
        for code in _pairs(row["_codes"]):
            if code[1] in self.counts:
                self.counts[code[1]] += 1
            if self.before is not None and self.before + code[0] not in LAWFUL:
                self.illegal += 1
            self.before = code[0]

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        self.role_state = AFTER[self.role_state, role[:1]]

    def _put_in(self) -> None:
        self._line(NAMES[WANTED[self.role_state]], "")

    def row(self, role: str, text: str) -> None:
        while self.letters[self.place] == "I":
            self._put_in()
            self.place += 1
        letter = self.letters[self.place]
        self.place += 1
        if letter == "K":
            self._line(role, text)
        elif letter == "R":
            self._line(NAMES[WANTED[self.role_state]], text)

    def done(self) -> dict:
        closing = CLOSING[self.state]
        for _ in closing:
            self._put_in()
        return {
            "blank": self.counts["b"], "duplicate": self.counts["d"], "truncated": self.counts["t"],
            "illegal": self.illegal, "cost": self.cost + INSERT * len(closing),
            "audit": "".join(self.audit) + "I" * len(closing), "repaired_sha256": self.hash.hexdigest(),
        }


def _applied(rows: DataFrame, scripts: DataFrame, conv: str, arrow: pa.DataType) -> DataFrame:
    """Segments and rows of a conversation in order, one after the other: nothing of it is held but its edits."""
    schema = pa.schema(
        [("_conv", arrow), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")],
         ("audit", pa.string()), ("repaired_sha256", pa.string())]
    )

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, work = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if work is None or row["_conv"] != conv:
                    if work is not None:
                        out.append({"_conv": conv} | work.done())
                    conv, work = row["_conv"], _Repair()
                if row["_letters"] is not None:
                    work.segment(row)
                else:
                    work.row(row["_role"], row["_text"])
            yield _batch(out, schema)
        if work is not None:
            yield _batch([{"_conv": conv} | work.done()], schema)

    told = scripts.select("*", (F.col("_seg") * SEGMENT).alias("_at"), F.lit(0).alias("_kind"))
    lines = rows.select("_conv", "_role", "_text", "_at", F.lit(1).alias("_kind"))
    both = told.unionByName(lines, allowMissingColumns=True).repartition("_conv")
    return both.sortWithinPartitions("_conv", "_at", "_kind").mapInArrow(repair, REPAIRS.format(conv=conv))


def repair_conversations(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation of ``rows``: what is wrong with it after the damage, and its cheapest repair.

    Columns: conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Missing values
    count as one space, also in the key that draws the damage; a missing conversation is one of its own, a missing turn
    comes first. Rows of one turn stand in the order of role, text. A row is blank without other characters than
    blanks, a duplicate if its role and text stand earlier, truncated if its last such character ends no sentence.
    A role that begins with neither s, u nor a fits nowhere. Conversations that lose all rows have zeros, an empty
    audit and the hash of an empty text. An empty table gives an empty table; other columns are ignored.

    A conversation of any length is sorted, coded and searched in segments of ``SEGMENT`` rows by as many tasks; its
    hash alone is one ordered pass over its rows, as a hash is, with memory for its edits (a letter a row) only.
    """
    field = rows.select(F.col(f"`{conversation}`").alias("_conv")).schema["_conv"]
    conv, arrow = field.dataType.simpleString(), pa.string() if field.dataType.typeName() == "string" else pa.int64()
    # Without its trailing blanks a text ends in what decides; none is left of a blank one.
    last = F.substring(F.regexp_replace("_text", f"[{BLANKS}]+\\z", ""), -1, 1)
    left = damaged(rows, conversation, turn, role, text).withColumns(
        {"_digest": F.sha2(F.col("_text").cast("binary"), 256), "_last": last, "_row": F.monotonically_increasing_id()}
    )
    stood = ranked(left, "_conv", ["_turn", "_role", "_text", "_row"], "turns")
    scripts = settle(_scripts(_coded(stood.drop("_text", "_turn")), conv, arrow), "scripts")
    repaired = _applied(stood, scripts, conv, arrow)
    least, most = F.min("_turn"), F.max("_turn")
    spans = stood.groupBy("_conv").agg(
        F.coalesce(most - least + 1 - F.countDistinct("_turn"), F.lit(0)).cast("long").alias("gaps")
    )
    every = rows.select(F.col(f"`{conversation}`").alias("_every")).distinct()
    zero = {n: F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")}
    spans = spans.withColumnRenamed("_conv", "_span")
    met = every.join(repaired, F.col("_every").eqNullSafe(F.col("_conv")), "left")
    met = met.join(spans, F.col("_every").eqNullSafe(F.col("_span")), "left")
    return met.select(
        F.col("_every").alias(conversation), F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), *zero.values(),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
