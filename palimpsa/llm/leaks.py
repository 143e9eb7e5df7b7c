"""Benchmark decontamination by template windows: placeholders for numbers, names and units, and slot consistency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import settle, whole

WINDOW = 5
INSIDE = 3  # templates that an item needs to be looked for inside of texts
WORDS = 2  # words, not placeholders, of a window that tells of a re-parameterised copy
SHARE = (80, 100)
BROADCAST_WINDOWS = 1 << 20  # 16 bytes each

# What ends a sentence, the pieces of a text, and units by their names.
STOPS = (".", "!", "?", "\n")
NAME = r"\p{Lu}[\p{L}&&[^\p{Lu}]]++(?!\p{L})"
FIRST = rf"^{NAME}"
NUMBER = r"[0-9]{1,3}(?:[ \u00A0\u2009\u202F][0-9]{3})+(?![0-9])(?:[.,][0-9]+)*|[0-9]+(?:[.,][0-9]+)*"
# A run of names is one piece, so a name may have any number of words.
PIECES = rf"[.!?\n]|{NAME}(?:[^\p{{L}}0-9.!?\n]++{NAME})*+|\p{{L}}+|{NUMBER}"
UNITS = (
    "mm", "cm", "km", "millimeter", "millimeters", "millimetre", "millimetres", "centimeter", "centimeters", "centimetre",
    "centimetres", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "mile",
    "miles", "yard", "yards", "foot", "feet", "inch", "inches", "acre", "acres", "hectare", "hectares", "mg", "kg",
    "milligram", "milligrams", "gram", "grams", "gramme", "grammes", "kilogram", "kilograms", "kilogramme", "kilogrammes",
    "kilo", "kilos", "ton", "tons", "tonne", "tonnes", "pound", "pounds", "ounce", "ounces", "ml", "cl", "milliliter",
    "milliliters", "millilitre", "millilitres", "centiliter", "centiliters", "centilitre", "centilitres", "liter",
    "liters", "litre", "litres", "gallon", "gallons", "quart", "quarts", "pint", "pints", "cup", "cups", "teaspoon",
    "teaspoons", "tablespoon", "tablespoons", "millisecond", "milliseconds", "second", "seconds", "minute", "minutes",
    "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "decade", "decades", "century",
    "centuries", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "penny", "pennies", "pence", "yen",
    "rupee", "rupees", "degree", "degrees", "celsius", "fahrenheit", "kelvin", "watt", "watts", "kilowatt", "kilowatts",
    "megawatt", "megawatts", "volt", "volts", "amp", "amps", "ampere", "amperes", "ohm", "ohms", "joule", "joules",
    "kilojoule", "kilojoules", "calorie", "calories", "newton", "newtons", "pascal", "pascals", "hertz", "kilohertz",
    "megahertz", "gigahertz", "bit", "bits", "byte", "bytes", "kilobyte", "kilobytes", "megabyte", "megabytes",
    "gigabyte", "gigabytes", "terabyte", "terabytes", "mph", "kmh", "kph",
)
# Units after a number only; elsewhere they are letters or words.
SHORT_UNITS = (
    "m", "g", "l", "s", "h", "t", "c", "f", "k", "w", "v", "j", "n", "b", "ft", "yd", "mi", "ha", "lb", "lbs", "oz",
    "hr", "hrs", "min", "mins", "sec", "secs", "ms", "kw", "mw", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "kj",
)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def _number(piece: Column) -> Column:
    return (piece >= "0") & (piece < ":")


def _previous(pieces: Column, at: Column) -> Column:
    """The piece before position ``at``; a full stop before the first."""
    return F.when(at > 0, F.get(pieces, at - 1)).otherwise(".")


def _templates(pieces: Column, leaf: Callable[[Column, Column], Column]) -> Column:
    """``leaf(kind, value)`` of each piece in two readings, ``plain`` (an array, null if as ``named``) and ``named``; ends of sentences are left out.

    The kind is ``#`` for a number, ``%`` for a unit, ``@`` for a run of names, else the word itself, whose value is null.
    A capital inside a sentence is a name. One at its start is a name in the reading ``named`` and a word in ``plain``,
    where only the rest of its run is a name.
    """
    word = lambda low: leaf(low, F.lit(None).cast("string"))
    names = lambda run: leaf(F.lit("@"), F.regexp_replace(run, r"[^\p{L}]+", " "))

    def both(piece: Column, at: Column) -> Column:
        before, low = _previous(pieces, at), F.lower(piece)
        name = (piece != low) & piece.rlike(FIRST)
        unit = low.isin(*UNITS) | (low.isin(*SHORT_UNITS) & _number(before))
        one = (
            F.when(_number(piece), leaf(F.lit("#"), piece)).when(unit, leaf(F.lit("%"), piece))
            .when(name, names(piece)).otherwise(word(low))
        )
        first, rest = F.regexp_extract(piece, FIRST, 0), F.regexp_replace(piece, rf"{FIRST}[^\p{{L}}]*", "")
        start = F.when(F.lower(first).isin(*UNITS), leaf(F.lit("%"), first)).otherwise(word(F.lower(first)))
        split = F.when(rest == "", F.array(start)).otherwise(F.array(start, names(rest)))
        plain = F.when(before.isin(*STOPS) & name & ~unit, split)  # null: as named
        return F.when(~piece.isin(*STOPS), F.struct(plain.alias("plain"), one.alias("named")))

    return F.filter(F.transform(pieces, both), lambda t: t.isNotNull())


def _reading(templates: Column, starts: bool) -> Column:
    """The leaves of one reading: with names at the starts of sentences, or without."""
    if starts:
        return F.transform(templates, lambda t: t["named"])
    return F.flatten(F.transform(templates, lambda t: F.coalesce(t["plain"], F.array(t["named"]))))


def _slot(kind: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"))


def _window(hashes: Column, at: Column, words: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + i) for i in range(words)])


def _runs(hashes: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` templates of a text that has as many."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: _window(hashes, i, width))


def _windows(hashes: Column, words: int, widths: list[int], own: bool = False) -> list[tuple[int, Column]]:
    """Widths and arrays of windows: of ``words`` templates, or of the whole text if it has fewer, and of ``widths``.

    With ``own``, a text has windows of one of ``widths`` only if that is its length, and none as a whole then.
    """
    none = F.array().cast("array<bigint>")
    size = F.size(hashes)
    short = F.array(F.xxhash64(F.lit("short"), F.array_join(F.transform(hashes, lambda h: h.cast("string")), " ")))
    few = (size > 0) & (size < INSIDE) if own else size > 0
    first = F.when(size >= words, _runs(hashes, words)).when(few, short).otherwise(none)
    fits = lambda w: size == w if own else size >= w
    return [(words, first), *[(w, F.when(fits(w), _runs(hashes, w)).otherwise(none)) for w in widths]]


def _placed(runs: Column, width: int) -> Column:
    return F.transform(runs, lambda h, i: F.struct(i.alias("at"), F.lit(width).alias("width"), h.alias("window")))


def _named(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Key, text, and a hash that tells texts apart whose keys are missing or repeated."""
    value = whole(text)
    return texts.select(F.col(key).alias("_key"), F.xxhash64(F.col(key), value).alias("_id"), value.alias("_text"))


def _read(
    named: DataFrame, words: int, names: dict[str, str], starts: bool, widths: list[int], own: bool
) -> DataFrame:
    cut = named.withColumn("_pieces", _pieces(F.col("_text")))
    cut = cut.withColumn("_templates", _templates(F.col("_pieces"), _slot))
    cut = cut.select("_key", "_id", _reading(F.col("_templates"), starts).alias("_slots"))
    cut = cut.withColumn("_hashes", F.transform("_slots", lambda s: F.xxhash64(s["kind"])))
    windows = _windows(F.col("_hashes"), words, widths, own)
    if widths:
        placed = [_placed(run, width) for width, run in windows]
        run = cut.select("_key", "_id", "_slots", F.explode(F.concat(*placed)).alias("_run"))
        run = run.select("_key", "_id", "_slots", "_run.width", F.col("_run.at").alias("_at"), F.col("_run.window").alias("_window"))
    else:
        run = cut.select("_key", "_id", "_slots", F.posexplode(windows[0][1]).alias("_at", "_window")).withColumn("width", F.lit(words))
    return run.select(
        F.col("_key").alias(names["key"]), F.col("_id").alias(names["id"]), F.lit(starts).alias(names["reading"]),
        "_window", F.col("_at").alias(names["at"]), F.slice("_slots", F.col("_at") + 1, F.col("width")).alias(names["slots"]),
    )


def _slotted(named: DataFrame, words: int, names: dict[str, str], widths: list[int], own: bool = False) -> DataFrame:
    """One row per reading and window: id, key, reading, window hash, position, and the slots inside it."""
    return _read(named, words, names, False, widths, own).unionByName(_read(named, words, names, True, widths, own))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    words: int = WINDOW,
    share: tuple[int, int] = SHARE,
) -> DataFrame:
    """One row per document and benchmark item found in it: key, item, n_windows, found, exact, same_slots.

    Texts become templates: numbers, units and names (capitals) are placeholders, other words are in lower case,
    punctuation goes. A capital at the start of a sentence may be a name or not, so an item has two readings, one for
    each, and is found by either; documents have the windows of both. An item is found when at least 80 of 100 of its distinct windows of five templates
    are in the document, either with the same values in all slots (``exact`` such windows), or in one stretch of it
    (``found`` windows) where each value of the item always stands for the same value of the document: a
    re-parameterised copy. Two values of the item may stand for one. A stretch is one offset between item and document,
    or offsets that differ by up to twice the window or by the item's length, so words may be put in or left out;
    windows with a value that most windows of the stretch do not agree on are not counted. Neighbouring names are one
    placeholder. ``same_slots`` tells whether the first holds. Placeholders alone tell nothing: for a re-parameterised
    copy only windows with at least two words count (80 of 100 of them must be there), and an item of which fewer than
    half of the windows are such is found with the same values only. So is an item of three or four templates, which is
    one window and found anywhere in a text. One of one or two, as ordinary texts hold by chance, is
    found in texts of the same words only. Missing and empty texts have no windows
    and are never found. Rows that repeat key and text give one row; a missing key is a key. Other columns are ignored;
    an empty table on either side gives an empty table.

    Documents are searched in place: their windows meet the benchmark's distinct windows, which are broadcast up to a
    counted bound and shuffled beyond it. Only documents with enough windows of an item are read again for the slots.
    """
    return _found(docs, benchmark, key, text, item, item_text, words, share).drop("_id")


def _found(
    docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str = "item_id", item_text: str = "text",
    words: int = WINDOW, share: tuple[int, int] = SHARE,
) -> DataFrame:
    """The rows of ``find_leaks``, and ``_id``, the hash of key and text."""
    under, over = share
    theirs = {"key": "_item", "id": "_item_id", "reading": "_reading", "at": "_item_at", "slots": "_item_slots"}
    inner = list(range(INSIDE, words))
    items = _slotted(_named(benchmark, item, item_text).dropDuplicates(["_id", "_key"]), words, theirs, inner, own=True)
    items = settle(items, "items")
    length = F.size("_item_slots")
    present = {r["n"] for r in items.filter(length < words).select(length.alias("n")).distinct().collect()}
    widths = [w for w in inner if w in present]
    distinct = items.select("_window").distinct()
    distinct = settle(distinct, "windows")
    if distinct.count() <= BROADCAST_WINDOWS:
        distinct = F.broadcast(distinct)
    literal = F.size(F.filter("_item_slots", lambda s: s["value"].isNull()))
    worded = (length >= words) & (literal >= WORDS)
    needs = items.groupBy("_item_id", "_reading").agg(
        F.countDistinct("_window").alias("_n"), F.countDistinct(F.when(worded, F.col("_window"))).alias("_m")
    )
    named = _named(docs, key, text)
    seen = named.withColumn("_pieces", _pieces(F.col("_text")))
    seen = seen.select("_id", _templates(F.col("_pieces"), lambda kind, _: F.xxhash64(kind)).alias("_templates"))
    seen = seen.select("_id", *[_reading(F.col("_templates"), s).alias(f"_hashes_{s}") for s in (False, True)])
    plain, named_too = [[run for _, run in _windows(F.col(f"_hashes_{s}"), words, widths)] for s in (False, True)]
    joined = lambda runs: F.concat(*runs) if widths else runs[0]
    seen = seen.select("_id", F.explode(F.array_union(joined(plain), joined(named_too))).alias("_window"))
    hits = settle(seen.join(distinct, "_window").distinct(), "hits")
    held = items.select("_item_id", "_reading", "_window").distinct()
    # Sums per document and item; a document's windows are distinct, so none counts twice.
    enough = (
        hits.join(held, "_window")
        .groupBy("_id", "_item_id", "_reading").agg(F.count("*").alias("_found"))
        .join(needs, ["_item_id", "_reading"])
        .filter(F.col("_found") * over >= F.col("_n") * under)
        .select("_id", "_item_id", "_reading", "_n", "_m")
    )
    enough = settle(enough, "candidates")
    texts = named.join(enough.select("_id").distinct(), "_id", "left_semi").dropDuplicates(["_id", "_key"])
    again = _slotted(texts, words, {"key": "_key", "id": "_id", "reading": "_as", "at": "_at", "slots": "_slots"}, widths)
    pairs = (
        again.join(enough, "_id")
        .join(items, ["_item_id", "_reading", "_window"])
        .select(
            "_key", "_id", "_item", "_item_id", "_reading", "_n", "_m", "_window", worded.alias("_worded"), (F.col("_at") - F.col("_item_at")).alias("_shift"),
            (F.col("_slots") == F.col("_item_slots")).alias("_same"),
            F.transform(
                F.filter(F.arrays_zip("_item_slots", "_slots"), lambda z: z["_item_slots"]["value"].isNotNull()),
                lambda z: F.struct(
                    F.concat(z["_item_slots"]["kind"], F.lower(z["_item_slots"]["value"])).alias("theirs"),
                    F.lower(z["_slots"]["value"]).alias("ours"),
                ),
            ).alias("_values"),
        )
    )
    pairs = settle(pairs, "aligned")
    pair = ["_key", "_id", "_item", "_item_id", "_reading", "_n", "_m"]
    same = pairs.filter("_same").groupBy(*pair).agg(F.countDistinct("_window").alias("_exact"))
    # Stretches of alignments: one offset, and offsets near each other, each in two overlapping bands of the same width.
    shift = F.col("_shift").cast("long")
    near = [F.struct(F.lit(0).cast("long").alias("width"), shift.alias("at"))]
    for width in (F.lit(2 * words).cast("long"), F.greatest(F.col("_n"), F.lit(2 * words + 1)).cast("long")):
        at = F.floor(shift / width).cast("long")
        near += [F.struct(width.alias("width"), (at + i).alias("at")) for i in (0, 1)]
    lines = pairs.filter(F.col("_m") * 2 >= F.col("_n")).select(*pair, "_window", "_worded", "_values", F.explode(F.array(*near)).alias("_line"))
    line = ["_id", "_item_id", "_reading", "_line"]
    # In a stretch each value of the item stands for the one that most windows give it; windows with another are dropped.
    votes = (
        lines.select(*line, "_window", F.explode("_values").alias("_value"))
        .groupBy(*line, "_value").agg(F.countDistinct("_window").alias("_votes"))
        .groupBy(*line, F.col("_value.theirs").alias("_theirs"))
        .agg(F.max(F.struct("_votes", F.col("_value.ours").alias("ours")))["ours"].alias("_ours"))
        .groupBy(*line).agg(F.map_from_entries(F.collect_list(F.struct("_theirs", "_ours"))).alias("_chosen"))
    )
    agreed = F.forall("_values", lambda v: F.try_element_at(F.col("_chosen"), v["theirs"]) == v["ours"])
    steady = lines.filter("_worded").join(votes, line, "left").filter((F.size("_values") == 0) | agreed)
    steady = steady.groupBy(*pair, "_line").agg(F.countDistinct("_window").alias("_found"))
    steady = steady.groupBy(*pair).agg(F.max("_found").alias("_found"))
    both = same.withColumn("_found", F.lit(0).cast("long")).unionByName(steady.withColumn("_exact", F.lit(0).cast("long")))
    both = both.groupBy(*pair).agg(F.max("_exact").alias("_exact"), F.max("_found").alias("_found"))
    same_enough = F.col("_exact") * over >= F.col("_n") * under
    changed_enough = (F.col("_m") > 0) & (F.col("_m") * 2 >= F.col("_n")) & (F.col("_found") * over >= F.col("_m") * under)
    # Of two readings the one with the same values counts, then the one without names at the starts of sentences.
    best = F.max(F.struct(same_enough.alias("_same"), (~F.col("_reading")).alias("_plain"), "_n", "_found", "_exact"))
    both = both.filter(same_enough | changed_enough)
    both = both.groupBy("_key", "_id", "_item", "_item_id").agg(best.alias("_best"))
    return both.select(
        "_id", F.col("_key").alias(key), F.col("_item").alias(item), F.col("_best._n").alias("n_windows"),
        F.col("_best._found").alias("found"), F.col("_best._exact").alias("exact"),
        F.col("_best._same").alias("same_slots"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in which no item is found, unchanged. Rows are judged by key and text, so others that only
    share the key, or have none either, stay.
    """
    names = docs.columns
    found = settle(_found(docs, benchmark, key, text, **how).select("_id").distinct(), "found")
    rows = docs.select(
        F.xxhash64(F.col(key), whole(text)).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_whole")
    )
    return rows.join(found, "_id", "left_anti").select(*[F.col(f"_whole.`{c}`") for c in names])
