"""Skewed inputs: results equal to a plain computation, and no range, file or summary that holds most of them."""

import pathlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from palimpsa.operators import activity, heavy
from palimpsa.operators.validate import running_total
from palimpsa.sources import sinks


def skewed(spark, n=6000):
    """One key with two thirds of the rows, one outlying order, a third of the rows without an order."""
    rng = random.Random(2)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 else (None if i % 9 == 0 else f"k{i % 5}")
        order = None if rng.random() < 0.33 else 10**15 if i == 1 else rng.randrange(n)
        rows.append((key, order, i, rng.randrange(100)))
    return rows, spark.createDataFrame(rows, "k string, o long, id long, v long").repartition(7)


def test_running_total_of_a_hot_key(spark):
    rows, frame = skewed(spark)
    got = running_total(frame, "k", "o", "v", "total", ("id",)).collect()
    expected, sums = {}, Counter()
    for key, order, number, value in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        sums[key] += value
        expected[number] = sums[key]
    assert {r.id: r.total for r in got} == expected and len(got) == len(rows)


def test_running_total_ranges_are_even(spark):
    frame = skewed(spark, 20_000)[1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    plan = running_total(frame, "k", "o", "v", "total")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # Each row's range, as the written step numbers it.
    folder = next(f for f in plan.inputFiles()).rsplit("/", 1)[0]
    ranges = [r["n"] for r in spark.read.parquet(folder).groupBy(F.shiftright("_seq", 33)).agg(F.count("*").alias("n")).collect()]
    assert len(ranges) > 1 and max(ranges) <= 4 * sorted(ranges)[len(ranges) // 2]


def test_packs_of_a_hot_group(spark, tmp_path):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"s{i % 4}", i, "x" * rng.randrange(200)) for i in range(3000)]
    rows += [("hot", 3000, None), ("empty", 3001, ""), ("long", 3002, "y" * 50_000)]
    path = str(tmp_path / "packs")
    sinks.write_packs(spark.createDataFrame(rows, "source string, id long, text string"), path, "source", "id", pack_bytes=10_000)
    files = list(pathlib.Path(path).glob("source=*/pack=*/part-*.txt"))
    longest = max(len(t or "") + 1 for _, _, t in rows if t is None or len(t) < 50_000)
    sizes = sorted(f.stat().st_size for f in files if "source=long" not in str(f))
    assert sizes[-1] <= 10_000 + longest and sum(sizes) == sum(len(t or "") + 1 for s, _, t in rows if s != "long")
    packs = Counter(f.parent for f in files)
    assert set(packs.values()) == {1}
    hot = sum(len(t or "") + 1 for s, _, t in rows if s == "hot")
    assert sum("source=hot" in str(p) for p in packs) == -(-hot // 10_000)


def test_bounds_hold_every_count(spark):
    rng = random.Random(4)
    exact, parts = defaultdict(Counter), []
    for part in range(5):
        for group in ("a", None):
            counts = Counter(rng.choices("abcdefghijklmnop", weights=range(1, 17), k=400))
            exact[group] += counts
            parts += [(part, group, item, n) for item, n in counts.items()]
    counts = spark.createDataFrame(parts, "part int, g string, item string, n long")
    got = heavy.merge(heavy.summarize(counts, "part", "g", "item", "n", 6), "part", "g", "item", "n").collect()
    bounds = {(r.g, r.item): (r.lower, r.upper, r.missed) for r in got}
    for group, counted in exact.items():
        for item, n in counted.items():
            if (group, item) in bounds:
                low, high, _ = bounds[group, item]
                assert low <= n <= high
            else:
                assert n <= next(b[2] for (g, _), b in bounds.items() if g == group)


def test_sessions_end_after_the_gap(spark):
    rows = [(1, 0), (1, 6), (1, 14), (1, 20), (None, 3), (2, None), (3, 40)]
    events = spark.createDataFrame(rows, "user_id long, day long").withColumn("ts", F.timestamp_seconds(F.col("day") * 86_400))
    sessions = activity.gap_sessions(events, "user_id", "ts")
    day = lambda name: (F.unix_seconds(name) / 86_400).cast("int")
    got = sessions.select("user_id", day("session_start"), day("session_end"), "n_events").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 13, 2), (1, 14, 27, 2), (None, 3, 10, 1), (3, 40, 47, 1)], key=str)
    opened = {r.day.toordinal(): r.n_open for r in activity.open_sessions(sessions).collect()}
    first = min(opened)
    assert opened[first] == 1 and opened[first + 3] == 2 and opened[first + 13] == 1
