"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math
import os
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, db, sf_dir, query, sql):
    frame = query(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    expected = rows_of(columns, result.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} vs {sorted(columns)}", len(got)
    if got != expected:
        missing = next(((a, b) for a, b in zip(got, expected) if a != b), None)
        return f"{len(got)} vs {len(expected)} rows; first difference {str(missing)[:600]}", len(got)
    return None, len(got)


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    from palimpsa.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:]
    if os.environ.get("PLAIN_SESSION"):
        # a session with next to no settings of our own, as another driver would bring
        spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    else:
        spark = local_session()
    db = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        started = time.time()
        try:
            if name in sqls:
                problem, count = compare(spark, db, sf_dir, query, sqls[name])
            else:
                problem, count = None, query(spark, sf_dir).count()
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:500]}", -1
        bad += problem is not None
        kind = "rows" if name not in sqls else "ok"
        print(f"{name:28s} {count:7d} {time.time() - started:6.1f}s {kind if problem is None else 'BAD ' + problem}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
