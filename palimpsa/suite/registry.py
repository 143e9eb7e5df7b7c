"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsa.suite import detection, events, quality, sourcecode, wording
from palimpsa.suite.corpus import whole_numbers

MODULES = [detection, quality, wording, sourcecode, events]


def _checked(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: whole_numbers(query(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _checked(pair[0]) for m in MODULES for name, pair in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: pair[1] for m in MODULES for name, pair in m.QUERIES.items() if pair[1] is not None}
