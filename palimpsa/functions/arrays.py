"""Two array helpers that keep per-document work inside the row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDTHS = "array(" + ", ".join(str(1 << k) for k in range(31)) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_scan(items: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefix combination of an array by doubling.

    ``combine(left, right)`` must be associative. A fold that appends to an
    array copies it at every step (quadratic); doubling takes about log2(n)
    passes over n items.
    """

    def one_pass(done: Column, width: Column) -> Column:
        return F.transform(
            done,
            lambda x, i: F.when(i >= width, combine(F.get(done, i - width), x)).otherwise(x),
        )

    def passes(first: Column) -> Column:
        widths = F.filter(F.expr(_WIDTHS), lambda w: w < F.size(first))
        return F.aggregate(widths, first, one_pass)

    return let(items, passes)


def running_sum(items: Column) -> Column:
    return prefix_scan(items, lambda left, right: left + right)


def running_max(items: Column) -> Column:
    return prefix_scan(items, lambda left, right: F.greatest(left, right))


def array_total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def sql_literal(value: str | None) -> str:
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(pairs: Iterable[tuple[str, str | list[str | None]]]) -> Column:
    """A constant map; written as one SQL expression because that is quicker to build than a tree of literals."""

    def value(v: str | list[str | None]) -> str:
        return sql_literal(v) if isinstance(v, str) else "array(" + ", ".join(map(sql_literal, v)) + ")"

    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {value(v)}" for k, v in pairs) + ")")
