"""Column helpers for values inside arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used: it becomes a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, size: Callable[[Column], Column]) -> Column:
    """Sums of sizes before each value and after the last one: n + 1 numbers, the first 0."""
    return F.aggregate(values, F.array(F.lit(0)), lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + size(x)))


def pairs_of(values: Column) -> Column:
    """Structs (a, b) of neighbours."""
    n = F.size(values)
    return F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
