"""Row filters. All are plain predicates, so they reach the scan where Spark allows it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_any(column: Column, *parts: str) -> Column:
    """True when the text holds one of the parts."""
    return reduce(lambda a, b: a | b, [column.contains(p) for p in parts])


def played(column: Column, *sentinels: str) -> Column:
    """True for a filled value that is none of the placeholders."""
    return column.isNotNull() & ~column.isin(*sentinels)


def at_least(column: Column, bound: float, kind: str = "int") -> Column:
    """Text compared as a number; text that is no number does not pass."""
    return column.try_cast(kind) >= F.lit(bound)


def like_any_case(column: Column, pattern: str) -> Column:
    """LIKE that ignores case, as the embedded database's LIKE does."""
    return column.ilike(pattern)


def any_pair(pairs: Sequence[tuple], *columns: Column) -> Column:
    """OR of ANDs: the columns equal one of the given tuples."""
    one = lambda values: reduce(lambda a, b: a & b, [c == F.lit(v) for c, v in zip(columns, values, strict=True)])
    return reduce(lambda a, b: a | b, [one(p) for p in pairs])


def complement(df: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``taken``."""
    return df.join(taken.select(*keys).distinct(), list(keys), "left_anti")
