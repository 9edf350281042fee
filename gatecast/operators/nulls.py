"""Null rules: sums and means that turn null as soon as one input is null.

Spark's aggregates skip nulls. The pipeline's results need the opposite: an
incomplete window, or one with a missing value, has no sum.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def sum_if_complete(value: Column, window: WindowSpec, width: int) -> Column:
    """Sum over ``window`` when it holds ``width`` rows, none of them null."""
    return F.when(F.count(value).over(window) == width, F.sum(value).over(window))


def sum_if_no_null(value: Column, window: WindowSpec) -> Column:
    """Sum over ``window`` when no row in it is null; stays null afterwards in running frames."""
    return F.when(
        F.count(value).over(window) == F.count(F.lit(1)).over(window), F.sum(value).over(window)
    )


def mean_agg(value: Column, na: str = "propagate") -> Column:
    """Grouped mean; ``propagate`` gives null for a group with a null, ``skip`` ignores nulls."""
    if na == "skip":
        return F.avg(value)
    if na != "propagate":
        raise ValueError("na must be 'propagate' or 'skip'")
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))
