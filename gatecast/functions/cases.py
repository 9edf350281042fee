"""Case expressions: result classes, points, sides, bands and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatecast.functions.labels import DRAWN, LOST, NO_HOLIDAY, POINTS, WON


def result_class(home_score: Column, away_score: Column, is_home: Column, compat: str = "number") -> Column:
    """Won, drawn or lost seen from one side; null when a score is missing.

    ``compat="text"`` compares the score parts as text, so "10" sorts below "9".
    """
    if compat not in ("number", "text"):
        raise ValueError("compat must be 'number' or 'text'")
    kind = "double" if compat == "number" else "string"
    home, away = home_score.try_cast(kind), away_score.try_cast(kind)
    return (
        F.when(home == away, DRAWN)
        .when((home > away) & is_home, WON)
        .when((home < away) & ~is_home, WON)
        .when((home > away) & ~is_home, LOST)
        .when((home < away) & is_home, LOST)
    )


def points(result: Column) -> Column:
    """0, 1 or 3 points by result class; null for a null class."""
    return recode(result, {k: float(v) for k, v in POINTS.items()})


def case_when(*branches: tuple[Column, object]) -> Column:
    """First branch that holds; null when none does."""
    (condition, value), *rest = branches
    out = F.when(condition, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out


def opponent(home: Column, away: Column, team: Column) -> Column:
    """The side that is not ``team``."""
    return F.when(home == team, away).otherwise(home)


def null_to_label(column: Column, label: str) -> Column:
    return F.coalesce(column, F.lit(label))


def null_flag(column: Column) -> Column:
    """1 for null, else 0."""
    return column.isNull().cast("int")


def binary_flag(column: Column, zero: str = NO_HOLIDAY) -> Column:
    """0 for the given label, 1 for any other."""
    return (column != zero).cast("int")


def recode(column: Column, mapping: dict, keep_others: bool = False) -> Column:
    """Replace labels by the mapping; others become null, or stay on request."""
    out = case_when(*[(column == F.lit(k), F.lit(v)) for k, v in mapping.items()])
    return out.otherwise(column) if keep_others else out


def side_pick(is_home: Column, home_value: Column, away_value: Column) -> Column:
    """The value of the side the team played on; null when the side is unknown."""
    return F.when(is_home, home_value).when(~is_home, away_value)


def rank_of(column: Column, levels: Sequence[str]) -> Column:
    """Position of a label in a given level order, from 1; null for others."""
    return recode(column, {level: i for i, level in enumerate(levels, 1)})
