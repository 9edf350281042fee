"""History features: lags, rolling sums, running sums and last meetings per team.

Every feature reads earlier rows of one team in a declared total order, so the
result does not depend on how rows are stored. All features asked for together
share one exchange on the team; only sorts are added for finer groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatecast.operators.hotgroups import CHUNK, HOT_ROWS, last_rows, over_chunks, prefix_sums, split_hot_groups
from gatecast.operators.nulls import sum_if_complete, sum_if_no_null
from gatecast.session import materialize


@dataclass(frozen=True)
class Lag:
    """Value ``offset`` rows earlier; ``within`` narrows the team's history, e.g. to one opponent."""

    value: str
    offset: int = 1
    within: tuple[str, ...] = ()

    @property
    def reach(self) -> int:
        return self.offset

    def column(self, partition: list[str], order: list) -> Column:
        return F.lag(self.value, self.offset).over(Window.partitionBy(*partition).orderBy(*order))


@dataclass(frozen=True)
class RollingSum:
    """Sum of ``width`` rows ending ``shift`` rows before the current one; null unless all are filled."""

    value: str
    width: int = 3
    shift: int = 0
    within: tuple[str, ...] = ()

    @property
    def reach(self) -> int:
        return self.width - 1 + self.shift

    def column(self, partition: list[str], order: list) -> Column:
        rows = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-self.reach, -self.shift)
        return sum_if_complete(F.col(self.value), rows, self.width)


@dataclass(frozen=True)
class RunningSum:
    """Sum from the group's first row on; null from the first null value on."""

    value: str
    within: tuple[str, ...] = ()

    def column(self, partition: list[str], order: list) -> Column:
        rows = (
            Window.partitionBy(*partition)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return sum_if_no_null(F.col(self.value), rows)


Feature = Lag | RollingSum | RunningSum


def add_history(
    df: DataFrame,
    *stages: dict[str, Feature],
    team: str | Sequence[str],
    order: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add the named features. A later stage may read columns an earlier one added.

    Teams with more than ``hot_rows`` rows are worked in chunks (see ``hotgroups``);
    ``hot_rows=None`` leaves out that check.
    """
    keys = [team] if isinstance(team, str) else list(team)
    order = list(order)
    ordinary, chunked = split_hot_groups(df, keys, order, hot_rows)
    for stage in stages:
        ordinary = ordinary.withColumns(
            {name: f.column(list(dict.fromkeys([*keys, *f.within])), order) for name, f in stage.items()}
        )
    if chunked is None:
        return ordinary
    for n, stage in enumerate(stages):
        if n:
            chunked = materialize(chunked, "chunks")
        stored = chunked
        for features, group in _passes(stage, keys):
            chunked = _chunk_pass(chunked, stored, features, group, order)
    return ordinary.unionByName(chunked.select(*ordinary.columns))


def _passes(stage: dict[str, Feature], keys: list[str]):
    """Features that can share carry rows: all look-backs of one group; each running sum alone."""
    by_group: dict[tuple[str, ...], dict[str, Feature]] = {}
    for name, f in stage.items():
        if isinstance(f, RunningSum):
            yield {name: f}, list(dict.fromkeys([*keys, *f.within]))
        else:
            by_group.setdefault(f.within, {})[name] = f
    for within, features in by_group.items():
        yield features, list(dict.fromkeys([*keys, *within]))


def _chunk_pass(
    chunked: DataFrame, stored: DataFrame, features: dict[str, Feature], group: list[str], order: list[str]
) -> DataFrame:
    """One round over the chunks. Carry rows are made from ``stored``, which is on disk, so
    that rounds do not repeat each other's work."""
    first = next(iter(features.values()))
    if isinstance(first, RunningSum):
        carry = prefix_sums(stored, group, first.value)
    else:
        needed = dict.fromkeys([*group, *order, *[f.value for f in features.values()], CHUNK])
        carry = last_rows(stored.select(*needed), group, order, max(f.reach for f in features.values()))
    return over_chunks(
        chunked,
        carry,
        group,
        order,
        lambda df, partition, ordering: df.withColumns(
            {name: f.column(partition, ordering) for name, f in features.items()}
        ),
    )


def lag_value(df, value, name, *, team, order, offset=1, hot_rows=HOT_ROWS) -> DataFrame:
    """The team's value ``offset`` rows earlier, across seasons; text or number."""
    return add_history(df, {name: Lag(value, offset)}, team=team, order=order, hot_rows=hot_rows)


def rolling_sum(df, value, name, *, team, order, width=3, shift=0, hot_rows=HOT_ROWS) -> DataFrame:
    """Sum of the last ``width`` rows, moved back by ``shift`` rows; null when incomplete."""
    return add_history(df, {name: RollingSum(value, width, shift)}, team=team, order=order, hot_rows=hot_rows)


def running_sum(df, value, name, *, team, season, order, hot_rows=HOT_ROWS) -> DataFrame:
    """Season-to-date sum."""
    return add_history(df, {name: RunningSum(value, (season,))}, team=team, order=order, hot_rows=hot_rows)


def running_sum_lagged(
    df, value, name, *, team, season, order, reset=False, hot_rows=HOT_ROWS
) -> DataFrame:
    """Season-to-date sum before the current row.

    The first row of a season gets the previous season's final sum; ``reset=True``
    gives it null instead.
    """
    within = (season,) if reset else ()
    total = f"_{name}_total"
    return add_history(
        df,
        {total: RunningSum(value, (season,))},
        {name: Lag(total, within=within)},
        team=team,
        order=order,
        hot_rows=hot_rows,
    ).drop(total)


def last_meeting(df, value, name, *, team, against, order, hot_rows=HOT_ROWS) -> DataFrame:
    """Value at the team's last row with the same ``against`` (a fixture or an opponent)."""
    return add_history(df, {name: Lag(value, within=(against,))}, team=team, order=order, hot_rows=hot_rows)
