"""Stacking, pivoting and ordering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.functions.cases import rank_of


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_with_type_repair(*frames: DataFrame, **types: str) -> DataFrame:
    """Cast the columns that drift between frames, then stack by name."""
    cast = lambda df: df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})
    return union_by_name(*[cast(df) for df in frames])


def pivot_wider(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: str, names: Sequence[str], check: bool = True
) -> DataFrame:
    """One column per listed name. A second value for one cell fails the job when ``check`` is set.

    The names are given, so one shuffle on ``ids`` of pre-aggregated rows is enough.
    """

    def cell(name: str):
        own = F.when(F.col(names_from) == name, F.col(values_from))
        if not check:
            return F.max(own).alias(name)
        twice = F.raise_error(F.lit(f"more than one value for {name}")).cast(df.schema[values_from].dataType)
        return F.when(F.count(own) <= 1, F.max(own)).otherwise(twice).alias(name)

    return df.where(F.col(names_from).isin(*names)).groupBy(*ids).agg(*[cell(n) for n in names])


def pivot_longer(df: DataFrame, ids: Sequence[str], values: Sequence[str], names_to: str, values_to: str) -> DataFrame:
    """Columns to (name, value) rows."""
    return df.unpivot(list(ids), list(values), names_to, values_to)


def row_names_to_column(labels: Sequence[str], frame: DataFrame, position: str, name: str) -> DataFrame:
    """A label column from row positions counted from 1."""
    named = F.get(F.array(*[F.lit(x) for x in labels]), F.col(position).cast("int") - 1)
    return frame.select(named.alias(name), *[c for c in frame.columns if c != position])


def score_matrix(scores: DataFrame, horizons: Sequence[str], value: str = "mse", root: bool = False) -> DataFrame:
    """Model by horizon matrix from long (model, horizon, value) rows."""
    cell = F.max(F.sqrt(value) if root else F.col(value))
    return scores.groupBy("model").pivot("horizon", list(horizons)).agg(cell)


def order_by_level(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Sort by a given level order; labels outside it come last."""
    return df.orderBy(rank_of(F.col(column), levels).asc_nulls_last(), column)


def order_by_value_desc(df: DataFrame, value: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(value).desc_nulls_last(), *ties)


def top1_per_group(df: DataFrame, by: Sequence[str], label: str, value: str, levels: Sequence[str]) -> DataFrame:
    """Label with the smallest value per group; ties go to the label listed first."""
    best = F.min(
        F.struct(F.col(value).alias("v"), rank_of(F.col(label), levels).alias("r"), F.col(label).alias("l"))
    )
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(best.alias("_b"))
        .select(*by, F.col("_b.l").alias(label), F.col("_b.v").alias(value))
    )
