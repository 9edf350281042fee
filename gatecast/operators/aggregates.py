"""Aggregates. Group values are computed by partial aggregation and joined back,
so that a group of any size never sits in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.operators.nulls import mean_agg


def attach_summary(df: DataFrame, summary: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a per-group summary back to the rows, null keys included.

    No hint is given: Spark broadcasts the summary if its measured bytes are below the
    session's threshold, and else shuffles both sides and splits skewed partitions.
    """
    extra = [c for c in summary.columns if c not in keys]
    # New names, as the summary often comes from the same rows.
    own = summary.select(*[F.col(c).alias(f"_summary_{c}") for c in summary.columns])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_summary_{k}")) for k in keys])
    return df.join(own, match, how).select(*df.columns, *[F.col(f"_summary_{c}").alias(c) for c in extra])


def group_mean_broadcast(df: DataFrame, keys: Sequence[str], value: str, name: str, na: str = "propagate") -> DataFrame:
    """The group's mean on each of its rows; a group with a null has no mean unless ``na='skip'``."""
    keys = list(keys)
    means = df.groupBy(*keys).agg(mean_agg(F.col(value), na).alias(name))
    return attach_summary(df, means, keys)


def mse(actual: Column, predicted: Column) -> Column:
    """Mean squared difference, null as soon as one prediction is null."""
    return mean_agg(F.pow(actual - predicted, F.lit(2.0)))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(mse(actual, predicted))


def fold_mean(df: DataFrame, by: Sequence[str], value: str, folds: int, name: str = "cv_mse") -> DataFrame:
    """Mean over folds; a size that is missing or null in any fold is left out."""
    return (
        df.groupBy(*by)
        .agg(F.count(value).alias("_filled"), F.avg(value).alias(name))
        .where(F.col("_filled") == folds)
        .drop("_filled")
    )


def arg_min(df: DataFrame, by: Sequence[str], label: str, value: str, rank: str | None = None) -> DataFrame:
    """Label with the smallest value per group, nulls skipped, ties to the lowest rank (or label)."""
    found = df.where(F.col(value).isNotNull())
    best = F.min(F.struct(F.col(value).alias("v"), F.col(rank or label).alias("r"), F.col(label).alias("l")))
    return (
        found.groupBy(*by)
        .agg(best.alias("_b"))
        .select(*by, F.col("_b.l").alias(label), F.col("_b.v").alias(value))
    )


def column_min(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias(name))


def row_count_fraction(df: DataFrame, fraction: float, name: str = "size") -> DataFrame:
    """One row: the whole part of ``fraction`` of the row count."""
    return df.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias(name))


def level_counts(df: DataFrame, level: str, name: str = "n") -> DataFrame:
    """The frequency of its level on each row."""
    return attach_summary(df, df.groupBy(level).agg(F.count(F.lit(1)).alias(name)), [level])


def cv_summary(df: DataFrame, by: Sequence[str], mse_col: str = "mse", weight: str = "n") -> DataFrame:
    """Mean of fold errors weighted by fold size (``cvm``) and its standard error (``cvsd``).

    With folds of one size ``cvsd`` is the sample deviation over the root of the fold count.
    """
    w, m = F.col(weight), F.col(mse_col)
    means = df.groupBy(*by).agg((F.sum(w * m) / F.sum(w)).alias("cvm"))
    spread = F.sum(w * F.pow(m - F.col("cvm"), F.lit(2.0))) / F.sum(w)
    sums = df.join(means, list(by)).groupBy(*by).agg(F.max("cvm").alias("cvm"), spread.alias("_s"), F.count(m).alias("folds"))
    return sums.select(*by, "cvm", F.sqrt(F.col("_s") / (F.col("folds") - 1)).alias("cvsd"), "folds")


def one_se(cv: DataFrame, by: Sequence[str], penalty: str = "lambda") -> DataFrame:
    """Per group: the penalty with the smallest error, and the largest one within one standard error."""
    lowest = F.min(F.struct(F.col("cvm"), (-F.col(penalty)).alias("neg"), F.col("cvsd")))
    best = cv.groupBy(*by).agg(lowest.alias("_b"))
    best = best.select(
        *by,
        (-F.col("_b.neg")).alias("lambda_min"),
        F.col("_b.cvm").alias("cvm_min"),
        (F.col("_b.cvm") + F.col("_b.cvsd")).alias("_limit"),
    )
    return (
        cv.join(best, list(by))
        .where(F.col("cvm") <= F.col("_limit"))
        .groupBy(*by, "lambda_min", "cvm_min")
        .agg(F.max(penalty).alias("lambda_1se"))
    )
