"""Levels of text columns: listing, lumping rare ones, aligning new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.operators.aggregates import attach_summary
from gatecast.operators.windows import RunningSum, add_history


def distinct_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (variable, level) of the distinct values of each column, nulls left out."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in columns]
    )
    levels = df.select(F.explode(pairs).alias("p")).select("p.variable", "p.level")
    return levels.where(F.col("level").isNotNull()).distinct()


def factor_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (variable, level, position): the sorted distinct levels of each column, nulls left out."""
    levels = distinct_levels(df, columns)
    counted = levels.withColumn("_one", F.lit(1))
    placed = add_history(counted, {"position": RunningSum("_one")}, team="variable", order=["level"])
    return placed.select("variable", "level", F.col("position").cast("int").alias("position"))


def lump_rare(df: DataFrame, column: str, least: int, other: str) -> DataFrame:
    """Levels seen fewer than ``least`` times in the whole frame become ``other``; null stays null."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    rare = counts.where((F.col("_n") < least) & F.col(column).isNotNull())
    marked = attach_summary(df, rare, [column])
    return marked.withColumn(column, F.when(F.col("_n").isNotNull(), other).otherwise(F.col(column))).drop("_n")


def align_levels(df: DataFrame, levels: dict[str, Sequence[str]]) -> DataFrame:
    """Force columns onto known levels; an unknown value becomes null."""
    return df.withColumns(
        {c: F.when(F.col(c).cast("string").isin(*known), F.col(c).cast("string")) for c, known in levels.items()}
    )


def align_to_levels(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    """Force a column onto the levels of a table (column ``level``), however many; an unknown value becomes null."""
    known = levels.select(F.col("level").alias(column), F.lit(True).alias("_known")).distinct()
    marked = attach_summary(df.withColumn(column, F.col(column).cast("string")), known, [column])
    return marked.withColumn(column, F.when(F.col("_known"), F.col(column))).drop("_known")


def feature_sets(shared: Sequence[str], extra: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Predictors per horizon: the shared ones plus what is known only by then."""
    return {horizon: [*shared, *more] for horizon, more in extra.items()}
