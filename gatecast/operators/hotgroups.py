"""Ordered windows over groups of any size.

A window runs one whole group in one task. A group above ``hot_rows`` is split
instead: its rows are range partitioned by (group, order), each range becomes a
chunk, and every chunk is given carry rows that stand for what came before it.
The same window expressions then run per (group, chunk), and the carry rows are
dropped. Results are those of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatecast.session import materialize

CHUNK = "_chunk"
REAL = "_real"
HOT_ROWS = 500_000  # the sorts and windows of a whole group take about 1 KB a row in one task


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys: a null key is a group of its own."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def split_hot_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Return (ordinary rows, chunked rows of hot groups or None).

    The check is one aggregate on the key columns. At most rows/hot_rows groups
    can be hot; their stored list is broadcast if Spark measures it as small.
    """
    if hot_rows is None:
        return df, None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    found = sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("rows")).first()
    if not found["groups"]:
        return df, None
    hot = materialize(sizes.select(*keys), "hot-keys")
    cold = df.join(hot, same_keys(df, hot, keys), "left_anti")
    ranges = -(-found["rows"] // hot_rows) * 2
    chunked = (
        df.join(hot, same_keys(df, hot, keys), "left_semi")
        .repartitionByRange(ranges, *keys, *order)
        .withColumn(CHUNK, F.spark_partition_id())
    )
    # The range borders come from a sample taken at run time: fix them on disk.
    return cold, materialize(chunked, "chunks")


def last_rows(chunked: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int) -> DataFrame:
    """Carry rows for windows that look back ``reach`` rows.

    The last ``reach`` rows of each chunk are kept (Spark prunes by rank before
    the shuffle); a chunk gets the last ``reach`` of those from all earlier chunks.
    Chunks are never empty, so ``reach`` earlier chunks are enough.
    """
    newest = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order])
    aged = F.struct((-F.col("_rank")).alias("age"), F.struct(*chunked.columns).alias("row"))
    tails = (
        chunked.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= reach)
        .groupBy(*keys, CHUNK)
        .agg(F.sort_array(F.collect_list(aged)).alias("_tail"))
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    none = F.slice("_tail", 1, 0)
    earlier = F.concat(
        *[F.coalesce(F.lag("_tail", back).over(by_chunk), none) for back in range(reach, 0, -1)]
    )
    carried = F.expr(f"slice(_earlier, greatest(size(_earlier) - {reach} + 1, 1), {reach})")
    return (
        tails.withColumn("_earlier", earlier)
        .select(F.col(CHUNK).alias("_to"), F.explode(carried).alias("_carry"))
        .select(
            *[F.col(f"_carry.row.{c}").alias(c) for c in chunked.columns if c != CHUNK],
            F.col("_to").alias(CHUNK),
        )
    )


def prefix_sums(chunked: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Carry rows for running sums: one row per chunk with the sum of all earlier chunks.

    The row's value is null when any earlier value was null.
    """
    per_chunk = chunked.groupBy(*keys, CHUNK).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_filled"), F.count(F.lit(1)).alias("_rows")
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_chunk.select(
            *keys,
            CHUNK,
            F.sum("_rows").over(before).alias("_seen"),
            F.when(F.sum("_filled").over(before) == F.sum("_rows").over(before), F.sum("_sum").over(before)).alias(value),
        )
        .where(F.col("_seen") > 0)
        .drop("_seen")
    )


def over_chunks(
    chunked: DataFrame,
    carry: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    add_columns: Callable[[DataFrame, list[str], list], DataFrame],
) -> DataFrame:
    """Run ``add_columns(df, partition, order)`` per chunk with its carry rows in front."""
    both = chunked.withColumn(REAL, F.lit(1)).unionByName(
        carry.withColumn(REAL, F.lit(0)), allowMissingColumns=True
    )
    done = add_columns(both, [*keys, CHUNK], [REAL, *order])
    return done.where(F.col(REAL) == 1).drop(REAL)
