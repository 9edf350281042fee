"""Filling a missing last-meeting value by the mean of its size band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.functions.cases import case_when, null_flag
from gatecast.operators.aggregates import group_mean_broadcast
from gatecast.operators.columns import drop_range

BORDER = 4000


def impute_group_mean(df: DataFrame, column: str, target: str, border: float = BORDER) -> DataFrame:
    """Fill nulls of ``column`` with the mean ``target`` of rows in the same band.

    Bands exist only for rows where ``column`` is null: ``target`` below or above
    ``border``; exactly on it there is no band and the null stays. The band is taken
    from the target itself, so a model trained on the result sees a trace of it.
    ``df`` is read twice: store it first when it is costly.
    """
    out = df.withColumn("_new", null_flag(F.col(column)))
    out = out.withColumn(
        "_band",
        case_when(
            ((F.col("_new") == 1) & (F.col(target) < border), 1), ((F.col("_new") == 1) & (F.col(target) > border), 2)
        ),
    )
    out = group_mean_broadcast(out, ["_band"], target, "_mean")
    filled = F.when(F.col(column).isNull() & F.col("_band").isin(1, 2), F.col("_mean")).otherwise(F.col(column))
    return drop_range(out.withColumn(column, filled), "_new", "_mean")
