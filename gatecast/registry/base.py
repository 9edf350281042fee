"""Registered queries: each runs an operator over the given tables.

A query may carry SQL that gives the same rows, for a side-by-side check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecast.functions.cases import recode
from gatecast.functions.dates import season_of
from gatecast.functions.labels import DRAWN, LOST, POINTS, WON

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ORDER = ["o_orderdate", "o_orderkey"]


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``, with SQL that gives the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(column: Column | str, digits: int = 6) -> Column:
    """Rounded, because sums differ in their last bits by the order of adding."""
    return F.round(column, digits)


def games(spark: SparkSession, folder: str) -> DataFrame:
    """Orders read as matches: customer = team, priority = opponent, price = attendance.

    Orders under 25,000 count as not played: value, result and points are null.
    """
    o = table(spark, folder, "orders")
    played = F.col("o_totalprice") >= 25000
    return (
        o.withColumn("season", season_of(F.col("o_orderdate")))
        .withColumn("value", F.when(played, F.col("o_totalprice")))
        .withColumn("result", F.when(played, recode(F.col("o_orderstatus"), {"F": WON, "P": DRAWN, "O": LOST})))
        .withColumn("pts", recode(F.col("result"), {k: float(v) for k, v in POINTS.items()}))
    )


GAMES_SQL = f"""games AS (
  SELECT *, CASE result WHEN '{WON}' THEN 3.0::DOUBLE WHEN '{DRAWN}' THEN 1.0::DOUBLE WHEN '{LOST}' THEN 0.0::DOUBLE END AS pts
  FROM (SELECT *,
      (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END)::INTEGER AS season,
      CASE WHEN o_totalprice >= 25000 THEN o_totalprice END AS value,
      CASE WHEN o_totalprice >= 25000 THEN
        CASE o_orderstatus WHEN 'F' THEN '{WON}' WHEN 'P' THEN '{DRAWN}' WHEN 'O' THEN '{LOST}' END END AS result
    FROM orders))"""
