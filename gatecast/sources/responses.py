"""Stored JSON responses to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The properties of an observation in the public weather interface, and the three that the model frame uses.
OBSERVATION = "created: string, observed: string, parameterId: string, stationId: string, value: double"
CHOSEN = ("parameterId", "value", "observed")
HOLIDAYS = "array<struct<date: string, localName: string>>"


def json_flatten(df: DataFrame, column: str, schema: str, path: str, inner: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the structs ``inner`` in the array ``path`` of a JSON text; unreadable text gives no rows."""
    parsed = df.select(*keep, F.from_json(F.col(column), schema).alias("_j"))
    rows = parsed.select(*keep, F.explode(f"_j.{path}").alias("_e"))
    return rows.select(*keep, f"_e.{inner}.*" if inner else "_e.*")


def observations(responses: DataFrame, column: str = "body", properties: str = OBSERVATION) -> DataFrame:
    """Observations with all their properties, for the full stored table."""
    schema = f"features array<struct<properties: struct<{properties}>>>"
    return json_flatten(responses, column, schema, "features", "properties")


def weather_long(responses: DataFrame, column: str = "body") -> DataFrame:
    """Observations (parameterId, value, observed)."""
    return observations(responses, column).select(*CHOSEN)


def holidays(responses: DataFrame, column: str = "body") -> DataFrame:
    """Holidays (dato, helligdag) of all stored years."""
    parsed = responses.select(F.explode(F.from_json(F.col(column), HOLIDAYS)).alias("e"))
    return parsed.select(F.col("e.date").alias("dato"), F.col("e.localName").alias("helligdag"))
