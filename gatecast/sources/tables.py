"""Stored tables, typed snapshots and literal rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecast.operators.categorical import factor_levels


def table_overwrite(df: DataFrame, name: str, path: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """Store a table in place of an earlier one. ``path`` makes it an external table."""
    _save(df, name, "overwrite", path, partition_by)


def table_create(df: DataFrame, name: str, path: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """Store a new table; fails when it exists."""
    _save(df, name, "errorifexists", path, partition_by)


def _save(df: DataFrame, name: str, mode: str, path: str | None, partition_by: Sequence[str]) -> None:
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def table_read(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def table_list(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """Names of the stored tables, temporary views left out."""
    tables = [(t.name,) for t in spark.catalog.listTables(pattern=pattern) if not t.isTemporary]
    return spark.createDataFrame(tables, "name string").orderBy("name")


def sql_query(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Run a SQL text; ``{name}`` in it stands for a given frame."""
    return spark.sql(text, **frames)


def snapshot_write(df: DataFrame, path: str, categories: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Store a typed frame, and beside it the sorted levels of its category columns."""
    df.write.mode(mode).parquet(f"{path}/rows")
    if categories:
        factor_levels(df, categories).write.mode(mode).parquet(f"{path}/levels")


def snapshot_read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def snapshot_levels(spark: SparkSession, path: str) -> DataFrame:
    """Rows (variable, level, position) stored with a snapshot."""
    return spark.read.parquet(f"{path}/levels")


def inline_rows(spark: SparkSession, columns: dict[str, Sequence], schema: str) -> DataFrame:
    """A literal frame from columns, e.g. what-if rows."""
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema).select(*columns)


def with_key_from_path(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """Add the batch key found in the path of the file a row was read from."""
    return df.withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
