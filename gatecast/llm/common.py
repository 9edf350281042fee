"""Small helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(columns: list[str], wish: str) -> str:
    """``wish``, or the first of ``wish_1``, ``wish_2``, … that no column has (names ignore case, as in Spark)."""
    taken = {c.lower() for c in columns}
    name, n = wish, 0
    while name.lower() in taken:
        n += 1
        name = f"{wish}_{n}"
    return name


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def per_text(function: Callable[[str], tuple], schema: str) -> Callable[[Column], Column]:
    """A column function that runs ``function`` on each whole text (null counts as empty) in Arrow batches.

    ``function`` returns one value per field of ``schema``. The result is marked as not
    deterministic so that the optimizer never copies the call into a filter and runs it twice.
    """
    names = [part.split()[0] for part in re.sub(r"<[^<>]*(<[^<>]*(<[^<>]*>[^<>]*)*>[^<>]*)*>", "", schema).split(",")]

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [function("" if text is None else text) for text in batch]
            yield pd.DataFrame({name: [row[k] for row in rows] for k, name in enumerate(names)}, columns=names)

    batches.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(batches, schema).asNondeterministic()
