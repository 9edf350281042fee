"""Column work on whole frames: naming, placing, keeping, dropping, casting."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that do not decompose into a base letter plus an accent.
SPELLED_OUT = {"æ": "ae", "ø": "o", "å": "a", "ß": "ss", "œ": "oe", "đ": "d", "ł": "l"}
WORDS = {"%": "_percent_", "#": "_number_"}


def snake(name: str) -> str:
    """``name`` in lower snake case, ASCII only, never starting with a digit."""
    text = re.sub(r"(?<=[a-zæøå0-9])(?=[A-ZÆØÅ])", "_", name)
    text = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", "_", text).lower()
    for sign, word in {**SPELLED_OUT, **WORDS}.items():
        text = text.replace(sign, word)
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    text = re.sub(r"[^a-z0-9]+", "_", text).strip("_")
    return f"x{text}" if not text or text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """All columns in snake case; repeated names get ``_2``, ``_3`` …"""
    seen: dict[str, int] = {}
    names = []
    for name in map(snake, df.columns):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Give the columns new names by position; the count must fit."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns, {len(names)} names")
    return df.toDF(*names)


def derive(df: DataFrame, after: str | None = None, **columns: Column) -> DataFrame:
    """Add or overwrite columns in the given order; a later one sees the earlier ones.

    New columns go behind ``after`` when it is given, else to the end.
    """
    before = df.columns
    for name, value in columns.items():
        df = df.withColumn(name, value)
    new = [c for c in columns if c not in before]
    return place_after(df, new, after) if after else df


def place_after(df: DataFrame, names: str | Sequence[str], after: str) -> DataFrame:
    """Move ``names`` to the place right behind column ``after``."""
    moved = [names] if isinstance(names, str) else list(names)
    rest = [c for c in df.columns if c not in moved]
    cut = rest.index(after) + 1
    return df.select(*rest[:cut], *moved, *rest[cut:])


def keep(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in that order."""
    return df.select(*names)


def drop(df: DataFrame, *names: str) -> DataFrame:
    """All but the named columns; an unknown name is an error."""
    unknown = set(names) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.drop(*names)


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Drop the run of columns from ``first`` to ``last``."""
    a, b = df.columns.index(first), df.columns.index(last)
    return df.drop(*df.columns[min(a, b) : max(a, b) + 1])


def rename_select(df: DataFrame, **new_from_old: str) -> DataFrame:
    """Keep columns under new names: ``rename_select(df, day="date")``."""
    return df.select(*[F.col(old).alias(new) for new, old in new_from_old.items()])


def map_columns_by_type(df: DataFrame, kind: type[T.DataType], change: Callable[[Column], Column]) -> DataFrame:
    """Apply ``change`` to each column of the given type."""
    hits = [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]
    return df.withColumns({c: change(F.col(c)) for c in hits}) if hits else df


def cast_columns(df: DataFrame, **types: str) -> DataFrame:
    """Cast columns; text that does not fit becomes null instead of failing the job."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def constant_key(df: DataFrame, **values) -> DataFrame:
    """Attach the key of a batch (a season, a year) to each of its rows."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def scale(df: DataFrame, column: str, factor: float) -> DataFrame:
    """Multiply one column by a number."""
    return df.withColumn(column, F.col(column) * F.lit(factor))


def copy_column(df: DataFrame, column: str, name: str) -> DataFrame:
    """A second copy of ``column``, to be taken apart while the first is kept."""
    return df.withColumn(name, F.col(column))


def key_vector(df: DataFrame, column: str) -> DataFrame:
    """The distinct filled keys of one column, for lookups by semi join; stays distributed."""
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def star_plus(left: DataFrame, right: DataFrame, picks: Sequence[str]) -> list[Column]:
    """All columns of ``left`` plus some of ``right``, for the select behind a join."""
    return [left[c] for c in left.columns] + [right[c] for c in picks]
