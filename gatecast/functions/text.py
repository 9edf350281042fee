"""Text expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detect(column: Column, pattern: str) -> Column:
    """True where the regular expression is found."""
    return column.rlike(pattern)


def split_lenient(df: DataFrame, column: str, names: Sequence[str], delim: str = "-") -> DataFrame:
    """Split into the named parts; missing parts are null.

    The source stays, joined by ``<column>_ok``, ``<column>_pieces`` and
    ``<column>_remainder`` (text behind the last named part).
    """
    n = len(names)
    pieces = F.split(F.col(column), re.escape(delim), -1)
    rest = F.concat_ws(delim, F.slice(pieces, F.lit(n + 1), F.greatest(F.size(pieces), F.lit(0))))
    return df.withColumns(
        {
            **{name: F.get(pieces, F.lit(i)) for i, name in enumerate(names)},
            f"{column}_ok": F.size(pieces) == n,
            f"{column}_pieces": F.when(F.col(column).isNotNull(), F.size(pieces)),
            f"{column}_remainder": F.when(
                F.col(column).isNotNull(),
                F.when(F.size(pieces) > n, F.concat(F.lit(delim), rest)).otherwise(F.lit("")),
            ),
        }
    )


def split_strict(df: DataFrame, column: str, names: Sequence[str], delim: str = "-") -> DataFrame:
    """Split into exactly the named parts and drop the source; another count fails the job."""
    n = len(names)
    pieces = F.split(F.col(column), re.escape(delim), -1)
    message = F.concat(F.lit(f"{column}: expected {n} parts in "), F.col(column))
    checked = F.when(F.col(column).isNull() | (F.size(pieces) == n), pieces).otherwise(
        F.raise_error(message).cast("array<string>")
    )
    return df.withColumns({name: F.get(checked, F.lit(i)) for i, name in enumerate(names)}).drop(column)


def paste(*columns: Column, sep: str = " ", na: str | None = "NA") -> Column:
    """Join texts. A null is written as ``na``; ``na=None`` makes the whole text null."""
    parts = [c.cast("string") for c in columns]
    if na is not None:
        return F.concat_ws(sep, *[F.coalesce(p, F.lit(na)) for p in parts])
    spaced = [parts[0]]
    for p in parts[1:]:
        spaced += [F.lit(sep), p]
    return F.concat(*spaced)


def parse_number(column: Column) -> Column:
    """First number inside a text, commas read as grouping marks; null when there is none."""
    found = F.regexp_extract(column, r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.regexp_replace(found, ",", "").try_cast("double")


def parse_grouped_number(column: Column, mark: str = ".") -> Column:
    """A whole number printed with a grouping mark: ``5.123`` is 5123, ``987`` is 987."""
    return F.replace(column, F.lit(mark), F.lit("")).try_cast("double")


def round_even(column: Column, digits: int = 0) -> Column:
    """Rounding with halves to the even neighbour."""
    return F.bround(column, digits)


def format_label(column: Column, *more: Column | str, big_mark: bool = False) -> Column:
    """Rounded number as text, with ``.`` for thousands on request, then further text."""
    whole = F.bround(column, 0).cast("bigint")
    number = F.translate(F.format_number(whole, 0), ",.", ".,") if big_mark else whole.cast("string")
    return F.concat(number, *[F.lit(m) if isinstance(m, str) else m.cast("string") for m in more])
