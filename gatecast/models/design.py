"""From a model frame to numbers: levels, terms and dummy columns.

Levels and means are fixed on the whole frame before any split. The first sorted
level of each text column is the baseline and gets no term.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatecast.operators.categorical import distinct_levels

MAX_TERMS = 1000


@dataclass(frozen=True)
class Term:
    """One column of the design: a number, or a 0/1 mark for one level."""

    column: str
    level: str | None = None

    @property
    def name(self) -> str:
        return self.column if self.level is None else f"{self.column}={self.level}"

    def value(self) -> Column:
        if self.level is None:
            return F.col(self.column).cast("double")
        return (F.col(self.column) == self.level).cast("double")


@dataclass(frozen=True)
class Design:
    """Terms of a frame, with means that serve as origin for sums of products."""

    target: str
    predictors: tuple[str, ...]
    levels: dict[str, tuple[str, ...]]
    origin: dict[str, float]

    @property
    def terms(self) -> list[Term]:
        out = []
        for c in self.predictors:
            out += [Term(c, level) for level in self.levels[c][1:]] if c in self.levels else [Term(c)]
        return out

    def positions(self, predictors: Sequence[str]) -> list[int]:
        """Places of the terms of some predictors, for a horizon's sub-block."""
        return [i for i, t in enumerate(self.terms) if t.column in predictors]


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in the columns."""
    return df.dropna(subset=list(columns))


def horizon_mask(horizons: dict[str, Sequence[str]]) -> Column:
    """A whole number per row: bit k is set where all predictors of the k-th horizon are filled."""
    mask = F.lit(0)
    for k, predictors in enumerate(horizons.values()):
        filled = F.lit(True)
        for c in predictors:
            filled = filled & F.col(c).isNotNull()
        mask = mask + F.when(filled, 1 << k).otherwise(0)
    return mask


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many rows there are, how many are complete, and the nulls per column."""
    filled = F.lit(True)
    for c in columns:
        filled = filled & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(filled).alias("complete"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )


def fit_design(df: DataFrame, target: str, predictors: Sequence[str], max_terms: int = MAX_TERMS) -> Design:
    """Read levels and means off the whole frame (two aggregates).

    The number of levels is checked before they are fetched; the model sums need
    ``terms`` squared numbers per fold.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in predictors if isinstance(kinds[c], (T.StringType, T.BooleanType))]
    numeric = [c for c in predictors if c not in text]
    levels: dict[str, list[str]] = {c: [] for c in text}
    if text:
        found = distinct_levels(df, text).limit(max_terms + 1).collect()
        if len(found) > max_terms:
            raise ValueError(f"more than {max_terms} levels: lump rare ones first")
        for row in sorted(found, key=lambda r: r["level"]):
            levels[row["variable"]].append(row["level"])
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in [*numeric, target]]).first()
    return Design(
        target,
        tuple(predictors),
        {c: tuple(v) for c, v in levels.items()},
        {c: means[c] or 0.0 for c in [*numeric, target]},
    )


def design_matrix(df: DataFrame, design: Design, keep: Sequence[str] = ()) -> DataFrame:
    """One numeric column per term, without an intercept column."""
    return df.select(*keep, *[t.value().alias(t.name) for t in design.terms])


def prediction(
    design: Design, intercept: float, betas: Sequence[float], predictors: Sequence[str] | None = None
) -> Column:
    """Fitted value as one expression over ``predictors`` (default: all of the design).

    ``betas`` has one number per term of the design. The value is null when one of
    the predictors is null or has an unknown level.
    """
    used = [c for c in design.predictors if predictors is None or c in predictors]
    weight = {(t.column, t.level): float(b) for t, b in zip(design.terms, betas, strict=True)}
    total, filled = F.lit(float(intercept)), F.lit(True)
    for c in used:
        if c in design.levels:
            entries = [x for level in design.levels[c] for x in (F.lit(level), F.lit(weight.get((c, level), 0.0)))]
            total = total + F.element_at(F.create_map(*entries), F.col(c).cast("string"))
        elif weight[(c, None)]:
            total = total + F.col(c).cast("double") * F.lit(weight[(c, None)])
        else:
            filled = filled & F.col(c).isNotNull()
    return F.when(filled, total)
