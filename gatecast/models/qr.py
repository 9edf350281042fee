"""The full linear fit by QR of the tall design, for designs whose sums of products lose the answer.

Sums of products square the condition of the design: two columns that differ by a part in 10**5 differ by one in
10**10 there, and the fit drops one of them. Here every task turns its rows of [1, terms, target] into
a triangle R, batch by batch, and triangles are stacked and factored again, in two levels, until there is one per part of
the split. Stacking keeps what least squares needs: a fit on any parts follows from their triangles, a horizon's from some
columns, a test error from the test part's triangle. A row is terms squared numbers, however many rows the data has.

The last factoring goes through the columns in order and moves one aside whose rest, after the columns before it
are taken out, is below ``ALIAS`` of its length: aliased columns are left out, the earlier one stays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.models.design import Design
from gatecast.models.gram import PACKED, TEST, by_part, design_rows, merged, packed

ALIAS = 1e-7  # of a column's length


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, square: zero rows fill it up."""
    width = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def r_factors(df: DataFrame, design: Design, part: str, mask: str | None = None) -> DataFrame:
    """Rows (part, mask, values): the upper triangle R of [1, terms, target], row by row, in one pass over the data."""
    width = len(design.terms) + 2
    inputs, rows_of = design_rows(df, design, part, mask)
    upper = np.triu_indices(width)

    def factored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key, own in by_part(batch, rows_of(batch)):
                found[key] = triangle(np.vstack([found[key], own]) if key in found else own)
        yield from packed({key: r[upper] for key, r in found.items()})

    def stacked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return triangle(np.vstack([unpacked(a, width), unpacked(b, width)]))[upper]

    return merged(inputs.mapInPandas(factored, PACKED), stacked)


def unpacked(values: np.ndarray, width: int) -> np.ndarray:
    r = np.zeros((width, width))
    r[np.triu_indices(width)] = values
    return r


def least_squares(r: np.ndarray) -> tuple[np.ndarray, float]:
    """(coefficients of [1, terms], residual sum of squares) from R of [1, terms, target]; zero for aliased columns."""
    x, y = r[:, :-1], r[:, -1]
    basis, kept = np.zeros((len(r), 0)), []
    for j, column in enumerate(x.T):
        rest = column
        for _ in range(2):  # twice, so that the basis stays orthogonal to the last digit
            rest = rest - basis @ (basis.T @ rest)
        length = np.linalg.norm(rest)
        if length > ALIAS * np.linalg.norm(column):
            basis, kept = np.column_stack([basis, rest / length]), [*kept, j]
    beta = np.zeros(x.shape[1])
    beta[kept] = np.linalg.solve(np.triu(basis.T @ x[:, kept]), basis.T @ y)
    rest = y - basis @ (basis.T @ y)
    return beta, float(rest @ rest)


def full_fits(factors: DataFrame, design: Design, horizons: dict[str, Sequence[str]], paths: str, model: str, masked: bool = False) -> DataFrame:
    """The full fit on all training rows per horizon as a row of ``paths``, scored on the test part. One task per horizon."""
    width = len(design.terms) + 2
    origin = np.array([design.origin[t.column] if t.level is None else 0.0 for t in design.terms])
    origin_y = design.origin[design.target]
    places = {h: design.positions(predictors) for h, predictors in horizons.items()}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        horizon = rows["horizon"].iloc[0]
        used = np.array(places[horizon], dtype=int)
        columns = np.r_[0, used + 1, width - 1]
        blocks = [unpacked(values, width)[:, columns] for values in rows["values"]]
        train = [block for block, part in zip(blocks, rows["part"]) if part != TEST]
        test = [block for block, part in zip(blocks, rows["part"]) if part == TEST]
        if not train:
            return pd.DataFrame(columns=[f.split()[0] for f in paths.split(", ")])
        beta, rss = least_squares(triangle(np.vstack(train)))
        held = np.vstack(test) if test else np.zeros((1, len(columns)))
        error, n = held @ np.append(beta, -1.0), round(float(held[:, 0] @ held[:, 0]))
        spread = np.zeros(width - 2)
        spread[used] = beta[1:]
        row = {"horizon": horizon, "model": model, "fold": 0, "step": 1, "lambda": None, "size": int(np.count_nonzero(spread)), "n": float(n)}
        row |= {"mse": float(error @ error) / n if n else float("nan"), "rss": rss, "intercept": float(beta[0]) + origin_y - float(origin @ spread), "betas": spread}
        return pd.DataFrame([row])

    bits = [F.struct(F.lit(h).alias("horizon"), F.lit(1 << k if masked else 0).alias("bit")) for k, h in enumerate(horizons)]
    own = factors.withColumn("h", F.explode(F.array(*bits)))
    own = own.where(F.col("mask").bitwiseAND(F.col("h.bit")) == F.col("h.bit")).select("h.horizon", "part", "values")
    return own.groupBy("horizon").applyInPandas(fit, paths)
