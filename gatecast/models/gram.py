"""Sums of products of the design, per part of the split, in one pass over the data.

All linear fits, their cross validation and their test errors follow from these
sums: a training sum is the total minus the held-out part, and the horizons are
sub-blocks over the rows that are complete for them. The data itself is read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.models.design import Design

TEST = 0


SALTS = 64  # tasks of the first level of the sum


def design_rows(df: DataFrame, design: Design, part: str, mask: str | None = None) -> tuple[DataFrame, Callable[[pd.DataFrame], np.ndarray]]:
    """The columns that the sums need (part, mask, inputs of the terms, target), and [1, terms, target] of a batch of them.

    Numbers are measured from the design's origin to avoid cancellation. With a mask a null
    counts as the origin; without one it is an error.
    """
    terms = design.terms
    width = len(terms) + 2
    sources = [F.col(part).cast("int").alias("part"), (F.col(mask) if mask else F.lit(0)).cast("int").alias("mask")]
    sources += [F.col(name).cast("string").alias(f"c_{name}") for name in design.levels]
    numeric = [t.column for t in terms if t.level is None]
    for name in [*numeric, design.target]:
        sources.append((F.col(name).cast("double") - F.lit(design.origin[name])).alias(f"n_{name}"))
    levels = {f"c_{name}": pd.Index(values) for name, values in design.levels.items()}
    plan = [(p, f"n_{t.column}", None) if t.level is None else (p, f"c_{t.column}", t.level) for p, t in enumerate(terms, 1)]
    plan.append((width - 1, f"n_{design.target}", None))

    def rows_of(batch: pd.DataFrame) -> np.ndarray:
        codes = {c: index.get_indexer(batch[c]) for c, index in levels.items()}
        rows = np.ones((len(batch), width))
        for place, column, level in plan:
            if level is not None:
                missing = batch[column].isna().to_numpy()
                values = (codes[column] == levels[column].get_loc(level)).astype(float)
            else:
                values = batch[column].to_numpy(dtype=float)
                missing = np.isnan(values)
            if missing.any():
                if not mask:
                    raise ValueError(f"null in {column[2:]}: drop incomplete rows before the split")
                values = np.where(missing, 0.0, values)
            rows[:, place] = values
        return rows

    return df.select(*sources), rows_of


def by_part(batch: pd.DataFrame, rows: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """The rows of each (part, mask) of a batch."""
    for kind in pd.MultiIndex.from_frame(batch[["part", "mask"]]).unique():
        yield (int(kind[0]), int(kind[1])), rows[(batch["part"] == kind[0]) & (batch["mask"] == kind[1])]


PACKED = "part int, mask int, values array<double>"


def packed(found: dict[tuple[int, int], np.ndarray]) -> Iterator[pd.DataFrame]:
    """One row of ``PACKED`` per (part, mask)."""
    if found:
        yield pd.DataFrame({"part": [p for p, _ in found], "mask": [m for _, m in found], "values": list(found.values())})


def merged(by_task: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """One row of ``PACKED`` per (part, mask) from those of the tasks, first by salt, then by part; a task holds one block per (part, mask)."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for p, m, values in zip(batch["part"], batch["mask"], batch["values"]):
                found[p, m] = merge(found[p, m], values) if (p, m) in found else np.array(values)
        yield from packed(found)

    salted = by_task.withColumn("salt", F.spark_partition_id() % SALTS).repartition("salt")
    return salted.select("part", "mask", "values").mapInPandas(joined, PACKED).repartition("part", "mask").mapInPandas(joined, PACKED)


def gram(df: DataFrame, design: Design, part: str, mask: str | None = None) -> DataFrame:
    """Rows (part, mask, i, j, value), i <= j, of the matrix [1, terms, target]' [1, terms, target].

    ``mask`` names a column of whole numbers that splits the sums once more (for rows that are
    complete for some horizons only); the caller then only reads sub-blocks whose columns are filled.

    Each task packs one block per (part, mask) into one row. The rows are added up in two levels.
    """
    width = len(design.terms) + 2
    inputs, rows_of = design_rows(df, design, part, mask)
    upper = np.triu_indices(width)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key, own in by_part(batch, rows_of(batch)):
                sums[key] = sums.get(key, 0.0) + own.T @ own
        yield from packed({key: block[upper] for key, block in sums.items()})

    whole = merged(inputs.mapInPandas(blocks, PACKED), lambda a, b: a + b)
    place = F.posexplode("values").alias("at", "value")
    # The packed rows of an upper triangle, counted from the end, are the triangle numbers.
    back = F.lit(len(upper[0]) - 1) - F.col("at")
    row = F.floor((F.sqrt(8.0 * back + 1) - 1) / 2)
    i, j = F.lit(width - 1) - row, F.lit(width - 1) - (back - row * (row + 1) / 2)
    return whole.select("part", "mask", place).select("part", "mask", i.cast("int").alias("i"), j.cast("int").alias("j"), "value")


def fold_grams(grams: DataFrame, folds: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows (*by, fold, i, j, train, held, full).

    Fold 0 trains on all training rows and holds out the test part; fold f trains
    without part f and holds part f out. ``full`` repeats the sums of fold 0.
    """
    every = F.array(*[F.lit(f) for f in range(folds + 1)])
    held = F.col("part") == F.col("fold")
    training = (F.col("part") != TEST) & ~held
    return (
        grams.withColumn("fold", F.explode(every))
        .groupBy(*by, "fold", "i", "j")
        .agg(
            F.sum(F.when(training, F.col("value")).otherwise(0.0)).alias("train"),
            F.sum(F.when(held, F.col("value")).otherwise(0.0)).alias("held"),
            F.sum(F.when(F.col("part") != TEST, F.col("value")).otherwise(0.0)).alias("full"),
        )
    )


def square(i: np.ndarray, j: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """Symmetric matrix from its upper rows."""
    out = np.zeros((width, width))
    out[i, j] = value
    out[j, i] = value
    return out
