"""Exact reproducible splits and balanced folds, by the order of hashed keys.

``md5(key|seed)`` gives every row a fixed place in a random order. The key must be
unique. Sizes are met exactly by finding the hashes at the wanted places; rows are
then labelled by comparing their own hash with these, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3
HASH_DIGITS = 32
EDGE_ROWS = 20_000
HASH = "_hash"


def with_hash(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Add the fixed random place of every row. As a column of its own it is computed once per row."""
    return df.withColumn(HASH, F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))))


def _prefix(length: int) -> Column:
    return F.substring(HASH, 1, length)


def _counts(hashed: DataFrame, below: Sequence[str] = ("",)) -> dict[str, list[tuple[str, int]]]:
    """Row counts of the 16**DIGITS buckets below each of some hash prefixes of one length, in hash order, in one pass; fetched, as they are few."""
    length = len(below[0])
    if length:
        hashed = hashed.where(_prefix(length).isin(list(below)))
    counts = hashed.groupBy(_prefix(length + DIGITS).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    found: dict[str, list[tuple[str, int]]] = {start: [] for start in below}
    for row in sorted(counts.collect(), key=lambda r: r["b"]):
        found[row["b"][:length]].append((row["b"], row["n"]))
    return found


def _locate(counts: list[tuple[str, int]], place: int) -> tuple[str, int, int]:
    """Bucket that holds a place, the place within it, and the bucket's size."""
    for bucket, n in counts:
        if place <= n:
            return bucket, place, n
        place -= n
    raise ValueError("place beyond the last row")


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def hashes_at(
    hashed: DataFrame, places: Sequence[int], counts: list[tuple[str, int]], edge_rows: int = EDGE_ROWS
) -> list[str]:
    """Hashes at some places (from 1) of the hash order.

    Buckets that hold a place are counted more finely, all of them in one pass per level,
    until they have ``edge_rows`` or fewer; only these few are sorted.
    """
    open_ = [_locate(counts, place) for place in places]
    order = list(range(len(places)))
    settled: dict[int, tuple[str, int]] = {}
    while open_:
        wide = []
        for k, (bucket, inside, n) in zip(order, open_):
            if n <= edge_rows:
                settled[k] = (bucket, inside)
            elif len(bucket) >= HASH_DIGITS:
                raise ValueError("the key is not unique")
            else:
                wide.append((k, bucket, inside))
        finer = _counts(hashed, sorted({bucket for _, bucket, _ in wide})) if wide else {}
        order = [k for k, _, _ in wide]
        open_ = [_locate(finer[bucket], inside) for _, bucket, inside in wide]
    spots = [settled[k] for k in range(len(places))]
    by_length: dict[int, list[str]] = {}
    for bucket in sorted({b for b, _ in spots}):
        by_length.setdefault(len(bucket), []).append(bucket)
    inside_any = [(_prefix(n), _prefix(n).isin(buckets)) for n, buckets in by_length.items()]
    near = hashed.select(HASH, F.coalesce(*[F.when(hit, prefix) for prefix, hit in inside_any]).alias("b"))
    ranked = near.where(F.col("b").isNotNull()).withColumn(
        "r", F.row_number().over(Window.partitionBy("b").orderBy(HASH))
    )
    # The row behind each place shows whether two rows share the border's hash.
    wanted = _any([(F.col("b") == b) & F.col("r").isin(r, r + 1) for b, r in sorted(set(spots))])
    found = {(r["b"], r["r"]): r[HASH] for r in ranked.where(wanted).collect()}
    for bucket, inside in spots:
        if found[bucket, inside] == found.get((bucket, inside + 1)):
            raise ValueError("the key is not unique")
    return [found[s] for s in spots]


def split_exact(
    df: DataFrame, keys: Sequence[str], fraction: float = 0.7, seed: int = 2, name: str = "is_train", edge_rows: int = EDGE_ROWS
) -> DataFrame:
    """Mark exactly the whole part of ``fraction * rows`` as training rows."""
    hashed = with_hash(df, keys, seed)
    counts = _counts(hashed)[""]
    take = math.floor(fraction * sum(n for _, n in counts))
    if take == 0:
        return df.withColumn(name, F.lit(False))
    border = hashes_at(hashed, [take], counts, edge_rows)[0]
    return hashed.withColumn(name, F.col(HASH) <= F.lit(border)).drop(HASH)


def fold_number(hashed: DataFrame, folds: int = 10, edge_rows: int = EDGE_ROWS) -> Column:
    """Fold 1..k of the rows of ``hashed`` by their hash; sizes differ by at most one, larger ones first."""
    counts = _counts(hashed)[""]
    size, more = divmod(sum(n for _, n in counts), folds)
    ends = [i * size + min(i, more) for i in range(1, folds)]
    borders = hashes_at(hashed, ends, counts, edge_rows) if size or more else []
    fold = F.lit(1)
    for border in borders:
        fold = fold + (F.col(HASH) > F.lit(border)).cast("int")
    return fold


def balanced_folds(
    df: DataFrame, keys: Sequence[str], folds: int = 10, seed: int = 2, name: str = "fold", edge_rows: int = EDGE_ROWS
) -> DataFrame:
    """Add the fold number of every row."""
    hashed = with_hash(df, keys, seed)
    return hashed.withColumn(name, fold_number(hashed, folds, edge_rows)).drop(HASH)


def split_and_folds(
    df: DataFrame, keys: Sequence[str], fraction: float = 0.7, folds: int = 10, seed: int = 2, name: str = "part"
) -> DataFrame:
    """0 for the test rows, 1..k for the balanced folds of the training rows."""
    split = with_hash(split_exact(df, keys, fraction, seed, "_train"), keys, seed + 1)
    fold = fold_number(split.where(F.col("_train")), folds)
    return split.withColumn(name, F.when(F.col("_train"), fold).otherwise(F.lit(0))).drop("_train", HASH)
