"""Stepwise fits of designs with thousands of terms: sums of products in blocks, and sweeps over the blocks.

The matrix S of [1, terms, target] is kept as rows (part, block row, block column, values) of ``SIZE`` by ``SIZE`` numbers, upper
blocks only. A task adds up the blocks that its rows touch (a level of a category touches few), hands them on as their
non-zero numbers, and they are added by key in two levels. So no row and no task holds terms squared numbers.

Forward: the next column of a fold needs the diagonal and the target's column as they are with the chosen columns taken out, which
are two vectors, and the chosen column's own row of S, less what the earlier ones take out of it. A step fetches
the rows of the most promising columns of all folds in one job.

Backward: the matrix of each fold is swept block by block: a job per block of columns takes its independent
columns out of all blocks, by joins on block numbers, and leaves the inverse and the coefficients in place. Then columns go
one by one: a removal needs its row of the inverse, less what earlier removals changed. Rows come in batches, and
after ``REMOVED`` removals a job brings the blocks up to date. All folds go side by side.

The driver holds vectors of one number per term, for each fold: the diagonals, the rows fetched, at most ``REMOVED``
or ``max_size`` of them. Results have the columns of the packed fits, for steps up to ``max_size``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.models.design import Design
from gatecast.models.gram import TEST, design_rows
from gatecast.models.solvers import ALIAS
from gatecast.session import made_paths, materialize, remove_since

SIZE = 128  # columns of a block
HELD = 256  # blocks that a task adds up before it hands them on: 32 MB
SALTS = 16  # tasks of the first level for each block
FETCHED = 48  # rows fetched at a time per fold
REMOVED = 64  # removals of a fold before its blocks are brought up to date

Vectors = dict[tuple[int, int], np.ndarray]  # (part or fold, column): its row of the matrix


def blocked_gram(df: DataFrame, design: Design, part: str, size: int = SIZE) -> DataFrame:
    """Rows (part, bi, bj, values), bi <= bj, of the matrix [1, terms, target]' [1, terms, target]; a null is an error."""
    terms = design.terms
    width = len(terms) + 2
    inputs, _ = design_rows(df, design, part)
    numeric = [(0, None), *((p, f"n_{t.column}") for p, t in enumerate(terms, 1) if t.level is None), (width - 1, f"n_{design.target}")]
    dense_at = np.array([p for p, _ in numeric])
    first = {t.column: p for p, t in reversed(list(enumerate(terms, 1))) if t.level is not None}
    # The baseline is the first level, so code k stands at the place of the first term, plus k - 1.
    levels = {c: pd.Index(values) for c, values in design.levels.items() if c in first}
    blocks_across = -(-width // size)

    def triplets(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        dense = np.column_stack([np.ones(len(batch)) if c is None else batch[c].to_numpy(dtype=float) for _, c in numeric])
        if np.isnan(dense).any() or batch[[f"c_{c}" for c in design.levels]].isna().any(axis=None):
            raise ValueError("a null: drop incomplete rows before the split")
        i, j = np.triu_indices(len(dense_at))
        yield dense_at[i], dense_at[j], (dense.T @ dense)[i, j]
        places = {}
        for c, index in levels.items():
            codes = index.get_indexer(batch[f"c_{c}"])
            places[c] = np.where(codes > 0, first[c] + codes - 1, -1)
        for c, at in places.items():
            live = at >= 0
            own, own_at = np.unique(at[live], return_inverse=True)
            for k, p in enumerate(dense_at):
                yield own, np.full(len(own), p), np.bincount(own_at, weights=dense[live, k], minlength=len(own))
            yield own, own, np.bincount(own_at, minlength=len(own)).astype(float)
        named = list(places)
        for k, c in enumerate(named):
            for other in named[k + 1 :]:
                live = (places[c] >= 0) & (places[other] >= 0)
                codes, counts = np.unique(places[c][live] * width + places[other][live], return_counts=True)
                yield codes // width, codes % width, counts.astype(float)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for number, own in batch.groupby("part"):
                for i, j, values in triplets(own):
                    low, high = np.minimum(i, j), np.maximum(i, j)
                    key = (low // size) * blocks_across + high // size
                    for k in np.unique(key):
                        mine = key == k
                        place = (int(number), int(k) // blocks_across, int(k) % blocks_across)
                        block = held.setdefault(place, np.zeros(size * size))
                        np.add.at(block, (low[mine] % size) * size + high[mine] % size, values[mine])
                if len(held) > HELD:
                    yield sparse(held)
                    held = {}
        yield sparse(held)

    by_task = inputs.mapInPandas(pieces, SPARSE).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    by_salt = by_task.repartition("salt", *KEY).sortWithinPartitions("salt", *KEY).select(*KEY, "at", "v")
    whole = by_salt.mapInPandas(lambda batches: (sparse({key: block}) for key, block in summed(batches, size)), SPARSE)
    whole = whole.repartition(*KEY).sortWithinPartitions(*KEY)
    return whole.mapInPandas(lambda batches: (dense_row(key, block, size) for key, block in summed(batches, size)), BLOCKS)


KEY = ("part", "bi", "bj")
SPARSE = "part int, bi int, bj int, at binary, v binary"
BLOCKS = "part int, bi int, bj int, values binary"


def sparse(held: dict[tuple[int, int, int], np.ndarray]) -> pd.DataFrame:
    rows = []
    for key, block in held.items():
        at = np.flatnonzero(block)
        rows.append((*key, at.astype("<i4").tobytes(), block[at].tobytes()))
    return pd.DataFrame(rows, columns=[*KEY, "at", "v"])


def summed(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """One block per key of rows that come sorted by key."""
    key, total = None, np.zeros(size * size)
    for batch in batches:
        for row in batch.itertuples(index=False):
            found = (row.part, row.bi, row.bj)
            if found != key:
                if key is not None:
                    yield key, total
                key, total = found, np.zeros(size * size)
            total[np.frombuffer(row.at, "<i4")] += np.frombuffer(row.v)
    if key is not None:
        yield key, total


def dense_row(key: tuple[int, int, int], block: np.ndarray, size: int) -> pd.DataFrame:
    """A block as a row; those on the diagonal are filled up below it."""
    square = block.reshape(size, size)
    if key[1] == key[2]:
        square = np.triu(square) + np.triu(square, 1).T
    return pd.DataFrame([(*key, square.tobytes())], columns=[*KEY, "values"])


def opened(values: bytes, size: int) -> np.ndarray:
    return np.frombuffer(values).reshape(size, size)


def fetch(blocks: DataFrame, wanted: dict[int, set[int]] | set[int], width: int, size: int) -> Vectors:
    """Rows of the matrix: ``wanted`` columns of every part, or those named for each part."""
    every = not isinstance(wanted, dict)
    columns = sorted(wanted if every else set().union(*wanted.values()))
    if not columns:
        return {}
    strips = sorted({c // size for c in columns})

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                block = opened(row.values, size)
                for c in columns:
                    if not every and c not in wanted.get(row.part, ()):
                        continue
                    if c // size == row.bi:
                        rows.append((row.part, c, row.bj, block[c % size].tobytes()))
                    if c // size == row.bj and row.bi != row.bj:
                        rows.append((row.part, c, row.bi, block[:, c % size].tobytes()))
            yield pd.DataFrame(rows, columns=["part", "column", "strip", "values"])

    near = blocks.where(F.col("bi").isin(strips) | F.col("bj").isin(strips))
    found: Vectors = {}
    for row in near.mapInPandas(pick, "part int, column int, strip int, values binary").toPandas().itertuples(index=False):
        vector = found.setdefault((row.part, row.column), np.zeros(-(-width // size) * size))
        vector[row.strip * size : (row.strip + 1) * size] = np.frombuffer(row.values)
    return {key: vector[:width] for key, vector in found.items()}


def diagonals(blocks: DataFrame, width: int, size: int) -> dict[int, np.ndarray]:
    """The diagonal of the matrix of every part."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(row.part, row.bi, np.diag(opened(row.values, size)).tobytes()) for row in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["part", "strip", "values"])

    found: dict[int, np.ndarray] = {}
    for row in blocks.where("bi = bj").mapInPandas(pick, "part int, strip int, values binary").toPandas().itertuples(index=False):
        vector = found.setdefault(row.part, np.zeros(-(-width // size) * size))
        vector[row.strip * size : (row.strip + 1) * size] = np.frombuffer(row.values)
    return {part: vector[:width] for part, vector in found.items()}


class Parts:
    """Rows of the matrices of all parts, fetched when they are first asked for."""

    def __init__(self, blocks: DataFrame, width: int, size: int):
        self.blocks, self.width, self.size, self.rows, self.known = blocks, width, size, {}, set()
        self.numbers = sorted(row["part"] for row in blocks.select("part").distinct().collect())

    def load(self, columns: set[int]) -> None:
        missing = columns - self.known
        self.rows.update(fetch(self.blocks, missing, self.width, self.size))
        self.known |= missing

    def held(self, fold: int, column: int) -> np.ndarray:
        return self.rows.get((fold, column), np.zeros(self.width))

    def train(self, fold: int, column: int) -> np.ndarray:
        rows = [self.rows[p, column] for p in self.numbers if p not in (TEST, fold) and (p, column) in self.rows]
        return sum(rows, np.zeros(self.width))


def solution(parts: Parts, fold: int, chosen: Sequence[int], target: int) -> tuple[np.ndarray, float, float, float]:
    """(coefficients of [1, chosen], residual sum of squares, held-out error, held-out rows) from fetched rows."""
    at = [0, *chosen]
    matrix, right = np.array([parts.train(fold, c)[at] for c in at]), np.array([parts.train(fold, c)[target] for c in at])
    scale = np.sqrt(np.diag(matrix))
    beta = np.linalg.solve(matrix / np.outer(scale, scale), right / scale) / scale
    rss = parts.train(fold, target)[target] - beta @ right
    held = np.array([parts.held(fold, c)[at] for c in at])
    n, y = held[0, 0], np.array([parts.held(fold, c)[target] for c in at])
    error = parts.held(fold, target)[target] - 2 * beta @ y + beta @ held @ beta
    return beta, max(float(rss), 0.0), float(max(error, 0.0) / n) if n else float("nan"), float(n)


def forward_orders(parts: Parts, diagonal: dict[int, np.ndarray], folds: int, max_size: int) -> list[list[int]]:
    """For every fold the columns in the order in which they lower its error most."""
    target = parts.width - 1
    parts.load({0, target})
    states = []
    for fold in range(folds + 1):
        d = sum((v for p, v in diagonal.items() if p not in (TEST, fold)), np.zeros(parts.width))
        g, row = parts.train(fold, target), parts.train(fold, 0)
        if not row[0]:
            states.append(None)  # no training rows
            continue
        d, g = d - row**2 / row[0], g - row * (row[target] / row[0])
        states.append({"d": d, "g": g, "own": d.copy(), "taken": [(0, row, row[0])], "chosen": []})

    def best(state: dict, count: int) -> list[int]:
        able = (state["own"] > 0) & (state["d"] > ALIAS * state["own"])
        able[[0, target, *state["chosen"]]] = False
        worth = np.where(able, state["g"] ** 2 / np.where(able, state["d"], 1.0), -1.0)
        return [int(c) for c in np.argsort(-worth, kind="stable")[:count] if able[c]]

    for size in range(max_size):
        going = [(fold, s) for fold, s in enumerate(states) if s and len(s["chosen"]) == size and best(s, 1)]
        if not going:
            break
        if any(best(s, 1)[0] not in parts.known for _, s in going):
            parts.load({c for _, s in going for c in best(s, 3)})
        for fold, s in going:
            column = best(s, 1)[0]
            row = parts.train(fold, column)
            for earlier, taken, pivot in s["taken"]:
                row = row - taken * (taken[column] / pivot)
            pivot = s["d"][column]
            s["g"], s["d"] = s["g"] - row * (s["g"][column] / pivot), s["d"] - row**2 / pivot
            s["taken"].append((column, row, pivot))
            s["chosen"].append(column)
    return [s["chosen"] if s else [] for s in states]


def fold_blocks(blocks: DataFrame, folds: int, size: int) -> DataFrame:
    """The matrix of the training rows of every fold; ``part`` is the fold. One group holds the parts of one block."""

    def without(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = {row.part: opened(row.values, size) for row in rows.itertuples(index=False) if row.part != TEST}
        out = []
        for fold in range(folds + 1):
            own = [block for part, block in found.items() if part != fold]
            out.append((fold, *map(int, key), sum(own, np.zeros((size, size))).tobytes()))
        return pd.DataFrame(out, columns=[*KEY, "values"])

    return blocks.groupBy("bi", "bj").applyInPandas(without, BLOCKS)


def swept(blocks: DataFrame, own: dict[int, np.ndarray], width: int, size: int) -> tuple[DataFrame, dict[int, list[int]]]:
    """The matrices with all independent columns taken out: minus the inverse among these, their coefficients in the target's column.

    Also the independent columns of each fold, the constant first. One job per block of columns.
    """
    spark, mark = blocks.sparkSession, len(made_paths(blocks.sparkSession))
    now, kept = materialize(blocks, "sweep"), {fold: [] for fold in own}
    for b in range(-(-width // size)):
        inverses = {}
        for row in now.where((F.col("bi") == b) & (F.col("bj") == b)).select("part", F.col("values").alias("block")).collect():
            fold, block = row["part"], opened(bytes(row["block"]), size)
            rest, mine = block.copy(), []
            for k in range(size):
                column = b * size + k
                if column < width - 1 and own[fold][column] > 0 and rest[k, k] > ALIAS * own[fold][column]:
                    mine.append(k)
                    rest = rest - np.outer(rest[:, k], rest[k]) / rest[k, k]
            inverse = np.zeros((size, size))
            if mine:
                scale = np.sqrt(np.diag(block)[mine])
                inverse[np.ix_(mine, mine)] = np.linalg.inv(block[np.ix_(mine, mine)] / np.outer(scale, scale)) / np.outer(scale, scale)
            inverses[fold] = (mine, inverse)
            kept[fold] += [b * size + k for k in mine]

        def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for row in batch.itertuples(index=False):
                    block = opened(row.values, size)
                    rows.append((row.part, row.bj, block.tobytes()) if row.bi == b else (row.part, row.bi, np.ascontiguousarray(block.T).tobytes()))
                yield pd.DataFrame(rows, columns=["part", "strip", "piece"])

        def taken_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for row in batch.itertuples(index=False):
                    mine, inverse = inverses[row.part]
                    up, down = opened(row.up, size), opened(row.down, size)
                    left, right = up.T @ inverse, inverse @ down
                    block = opened(row.values, size) - left @ down
                    if row.bj == b:
                        block[:, mine] = left[:, mine]
                    if row.bi == b:
                        block[mine] = right[mine]
                    if row.bi == row.bj == b:
                        block[np.ix_(mine, mine)] = -inverse[np.ix_(mine, mine)]
                        rest = [k for k in range(size) if k not in set(mine)]
                        block[np.ix_(rest, mine)] = left[np.ix_(rest, mine)]
                        block[np.ix_(mine, rest)] = right[np.ix_(mine, rest)]
                    rows.append((row.part, row.bi, row.bj, block.tobytes()))
                yield pd.DataFrame(rows, columns=[*KEY, "values"])

        strips = now.where((F.col("bi") == b) | (F.col("bj") == b)).mapInPandas(turned, "part int, strip int, piece binary")
        strips = materialize(strips, "sweep-strip")
        up = strips.select("part", F.col("strip").alias("bi"), F.col("piece").alias("up"))
        down = strips.select("part", F.col("strip").alias("bj"), F.col("piece").alias("down"))
        now = materialize(now.join(up, ["part", "bi"]).join(down, ["part", "bj"]).select(*KEY, "values", "up", "down").mapInPandas(taken_out, BLOCKS), "sweep")
        remove_since(spark, mark, keep=1)
    return now, kept


def backward_sets(blocks: DataFrame, own: dict[int, np.ndarray], width: int, size: int, max_size: int) -> dict[int, list[list[int]]]:
    """For every fold its greedy sets of size 1, 2, … up to ``max_size``, each one column short of the next."""
    spark, mark = blocks.sparkSession, len(made_paths(blocks.sparkSession))
    now, kept = swept(blocks, own, width, size)
    target, diagonal = width - 1, diagonals(now, width, size)
    columns = fetch(now, {fold: {target} for fold in own}, width, size)
    states = {}
    for fold, mine in kept.items():
        if (fold, target) in columns and len(mine) > 1:
            live = np.zeros(width, bool)
            live[mine[1:]] = True  # the constant stays in
            states[fold] = {"b": columns[fold, target].copy(), "d": -diagonal[fold], "live": live, "out": [], "rows": {}, "sets": {}}
            states[fold]["b"][target] = 0.0

    def least(s: dict, count: int) -> list[int]:
        loss = np.where(s["live"], s["b"] ** 2 / np.where(s["live"], s["d"], 1.0), np.inf)
        return [int(c) for c in np.argsort(loss, kind="stable")[:count] if s["live"][c]]

    def keep(s: dict) -> None:
        count = int(s["live"].sum())
        if 0 < count <= max_size:
            s["sets"][count] = np.flatnonzero(s["live"]).tolist()

    while True:
        wanted: dict[int, set[int]] = {}
        for fold, s in states.items():
            keep(s)
            while s["live"].sum() > 1 and len(s["out"]) < REMOVED:
                column = least(s, 1)[0]
                if column not in s["rows"]:
                    wanted[fold] = set(least(s, FETCHED)) - set(s["rows"])
                    break
                row = -s["rows"][column]
                for earlier, removed, pivot in s["out"]:
                    row = row - removed * (removed[column] / pivot)
                pivot = row[column]
                s["b"], s["d"] = s["b"] - row * (s["b"][column] / pivot), s["d"] - row**2 / pivot
                s["live"][column] = False
                s["out"].append((column, row, pivot))
                keep(s)
        if any(len(s["out"]) >= REMOVED and s["live"].sum() > 1 for s in states.values()):
            changes = {fold: (np.array([r for _, r, _ in s["out"]]), np.array([p for _, _, p in s["out"]])) for fold, s in states.items() if s["out"]}
            now = materialize(brought_up(now, changes, width, size), "backward")
            remove_since(spark, mark, keep=1)
            for s in states.values():
                s["out"], s["rows"] = [], {}
        elif wanted:
            for (fold, column), row in fetch(now, wanted, width, size).items():
                states[fold]["rows"][column] = row
        else:
            return {fold: [s["sets"][k] for k in sorted(s["sets"])] for fold, s in states.items()}


def brought_up(blocks: DataFrame, changes: dict[int, tuple[np.ndarray, np.ndarray]], width: int, size: int) -> DataFrame:
    """The blocks after the removals of each fold."""
    padded = -(-width // size) * size - width

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = {fold: (np.pad(rows, ((0, 0), (0, padded))), pivots) for fold, (rows, pivots) in changes.items()}
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                block = opened(row.values, size)
                if row.part in wide:
                    removed, pivots = wide[row.part]
                    left, right = (removed[:, b * size : (b + 1) * size] for b in (row.bi, row.bj))
                    block = block + (left / pivots[:, None]).T @ right
                rows.append((row.part, row.bi, row.bj, block.tobytes()))
            yield pd.DataFrame(rows, columns=[*KEY, "values"])

    return blocks.mapInPandas(apply, BLOCKS)


def stepwise_paths(df: DataFrame, design: Design, part: str, horizon: str, paths: str, models: dict[str, bool], folds: int = 10, max_size: int = 50, size: int = SIZE) -> DataFrame:
    """Rows of ``paths`` up to ``max_size`` for each of ``models`` (its name, and whether it goes forward), for all terms of the design."""
    spark = df.sparkSession
    width = len(design.terms) + 2
    blocks = materialize(blocked_gram(df, design, part, size), "blocked-gram")
    parts, diagonal = Parts(blocks, width, size), diagonals(blocks, width, size)
    target = width - 1
    parts.load({0, target})
    origin = np.array([design.origin[t.column] if t.level is None else 0.0 for t in design.terms])
    rows = []
    for model, forward in models.items():
        if forward:
            sets = {fold: [order[:k] for k in range(1, len(order) + 1)] for fold, order in enumerate(forward_orders(parts, diagonal, folds, max_size))}
        else:
            own = {}
            for fold in range(folds + 1):
                const = parts.train(fold, 0)
                d = sum((v for p, v in diagonal.items() if p not in (TEST, fold)), np.zeros(width))
                own[fold] = d - const**2 / const[0] if const[0] else np.zeros(width)
                own[fold][0] = const[0]
            sets = backward_sets(fold_blocks(blocks, folds, size), own, width, size, max_size)
        parts.load({c for found in sets.values() for chosen in found for c in chosen})
        for fold, found in sets.items():
            for chosen in found:
                beta, rss, mse, n = solution(parts, fold, chosen, target)
                spread = np.zeros(width - 2)
                spread[np.array(chosen) - 1] = beta[1:]
                inner = float(beta[0]) + design.origin[design.target] - float(origin @ spread)
                rows.append((horizon, model, fold, len(chosen), None, len(chosen), n, mse, rss, inner, spread.tolist()))
    return spark.createDataFrame(rows, paths)
