"""Lasso paths of wide designs: coordinate descent over screened columns, with a duality gap for every fit.

The sums of products stay in blocks (``models.blocked``); a fold holds vectors of one number per term, and the rows of S of
the columns that its path has come to. At each penalty the strong rule names the columns whose pull at the penalty before
was at least 2 * penalty - penalty before; only these take part in the descent. Then the pulls of all columns are checked, and those
that the rule left out wrongly join, until none is left. All folds go side by side, so one job fetches the rows that any of them needs.

The gap between the primal objective and the dual one at the scaled residuals bounds how far a fit is from the best one, on columns and
target of standard deviation 1. It is a column of the result, with the largest breach of the optimality conditions.

A path ends before the penalty at which a fold would have more than ``max_size`` columns: the driver holds their rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from gatecast.models.blocked import SIZE, Parts, blocked_gram, diagonals
from gatecast.models.design import Design
from gatecast.models.gram import TEST
from gatecast.models.solvers import LAMBDAS
from gatecast.session import materialize

MAX_SIZE = 500
TOLERANCE = 1e-13  # of a coordinate's move, in standard deviations
CERTIFIED = ", gap double, breach double"


@dataclass
class Fold:
    """A fold's numbers per term, all on standardized columns, and its coefficients at the penalty it has come to."""

    n: float
    mean: np.ndarray
    sd: np.ndarray  # 0 for columns that do not vary
    pull: np.ndarray  # of every column on the residuals, over n
    target: np.ndarray  # the same on the target
    beta: np.ndarray
    rows: dict[int, np.ndarray] = field(default_factory=dict)  # correlations of the columns that were fetched


def opened_fold(parts: Parts, diagonal: np.ndarray, fold: int) -> Fold | None:
    const, y = parts.train(fold, 0), parts.train(fold, parts.width - 1)
    n = const[0]
    if not n:
        return None
    mean = const / n
    spread = diagonal / n - mean**2
    sd = np.sqrt(np.where(spread > 1e-12 * np.maximum(diagonal / n, 1e-300), spread, 0.0))
    if not sd[-1]:
        return None
    live = sd > 0
    target = np.where(live, (y / n - mean * mean[-1]) / np.where(live, sd, 1.0) / sd[-1], 0.0)
    target[0] = target[-1] = 0.0
    return Fold(n, mean, sd, target.copy(), target, np.zeros(parts.width))


def add_row(state: Fold, parts: Parts, fold: int, column: int) -> None:
    live = state.sd > 0
    row = (parts.train(fold, column) / state.n - state.mean[column] * state.mean) / state.sd[column]
    row = np.where(live, row / np.where(live, state.sd, 1.0), 0.0)
    row[0] = row[-1] = 0.0
    state.rows[column] = row


def descend(state: Fold, columns: Sequence[int], penalty: float) -> None:
    """Coordinate descent over some columns, to the last digits. Pulls of all columns follow from the rows of those that move."""
    columns = list(columns)
    block = np.array([state.rows[c][columns] for c in columns])
    pull, beta = state.pull[columns], state.beta[columns]
    began = beta.copy()
    active = list(range(len(columns)))
    while True:
        moved = 0.0
        for k in active:
            best = pull[k] + beta[k]
            best = np.sign(best) * max(abs(best) - penalty, 0.0)
            step = best - beta[k]
            if step:
                beta[k] = best
                pull -= step * block[k]
                moved = max(moved, abs(step))
        if moved > TOLERANCE:
            active = [k for k in range(len(columns)) if beta[k]] or list(range(len(columns)))  # settle these, then look at all again
        elif len(active) < len(columns):
            active = list(range(len(columns)))
        else:
            break
    for c, step in zip(columns, beta - began):
        if step:
            state.beta[c] += step
            state.pull = state.pull - step * state.rows[c]
    for k, c in enumerate(columns):
        state.beta[c] = beta[k]


def certificate(state: Fold, penalty: float) -> tuple[float, float]:
    """(duality gap, largest breach of the optimality conditions) of the coefficients."""
    used = np.flatnonzero(state.beta)
    beta = state.beta[used]
    fitted = float(beta @ state.target[used])
    squared = float(beta @ (state.target[used] - state.pull[used]))  # of the fitted values, over n
    rest = 1.0 - 2 * fitted + squared
    steepest = float(np.abs(state.pull).max())
    shrink = min(1.0, penalty / steepest) if steepest else 1.0
    primal = rest / 2 + penalty * float(np.abs(beta).sum())
    dual = shrink * (1.0 - fitted) - shrink**2 * rest / 2
    idle = np.setdiff1d(np.arange(len(state.beta)), used)
    breach = max(np.abs(state.pull[used] - penalty * np.sign(beta)).max(initial=0.0), np.maximum(np.abs(state.pull[idle]) - penalty, 0.0).max(initial=0.0))
    return max(primal - dual, 0.0), float(breach)


def lasso_paths(df: DataFrame, design: Design, part: str, horizon: str, paths: str, model: str, folds: int = 10, max_size: int = MAX_SIZE, size: int = SIZE) -> DataFrame:
    """Rows of ``paths`` with gap and breach for every (fold, penalty), for all terms of the design."""
    width = len(design.terms) + 2
    blocks = materialize(blocked_gram(df, design, part, size), "blocked-gram")
    parts, diagonal = Parts(blocks, width, size), diagonals(blocks, width, size)
    parts.load({0, width - 1})
    states = {}
    for fold in range(folds + 1):
        own = sum((v for p, v in diagonal.items() if p not in (TEST, fold)), np.zeros(width))
        if (state := opened_fold(parts, own, fold)) is not None:
            states[fold] = state
    origin = np.array([design.origin[t.column] if t.level is None else 0.0 for t in design.terms])
    rows: list[tuple] = []
    if 0 in states:
        full = states[0]
        live = int((full.sd[1:-1] > 0).sum())
        top = float(np.abs(full.target).max()) * full.sd[-1]
        before = top
        for step, penalty in enumerate(top * (1e-4 if full.n > live else 1e-2) ** (np.arange(LAMBDAS) / (LAMBDAS - 1)), 1):
            done = solved(states, parts, float(penalty), float(before), max_size)
            if not done:
                break
            before = float(penalty)
            rows += [scored(parts, states[fold], fold, horizon, model, step, before, design.origin[design.target], origin) for fold in states]
    return df.sparkSession.createDataFrame(rows, paths + CERTIFIED)


def solved(states: dict[int, Fold], parts: Parts, penalty: float, before: float, max_size: int) -> bool:
    """Bring all folds to a penalty; False if one would need more than ``max_size`` columns."""
    wanted = {}
    for fold, s in states.items():
        own, earlier = penalty / s.sd[-1], before / s.sd[-1]
        wanted[fold] = set(np.flatnonzero(s.beta).tolist()) | set(np.flatnonzero(np.abs(s.pull) >= max(2 * own - earlier, 1e-12)).tolist())
    while wanted:
        if any(len(columns) > max_size for columns in wanted.values()):
            return False
        parts.load(set().union(*wanted.values()))
        again = {}
        for fold, columns in wanted.items():
            s, own = states[fold], penalty / states[fold].sd[-1]
            for c in columns - set(s.rows):
                add_row(s, parts, fold, c)
            if columns:
                descend(s, sorted(columns), own)
            left_out = set(np.flatnonzero(np.abs(s.pull) > own + 1e-10).tolist()) - columns
            if left_out:
                again[fold] = columns | left_out
        wanted = again
    return True


def scored(parts: Parts, s: Fold, fold: int, horizon: str, model: str, step: int, penalty: float, origin_y: float, origin: np.ndarray) -> tuple:
    """A fit as a row: coefficients on the columns' own scale, held-out error, gap and breach."""
    used = np.flatnonzero(s.beta)
    beta = s.beta[used] * s.sd[-1] / s.sd[used]
    inner = float(s.mean[-1] - s.mean[used] @ beta)
    at, b = [0, *used.tolist()], np.append(inner, beta)
    held = np.array([parts.held(fold, c)[at] for c in at])
    n, y = held[0, 0], np.array([parts.held(fold, c)[-1] for c in at])
    error = max(float(parts.held(fold, parts.width - 1)[-1] - 2 * b @ y + b @ held @ b), 0.0)
    squared = float(s.beta[used] @ (s.target[used] - s.pull[used]))
    rss = max(1.0 - 2 * float(s.beta[used] @ s.target[used]) + squared, 0.0) * s.n * s.sd[-1] ** 2
    spread = np.zeros(parts.width - 2)
    spread[used - 1] = beta
    gap, breach = certificate(s, penalty / s.sd[-1])
    mse = float(error / n) if n else float("nan")
    return horizon, model, fold, step, penalty, len(used), float(n), mse, float(rss), inner + origin_y - float(origin @ spread), spread.tolist(), float(gap), breach
