"""Linear fits from sums of products. Small numpy helpers that run inside Spark tasks.

Input is the matrix S of [1, x1..xp, y]: S[0, 0] is the row count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALIAS = 1e-7
LAMBDAS = 100
RIDGE_ALPHA = 1e-3


@dataclass
class Centered:
    """Deviations from the means: n, means, cross products of x, of x with y, and of y."""

    n: float
    mean: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def intercept(self, beta: np.ndarray) -> float:
        return float(self.mean[-1] - self.mean[:-1] @ beta)


def center(s: np.ndarray) -> Centered:
    n = s[0, 0]
    mean = s[0, 1:] / n
    c = s[1:, 1:] - n * np.outer(mean, mean)
    return Centered(n, mean, c[:-1, :-1], c[:-1, -1], float(c[-1, -1]))


def held_out_mse(s: np.ndarray, intercept: float, beta: np.ndarray) -> float:
    """Mean squared error on the rows behind S; NaN when there are none."""
    n = s[0, 0]
    if n == 0:
        return float("nan")
    b = np.concatenate([[intercept], beta])
    return max(float((s[-1, -1] - 2 * b @ s[:-1, -1] + b @ s[:-1, :-1] @ b) / n), 0.0)


def independent(c: Centered) -> list[int]:
    """Columns that are no combination of earlier ones, in design order."""
    rest = c.xx.copy()
    kept = []
    for j in range(len(rest)):
        if rest[j, j] > ALIAS * c.xx[j, j] and c.xx[j, j] > 0:
            kept.append(j)
            rest = rest - np.outer(rest[:, j], rest[j]) / rest[j, j]
    return kept


def solve_on(c: Centered, columns: list[int]) -> np.ndarray:
    """Least squares on some columns; zero elsewhere. Scaled for a stable solve."""
    beta = np.zeros(len(c.xy))
    if columns:
        scale = np.sqrt(np.diag(c.xx)[columns])
        block = c.xx[np.ix_(columns, columns)] / np.outer(scale, scale)
        beta[columns] = np.linalg.solve(block, c.xy[columns] / scale) / scale
    return beta


def rss(c: Centered, beta: np.ndarray) -> float:
    return max(float(c.yy - 2 * beta @ c.xy + beta @ c.xx @ beta), 0.0)


def forward_order(c: Centered) -> list[int]:
    """Greedy path from the empty model: each step adds the column that lowers the error most."""
    xx, xy = c.xx.copy(), c.xy.copy()
    own = np.diag(c.xx)
    chosen: list[int] = []
    open_ = [j for j in range(len(xy)) if own[j] > 0]
    while True:
        open_ = [j for j in open_ if xx[j, j] > ALIAS * own[j]]
        if not open_:
            return chosen
        best = max(open_, key=lambda j: xy[j] ** 2 / xx[j, j])
        open_.remove(best)
        chosen.append(best)
        # What is left of the other columns once the chosen one is taken out.
        row, pivot, effect = xx[best].copy(), xx[best, best], xy[best]
        xy = xy - row * effect / pivot
        xx = xx - np.outer(row, row) / pivot


def backward_sets(c: Centered) -> list[list[int]]:
    """Greedy path from the full model: sets of size 1, 2, … each one column short of the next.

    The inverse is made once; taking a column out updates it in place (a sweep), so a step
    costs the columns squared.
    """
    current = independent(c)
    sets = [list(current)]
    if current:
        scale = np.sqrt(np.diag(c.xx)[current])
        inverse = np.linalg.inv(c.xx[np.ix_(current, current)] / np.outer(scale, scale))
        b = inverse @ (c.xy[current] / scale)
    while len(current) > 1:
        out = int(np.argmin(b**2 / np.diag(inverse)))
        column, pivot = np.delete(inverse[:, out], out), inverse[out, out]
        b = np.delete(b, out) - column * (b[out] / pivot)
        inverse = np.delete(np.delete(inverse, out, 0), out, 1) - np.outer(column, column) / pivot
        current.pop(out)
        sets.append(list(current))
    return [s for s in sets[::-1] if s]


def lambda_path(c: Centered, alpha: float, count: int = LAMBDAS) -> np.ndarray:
    """Log-spaced penalties from the one that empties the model downwards."""
    own = np.diag(c.xx)
    live = own > 0
    if not live.any() or c.yy <= 0:
        return np.zeros(0)
    top = np.max(np.abs(c.xy[live]) / np.sqrt(own[live] / c.n)) / c.n / max(alpha, RIDGE_ALPHA)
    ratio = 1e-4 if c.n > live.sum() else 1e-2
    return top * ratio ** (np.arange(count) / (count - 1))


def penalized(c: Centered, lambdas: np.ndarray, alpha: float) -> list[np.ndarray]:
    """Coefficients per penalty on standardized columns, given back on the original scale."""
    sd = np.sqrt(np.diag(c.xx) / c.n)
    live = np.flatnonzero(sd > 0)
    sd_y = np.sqrt(c.yy / c.n)
    r = c.xx[np.ix_(live, live)] / c.n / np.outer(sd[live], sd[live])
    g = c.xy[live] / c.n / sd[live] / sd_y
    fits = _ridge(r, g, lambdas / sd_y) if alpha == 0 else _lasso(r, g, lambdas / sd_y)
    out = []
    for b in fits:
        beta = np.zeros(len(c.xy))
        beta[live] = b * sd_y / sd[live]
        out.append(beta)
    return out


def _ridge(r: np.ndarray, g: np.ndarray, penalties: np.ndarray) -> list[np.ndarray]:
    values, vectors = np.linalg.eigh(r)
    turned = vectors.T @ g
    return [vectors @ (turned / (np.maximum(values, 0) + p)) for p in penalties]


def _lasso(r: np.ndarray, g: np.ndarray, penalties: np.ndarray, tol: float = 1e-9) -> list[np.ndarray]:
    """Exact fits by an active set with warm starts.

    For fixed signs the best values solve linear equations. A value that would cross
    zero on the way there leaves the set; a column whose pull exceeds the penalty joins.
    """
    b = np.zeros(len(g))
    active: list[int] = []
    fits = []
    for p in penalties:
        # Every round lowers the objective or adds a column, so it ends; the bound only turns a defect into an error.
        for _ in range(1000 * (len(g) + 1)):
            b, active = _settle(r, g, b, active, p)
            pull = g - r @ b
            pull[active] = 0.0
            worst = int(np.argmax(np.abs(pull))) if len(pull) else 0
            if not len(pull) or abs(pull[worst]) <= p + tol:
                break
            active.append(worst)
            b[worst] = np.sign(pull[worst]) * 1e-300
        else:
            raise ArithmeticError(f"the lasso did not settle at penalty {p}")
        fits.append(b.copy())
    return fits


def _solve(block: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve symmetric equations; those that are singular, or nearly so, by least squares."""
    try:
        if np.linalg.cholesky(block).diagonal().min() > 1e-5:
            return np.linalg.solve(block, right)
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(block, right, rcond=1e-12)[0]


def _settle(r: np.ndarray, g: np.ndarray, b: np.ndarray, active: list[int], p: float):
    """Move to the best values of the active columns, dropping those that reach zero."""
    b = b.copy()
    while active:
        signs = np.sign(b[active])
        goal = _solve(r[np.ix_(active, active)], g[active] - p * signs)
        step = goal - b[active]
        crossing = np.sign(goal) * signs < 0
        if not crossing.any():
            b[active] = goal
            break
        share = np.full(len(active), np.inf)
        share[crossing] = -b[active][crossing] / step[crossing]
        first = int(np.argmin(share))
        b[active] = b[active] + step * share[first]
        b[active[first]] = 0.0
        active = active[:first] + active[first + 1 :]
    return b, active
