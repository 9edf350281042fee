"""The five model families for several horizons, fitted in parallel Spark tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.models import solvers
from gatecast.models.design import Design
from gatecast.models.gram import fold_grams, gram, square
from gatecast.models.qr import full_fits, r_factors
from gatecast.operators.aggregates import arg_min, cv_summary, fold_mean, one_se
from gatecast.session import materialize

# The families, in the order that decides ties.
FULL, FORWARD, BACKWARD, RIDGE, LASSO = (
    "Full Linear",
    "Forward Selection",
    "Backward Selection",
    "Ridge",
    "Lasso",
)
FAMILIES = (FULL, FORWARD, BACKWARD, RIDGE, LASSO)
STEPWISE = (FORWARD, BACKWARD)
PENALIZED = (RIDGE, LASSO)

PATHS = (
    "horizon string, model string, fold int, step int, lambda double, size int, "
    "n double, mse double, rss double, intercept double, betas array<double>"
)


def fit_paths(
    grams: DataFrame,
    design: Design,
    horizons: dict[str, Sequence[str]],
    models: Sequence[str] = FAMILIES,
    folds: int = 10,
    masked: bool = False,
) -> DataFrame:
    """All candidate fits: one row per (horizon, model, fold, step).

    A step is a subset size or a place on the penalty path; fold 0 is the fit on all
    training rows, scored on the test part. ``betas`` has one number per term of the
    whole design, zero for terms that are not used. One task fits one (horizon,
    model, fold); its input is the terms squared, whatever the size of the data. A horizon
    adds up the sums whose mask has its bit (``horizon_mask``), or all if there are no masks.
    """
    width = len(design.terms) + 2
    origin = np.array([design.origin[t.column] if t.level is None else 0.0 for t in design.terms])
    origin_y = design.origin[design.target]
    places = {h: design.positions(predictors) for h, predictors in horizons.items()}

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        horizon, model, fold = key
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        used = np.array(places[horizon], dtype=int)
        block = np.ix_(np.r_[0, used + 1, width - 1], np.r_[0, used + 1, width - 1])
        train, held, full = (square(i, j, rows[c].to_numpy(), width)[block] for c in ("train", "held", "full"))
        c = solvers.center(train)
        out = []
        for step, penalty, beta in _candidates(model, c, full):
            inner = c.intercept(beta)
            spread = np.zeros(width - 2)
            spread[used] = beta
            out.append(
                {
                    "horizon": horizon,
                    "model": model,
                    "fold": fold,
                    "step": step,
                    "lambda": penalty,
                    "size": int(np.count_nonzero(beta)),
                    "n": held[0, 0],
                    "mse": solvers.held_out_mse(held, inner, beta),
                    "rss": solvers.rss(c, beta),
                    "intercept": inner + origin_y - float(origin @ spread),
                    "betas": spread,
                }
            )
        return pd.DataFrame(out, columns=[f.split()[0] for f in PATHS.split(", ")])

    bits = [F.struct(F.lit(h).alias("horizon"), F.lit(1 << k if masked else 0).alias("bit")) for k, h in enumerate(horizons)]
    own = grams.withColumn("h", F.explode(F.array(*bits)))
    own = own.where(F.col("mask").bitwiseAND(F.col("h.bit")) == F.col("h.bit")).select("h.horizon", "part", "i", "j", "value")
    tasks = fold_grams(own, folds, ["horizon"]).withColumn("model", F.explode(F.array(*map(F.lit, models))))
    tasks = tasks.where((F.col("model") != FULL) | (F.col("fold") == 0))
    return tasks.groupBy("horizon", "model", "fold").applyInPandas(fit, PATHS)


def _candidates(model: str, c: solvers.Centered, full: np.ndarray):
    """(step, penalty, coefficients) of every candidate of a family."""
    if model == FULL:
        yield 1, None, solvers.solve_on(c, solvers.independent(c))
    elif model == FORWARD:
        order = solvers.forward_order(c)
        for size in range(1, len(order) + 1):
            # In design order, so that one set gives one result, whatever way led to it: ties between families stay ties.
            yield size, None, solvers.solve_on(c, sorted(order[:size]))
    elif model == BACKWARD:
        for size, chosen in enumerate(solvers.backward_sets(c), 1):
            yield size, None, solvers.solve_on(c, chosen)
    else:
        alpha = 0.0 if model == RIDGE else 1.0
        lambdas = solvers.lambda_path(solvers.center(full), alpha)
        for step, (penalty, beta) in enumerate(zip(lambdas, solvers.penalized(c, lambdas, alpha)), 1):
            yield step, float(penalty), beta


def subset_errors(paths: DataFrame, folds: int = 10) -> DataFrame:
    """Cross-validated error per (horizon, model, size); sizes missing in a fold are left out."""
    rows = paths.where(F.col("model").isin(*STEPWISE) & (F.col("fold") > 0))
    return fold_mean(rows, ["horizon", "model", "step"], "mse", folds)


def penalty_errors(paths: DataFrame) -> DataFrame:
    """Cross-validated error and its standard error per (horizon, model, penalty).

    Folds meet by their place on the path; the penalty itself is read off the fit on all
    training rows, as its last bits may differ between tasks.
    """
    keys = ["horizon", "model", "step"]
    rows = paths.where(F.col("model").isin(*PENALIZED))
    errors = cv_summary(rows.where(F.col("fold") > 0), keys)
    return rows.where(F.col("fold") == 0).select(*keys, "lambda").join(errors, keys)


def penalties(paths: DataFrame) -> DataFrame:
    """Best penalty and the largest one within a standard error, per (horizon, model)."""
    return one_se(penalty_errors(paths), ["horizon", "model"])


def chosen_steps(paths: DataFrame, folds: int = 10) -> DataFrame:
    """The step cross validation picks per (horizon, model); the full model has one only."""
    sizes = arg_min(subset_errors(paths, folds), ["horizon", "model"], "step", "cv_mse")
    lambdas = arg_min(penalty_errors(paths), ["horizon", "model"], "step", "cvm")
    full = paths.where(F.col("model") == FULL).select("horizon", "model", "step")
    pick = lambda df: df.select("horizon", "model", "step")
    return pick(full).unionByName(pick(sizes)).unionByName(pick(lambdas))


def final_fits(paths: DataFrame, folds: int = 10) -> DataFrame:
    """The chosen fit on all training rows per (horizon, model), with its test error."""
    return paths.where(F.col("fold") == 0).join(chosen_steps(paths, folds), ["horizon", "model", "step"])


def coefficients(fits: DataFrame, design: Design) -> DataFrame:
    """Rows (horizon, model, term, beta) of the terms in use, intercept first."""
    names = F.array(*[F.lit(t.name) for t in design.terms])
    pairs = F.arrays_zip(names.alias("term"), F.col("betas").alias("beta"))
    inner = fits.select("horizon", "model", F.explode(pairs).alias("p")).select("horizon", "model", "p.term", "p.beta")
    intercepts = fits.select("horizon", "model", F.lit("(Intercept)").alias("term"), F.col("intercept").alias("beta"))
    return intercepts.unionByName(inner.where(F.col("beta") != 0))


def fit_models(
    df: DataFrame,
    design: Design,
    part: str,
    horizons: dict[str, Sequence[str]],
    models: Sequence[str] = FAMILIES,
    folds: int = 10,
    mask: str | None = None,
    qr: bool = False,
) -> DataFrame:
    """Sums in one pass over ``df``, then all candidate fits, written once.

    With ``qr`` the full model is fitted by QR of the rows, in a pass of its own: for columns that are nearly equal.
    """
    others = [m for m in models if not (qr and m == FULL)]
    found = []
    if others:
        found.append(fit_paths(materialize(gram(df, design, part, mask), "gram"), design, horizons, others, folds, mask is not None))
    if len(others) < len(models):
        found.append(full_fits(materialize(r_factors(df, design, part, mask), "qr"), design, horizons, PATHS, FULL, mask is not None))
    return materialize(reduce(DataFrame.unionByName, found), "paths")
