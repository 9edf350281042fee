"""Model frame to leaderboard and scenario forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gatecast.models import scoring
from gatecast.models.design import MAX_TERMS, Design, complete_rows, fit_design, horizon_mask
from gatecast.models.fits import FAMILIES, coefficients, final_fits, fit_models, penalties
from gatecast.models.gram import TEST
from gatecast.operators.filters import any_pair
from gatecast.operators.sampling import split_and_folds
from gatecast.session import materialize


@dataclass
class Forecast:
    """A fitted set of models: design, all candidate fits, and the chosen ones."""

    design: Design
    horizons: dict[str, Sequence[str]]
    folds: int
    parts: DataFrame
    paths: DataFrame

    def fits(self) -> DataFrame:
        return final_fits(self.paths, self.folds)

    def errors(self) -> DataFrame:
        """Test error per (horizon, model), from the sums of the test part."""
        return self.fits().select("horizon", "model", "mse")

    def leaderboard(self, root: bool = False) -> DataFrame:
        return scoring.leaderboard(self.errors(), list(self.horizons), root)

    def best(self) -> DataFrame:
        return scoring.best_models(self.errors())

    def penalties(self) -> DataFrame:
        return penalties(self.paths)

    def coefficients(self) -> DataFrame:
        return coefficients(self.fits(), self.design)

    def best_fits(self) -> list[Row]:
        """The chosen fit of the best model per horizon: one row per horizon."""
        best = self.best().select("horizon", F.col("best_model").alias("model"))
        return self.fits().join(best, ["horizon", "model"], "left_semi").collect()

    def named_fits(self, models: dict[str, str]) -> list[Row]:
        """The chosen fit of a given model per horizon."""
        named = any_pair(list(models.items()), F.col("horizon"), F.col("model"))
        return self.fits().where(named).collect()

    def predictions(self, keep: Sequence[str]) -> DataFrame:
        """Fitted values of all chosen models on the test rows."""
        test = self.parts.where(F.col("_part") == TEST)
        return scoring.predict_long(test, self.design, self.fits().collect(), self.horizons, keep)

    def scenarios(self, rows: DataFrame, label: str = "scenario", models: dict[str, str] | None = None) -> DataFrame:
        """What-if rows scored by the best model per horizon, or by the given ones."""
        fits = self.named_fits(models) if models else self.best_fits()
        return scoring.score_scenarios(rows, self.design, fits, self.horizons, label)


def forecast(
    frame: DataFrame,
    target: str,
    horizons: dict[str, Sequence[str]],
    keys: Sequence[str],
    models: Sequence[str] = FAMILIES,
    fraction: float = 0.7,
    folds: int = 10,
    seed: int = 2,
    max_terms: int = MAX_TERMS,
    qr: bool = False,
) -> Forecast:
    """Split, fit all families for all horizons, and keep every candidate.

    Every row with a target takes part in the one split and serves the horizons whose own
    predictors it has; a null in one horizon's predictor keeps it in the others. Levels and
    means are taken from the whole frame, and the frame is written once; the sums behind all
    fits take one pass over it. More than ``max_terms`` levels are refused: the sums hold
    terms squared numbers. ``qr`` fits the full model by QR of the rows (see ``models.qr``).
    """
    predictors = list(dict.fromkeys(c for p in horizons.values() for c in p))
    rows = complete_rows(frame.select(*dict.fromkeys([*keys, *predictors, target])), [target])
    whole = materialize(rows.withColumn("_mask", horizon_mask(horizons)), "frame")
    design = fit_design(whole, target, predictors, max_terms)
    parts = split_and_folds(whole, keys, fraction, folds, seed, "_part")
    paths = fit_models(parts, design, "_part", horizons, models, folds, "_mask", qr)
    return Forecast(design, horizons, folds, parts, paths)
