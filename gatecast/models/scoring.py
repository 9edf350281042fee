"""Predictions, leaderboard, scenarios and the rows behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gatecast.functions.cases import recode
from gatecast.functions.text import format_label
from gatecast.models.design import Design, prediction
from gatecast.models.fits import FAMILIES
from gatecast.operators.aggregates import mse
from gatecast.operators.categorical import align_levels
from gatecast.operators.filters import any_pair
from gatecast.operators.reshape import order_by_level, pivot_longer, score_matrix, top1_per_group

# Horizons in order, their chart labels and days before the match.
HORIZONS = ("måned1", "dag10", "dag7", "dag3")
HORIZON_LABELS = {"måned1": "1 Måned", "dag10": "10 Dage", "dag7": "7 Dage", "dag3": "3 Dage"}
SCENARIO_LABELS = {"måned1": "1 Måned før", "dag10": "10 Måned før", "dag7": "7 Måned før", "dag3": "3 Måned før"}
DAYS_BEFORE = {"måned1": 30, "dag10": 10, "dag7": 7, "dag3": 3}


def predict(df: DataFrame, design: Design, fits: Sequence[Row], horizons: dict[str, Sequence[str]]) -> DataFrame:
    """One column ``<horizon>|<model>`` per fit; a projection without a shuffle.

    ``fits`` are the collected rows of ``final_fits``: at most horizons times models.
    """
    return df.withColumns(
        {
            f"{f['horizon']}|{f['model']}": prediction(design, f["intercept"], f["betas"], horizons[f["horizon"]])
            for f in fits
        }
    )


def predict_long(df: DataFrame, design: Design, fits: Sequence[Row], horizons, keep: Sequence[str]) -> DataFrame:
    """Rows (keep…, horizon, model, predicted)."""
    names = [f"{f['horizon']}|{f['model']}" for f in fits]
    wide = predict(df, design, fits, horizons).select(*keep, *names)
    both = F.split("_name", r"\|")
    return pivot_longer(wide, keep, names, "_name", "predicted").select(
        *keep, both[0].alias("horizon"), both[1].alias("model"), "predicted"
    )


def test_errors(predictions: DataFrame, target: str) -> DataFrame:
    """Mean squared test error per (horizon, model) from predicted rows."""
    return predictions.groupBy("horizon", "model").agg(mse(F.col(target), F.col("predicted")).alias("mse"))


def leaderboard(errors: DataFrame, horizons: Sequence[str] = HORIZONS, root: bool = False) -> DataFrame:
    """Model by horizon matrix of MSE, or RMSE with ``root``."""
    return score_matrix(errors, horizons, "mse", root)


def best_models(errors: DataFrame) -> DataFrame:
    """Model with the smallest test error per horizon, with MSE and RMSE."""
    best = top1_per_group(errors, ["horizon"], "model", "mse", FAMILIES)
    return best.select("horizon", F.col("model").alias("best_model"), "mse", F.sqrt("mse").alias("rmse"))


def score_scenarios(
    scenarios: DataFrame, design: Design, fits: Sequence[Row], horizons, label: str = "scenario"
) -> DataFrame:
    """Score what-if rows with one fit per horizon, after forcing their text onto known levels."""
    aligned = align_levels(scenarios, design.levels)
    return predict_long(aligned, design, fits, horizons, [label])


def scenario_table(scored: DataFrame) -> DataFrame:
    """Scenario rows with their timeframe label, days before the match and the text shown on the bar."""
    table = scored.withColumns(
        {
            "timeframe": recode(F.col("horizon"), SCENARIO_LABELS),
            "days_before": recode(F.col("horizon"), DAYS_BEFORE),
        }
    ).withColumn(
        "label_text",
        format_label(F.col("predicted"), " tilskuere\n(", F.col("days_before"), " dage før)"),
    )
    return order_by_level(table, "horizon", HORIZONS)


def rmse_rows(errors: DataFrame) -> DataFrame:
    """Long (model, horizon, rmse, label) rows of the comparison chart, best last within a horizon."""
    rows = errors.select("model", "horizon", F.sqrt("mse").alias("rmse"))
    return rows.withColumn("label", format_label(F.col("rmse")))


def best_rows(errors: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The chart rows of some (model, horizon) pairs under their display labels."""
    picked = rmse_rows(errors).where(any_pair(pairs, F.col("model"), F.col("horizon")))
    named = picked.withColumn("horizon", recode(F.col("horizon"), HORIZON_LABELS))
    return order_by_level(named, "horizon", list(HORIZON_LABELS.values()))
