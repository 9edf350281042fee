"""Window features and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatecast.operators import aggregates as agg
from gatecast.operators import windows as win
from gatecast.operators.sampling import balanced_folds
from gatecast.registry.base import GAMES_SQL, ORDER, games, query, r6, table

TEAM = {"team": "o_custkey", "order": ORDER}
W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
WS = "PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey"


@query("w1_lag_value", f"WITH {GAMES_SQL} SELECT o_orderkey, lag(value) OVER ({W}) AS last_value FROM games")
def w1(spark, sf):
    return win.lag_value(games(spark, sf), "value", "last_value", **TEAM).select("o_orderkey", "last_value")


@query("w2_lag_label", f"WITH {GAMES_SQL} SELECT o_orderkey, lag(result) OVER ({W}) AS last_result FROM games")
def w2(spark, sf):
    return win.lag_value(games(spark, sf), "result", "last_result", **TEAM).select("o_orderkey", "last_result")


def _complete(expr: str, rows: str) -> str:
    frame = f"({W} ROWS BETWEEN {rows})"
    return f"CASE WHEN count({expr}) OVER {frame} = 3 THEN round(sum({expr}) OVER {frame}, 4) END"


@query(
    "w3_rolling_sum_complete",
    f"""WITH {GAMES_SQL} SELECT o_orderkey, {_complete('value', '2 PRECEDING AND CURRENT ROW')} AS value_last3,
        {_complete('pts', '2 PRECEDING AND CURRENT ROW')} AS points_last3 FROM games""",
)
def w3(spark, sf):
    out = win.add_history(
        games(spark, sf), {"value_last3": win.RollingSum("value"), "points_last3": win.RollingSum("pts")}, **TEAM
    )
    return out.select("o_orderkey", r6("value_last3", 4).alias("value_last3"), r6("points_last3", 4).alias("points_last3"))


@query(
    "w4_rolling_sum_lagged",
    f"""WITH {GAMES_SQL} SELECT o_orderkey, {_complete('value', '3 PRECEDING AND 1 PRECEDING')} AS value_last3_lagged
        FROM games""",
)
def w4(spark, sf):
    out = win.rolling_sum(games(spark, sf), "value", "value_last3_lagged", shift=1, **TEAM)
    return out.select("o_orderkey", r6("value_last3_lagged", 4).alias("value_last3_lagged"))


RUNNING = f"""run AS (SELECT *, CASE WHEN count(pts) OVER w = count(*) OVER w THEN sum(pts) OVER w END AS season_points
  FROM games WINDOW w AS ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("w5_running_sum_by_season", f"WITH {GAMES_SQL}, {RUNNING} SELECT o_orderkey, season, season_points FROM run")
def w5(spark, sf):
    out = win.running_sum(games(spark, sf), "pts", "season_points", season="season", **TEAM)
    return out.select("o_orderkey", "season", "season_points")


@query(
    "w6_running_sum_lagged",
    f"""WITH {GAMES_SQL}, {RUNNING} SELECT o_orderkey, lag(season_points) OVER ({W}) AS season_points_lagged FROM run""",
)
def w6(spark, sf):
    out = win.running_sum_lagged(games(spark, sf), "pts", "season_points_lagged", season="season", **TEAM)
    return out.select("o_orderkey", "season_points_lagged")


@query(
    "w6_running_sum_lagged_reset",
    f"""WITH {GAMES_SQL}, {RUNNING} SELECT o_orderkey, lag(season_points) OVER ({WS}) AS season_points_lagged FROM run""",
)
def w6_reset(spark, sf):
    out = win.running_sum_lagged(
        games(spark, sf), "pts", "season_points_lagged", season="season", reset=True, **TEAM
    )
    return out.select("o_orderkey", "season_points_lagged")


@query(
    "w7_last_meeting_value",
    f"""WITH {GAMES_SQL} SELECT o_orderkey, lag(value) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority
        ORDER BY o_orderdate, o_orderkey) AS last_meeting_value FROM games""",
)
def w7(spark, sf):
    fixtures = games(spark, sf).withColumn("fixture", F.concat_ws("-", "o_orderstatus", "o_orderpriority"))
    out = win.last_meeting(fixtures, "value", "last_meeting_value", against="fixture", **TEAM)
    return out.select("o_orderkey", "last_meeting_value")


@query(
    "w8_last_meeting_label",
    f"""WITH {GAMES_SQL} SELECT o_orderkey, lag(result) OVER (PARTITION BY o_custkey, o_orderpriority
        ORDER BY o_orderdate, o_orderkey) AS last_meeting_result FROM games""",
)
def w8(spark, sf):
    out = win.last_meeting(games(spark, sf), "result", "last_meeting_result", against="o_orderpriority", **TEAM)
    return out.select("o_orderkey", "last_meeting_result")


BAND = "CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice > 400000 THEN 'large' END"


@query(
    "a1_group_mean_broadcast",
    f"""WITH {GAMES_SQL}, banded AS (SELECT *, {BAND} AS band FROM games)
        SELECT o_orderkey, band, CASE WHEN count(value) OVER w = count(*) OVER w THEN round(avg(value) OVER w, 4) END
        AS band_mean, round(avg(value) OVER w, 4) AS band_mean_skip FROM banded WINDOW w AS (PARTITION BY band)""",
)
def a1(spark, sf):
    band = F.when(F.col("o_totalprice") < 100000, "small").when(F.col("o_totalprice") > 400000, "large")
    banded = games(spark, sf).withColumn("band", band)
    out = agg.group_mean_broadcast(banded, ["band"], "value", "band_mean")
    out = agg.group_mean_broadcast(out, ["band"], "value", "band_mean_skip", na="skip")
    return out.select("o_orderkey", "band", r6("band_mean", 4).alias("band_mean"), r6("band_mean_skip", 4).alias("band_mean_skip"))


NAIVE = f"""naive AS (SELECT o_orderpriority, value, lag(value) OVER ({W}) AS guess FROM games),
  pairs AS (SELECT * FROM naive WHERE value IS NOT NULL AND guess IS NOT NULL)"""


def _naive(spark, sf):
    """Each match guessed by the team's previous one."""
    out = win.lag_value(games(spark, sf), "value", "guess", **TEAM)
    return out.dropna(subset=["value", "guess"])


@query(
    "a2_mse",
    f"""WITH {GAMES_SQL}, {NAIVE} SELECT o_orderpriority, round(avg((value - guess) * (value - guess)), 2) AS mse
        FROM pairs GROUP BY o_orderpriority""",
)
def a2(spark, sf):
    mse = agg.mse(F.col("value"), F.col("guess"))
    return _naive(spark, sf).groupBy("o_orderpriority").agg(r6(mse, 2).alias("mse"))


@query(
    "a3_rmse",
    f"""WITH {GAMES_SQL}, {NAIVE} SELECT o_orderpriority, round(sqrt(avg((value - guess) * (value - guess))), 4) AS rmse
        FROM pairs GROUP BY o_orderpriority""",
)
def a3(spark, sf):
    rmse = agg.rmse(F.col("value"), F.col("guess"))
    return _naive(spark, sf).groupBy("o_orderpriority").agg(r6(rmse, 4).alias("rmse"))


FOLDS_SQL = """ranked AS (SELECT *, (ntile(10) OVER (ORDER BY md5(o_orderkey::VARCHAR || '|2')))::INTEGER AS fold FROM orders)"""


@query(
    "a4_fold_mean",
    f"""WITH {FOLDS_SQL}, per_fold AS (SELECT fold, o_custkey, avg(o_totalprice) AS m FROM ranked GROUP BY ALL)
        SELECT o_custkey, round(avg(m), 6) AS fold_avg FROM per_fold GROUP BY o_custkey HAVING count(m) = 10""",
)
def a4(spark, sf):
    folds = balanced_folds(table(spark, sf, "orders"), ["o_orderkey"])
    per_fold = folds.groupBy("fold", "o_custkey").agg(F.avg("o_totalprice").alias("m"))
    out = agg.fold_mean(per_fold, ["o_custkey"], "m", 10, "fold_avg")
    return out.select("o_custkey", r6("fold_avg").alias("fold_avg"))


@query(
    "a5_arg_min",
    """WITH m AS (SELECT o_custkey, o_orderpriority, min(o_totalprice) AS lowest FROM orders GROUP BY ALL)
       SELECT o_custkey, arg_min(o_orderpriority, lowest) AS o_orderpriority, min(lowest) AS lowest FROM m GROUP BY o_custkey""",
)
def a5(spark, sf):
    m = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_totalprice").alias("lowest"))
    return agg.arg_min(m, ["o_custkey"], "o_orderpriority", "lowest")


@query("a6_column_min", "SELECT o_orderpriority, min(o_totalprice) AS lowest FROM orders GROUP BY o_orderpriority")
def a6(spark, sf):
    return agg.column_min(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", "lowest")


@query("a7_row_count_fraction", "SELECT floor(count(*) * 0.7::DOUBLE)::BIGINT AS size FROM orders")
def a7(spark, sf):
    return agg.row_count_fraction(table(spark, sf, "orders"), 0.7)


@query("a8_level_counts", "SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS n FROM part")
def a8(spark, sf):
    return agg.level_counts(table(spark, sf, "part"), "p_brand").select("p_partkey", "p_brand", "n")


@query(
    "a9_min_mean_cv",
    f"""WITH {FOLDS_SQL}, per_fold AS (SELECT o_orderpriority AS grp, o_orderstatus, fold, count(*)::DOUBLE AS n,
          avg(o_totalprice) AS mse FROM ranked GROUP BY ALL),
        means AS (SELECT grp, o_orderstatus, sum(n * mse) / sum(n) AS cvm FROM per_fold GROUP BY ALL),
        cv AS (SELECT p.grp, p.o_orderstatus, any_value(m.cvm) AS cvm,
            sqrt(sum(n * pow(mse - m.cvm, 2)) / sum(n) / (count(*) - 1)) AS cvsd
          FROM per_fold p JOIN means m ON p.grp = m.grp AND p.o_orderstatus = m.o_orderstatus GROUP BY p.grp, p.o_orderstatus)
        SELECT grp, o_orderstatus, round(cvm, 4) AS cvm, round(cvsd, 4) AS cvsd FROM cv""",
)
def a9(spark, sf):
    folds = balanced_folds(table(spark, sf, "orders"), ["o_orderkey"])
    per_fold = folds.groupBy(F.col("o_orderpriority").alias("grp"), "o_orderstatus", "fold").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("o_totalprice").alias("mse")
    )
    cv = agg.cv_summary(per_fold, ["grp", "o_orderstatus"])
    return cv.select("grp", "o_orderstatus", r6("cvm", 4).alias("cvm"), r6("cvsd", 4).alias("cvsd"))


HISTORY_SQL = f"""WITH {GAMES_SQL}, {RUNNING},
  c AS (SELECT c_custkey, c_mktsegment FROM customer)
  SELECT run.o_orderkey, run.o_custkey, run.season, lag(value) OVER t AS last_value, lag(result) OVER t AS last_result,
    {_complete('value', '3 PRECEDING AND 1 PRECEDING')} AS value_last3_lagged,
    lag(season_points) OVER t AS season_points_lagged,
    lag(value) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS last_meeting_value,
    c.c_mktsegment
  FROM run LEFT JOIN c ON run.o_custkey = c.c_custkey WINDOW t AS ({W})"""


@query("flagship_team_history", HISTORY_SQL)
def flagship(spark, sf):
    """All look-backs of a team in one exchange, enriched by a left join."""
    from gatecast.operators.joins import left_join

    features = (
        {
            "last_value": win.Lag("value"),
            "last_result": win.Lag("result"),
            "value_last3_lagged": win.RollingSum("value", shift=1),
            "season_points": win.RunningSum("pts", ("season",)),
            "last_meeting_value": win.Lag("value", within=("o_orderpriority",)),
        },
        {"season_points_lagged": win.Lag("season_points")},
    )
    out = win.add_history(games(spark, sf), *features, **TEAM)
    out = left_join(out, table(spark, sf, "customer"), {"o_custkey": "c_custkey"}, ["c_mktsegment"])
    return out.select(
        "o_orderkey", "o_custkey", "season", "last_value", "last_result",
        r6("value_last3_lagged", 4).alias("value_last3_lagged"), "season_points_lagged", "last_meeting_value", "c_mktsegment",
    )
