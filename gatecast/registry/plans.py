"""The plans from matches to the model frame, over orders read as a league of 25 teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatecast.functions.labels import DRAWN, FIRST_MEETING, LOST, NOT_PLAYED, RARE_OPPONENTS, WON
from gatecast.operators.incremental import update_history
from gatecast.operators.windows import Lag, RollingSum, RunningSum
from gatecast.plans import model_frame as mf
from gatecast.registry.base import GAMES_SQL, ORDER, games, query, r6, table
from gatecast.session import materialize, new_path

LEAGUE_ORDER = ["sæson_år", "o_orderkey"]
TEAM = "T03"


def league(spark, sf):
    """Orders as matches in the shape of the schedule: teams, score and gate from the keys, status P as not played yet."""
    key, home = F.col("o_orderkey"), F.col("o_custkey") % 25
    name = lambda number: F.concat(F.lit("T"), F.lpad(number.cast("string"), 2, "0"))
    score = F.concat_ws("-", (key % 11).cast("string"), (F.floor(key / 11) % 4).cast("string"))
    played = F.col("o_orderstatus") != "P"
    season = F.year("o_orderdate") + F.when(F.month("o_orderdate") >= 7, 1).otherwise(0)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.element_at(F.array(*map(F.lit, ["Man", "Fre", "Lør", "Søn"])), (key % 4 + 1).cast("int")).alias("ugedag"),
        F.concat(F.date_format("o_orderdate", "dd/MM"), F.lit(" "), F.lpad((key % 16 + 8).cast("string"), 2, "0"), F.lit(":30")).alias("dato_tid"),
        F.concat_ws("-", name(home), name((home + 1 + key % 24) % 25)).alias("kamp"),
        F.when(played, score).otherwise(NOT_PLAYED).alias("resultat"),
        F.when(played, F.floor("o_totalprice") / 40).alias("tilskuere"),
        season.cast("string").alias("sæson_år"),
        (key % 33 + 1).cast("double").alias("runde_nr"),
    )


LEAGUE_SQL = f"""league AS (SELECT o_orderkey, ['Man', 'Fre', 'Lør', 'Søn'][o_orderkey % 4 + 1] AS ugedag,
    o_orderdate + INTERVAL 30 MINUTE + to_hours(o_orderkey % 16 + 8) AS datotid,
    'T' || lpad((o_custkey % 25)::VARCHAR, 2, '0') AS hjemme, 'T' || lpad(((o_custkey % 25 + 1 + o_orderkey % 24) % 25)::VARCHAR, 2, '0') AS ude,
    CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 11)::DOUBLE END AS hg, CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey // 11 % 4)::DOUBLE END AS ag,
    CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice) / 40 END AS tilskuere,
    (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END)::VARCHAR AS season, (o_orderkey % 33 + 1)::DOUBLE AS runde_nr FROM orders),
  sides AS (SELECT *, hjemme || '-' || ude AS kamp, CASE WHEN home THEN hjemme ELSE ude END AS hold, CASE WHEN home THEN ude ELSE hjemme END AS modstander,
    CASE WHEN home THEN hg ELSE ag END AS goals, CASE WHEN hg = ag THEN '{DRAWN}' WHEN (hg > ag) = home THEN '{WON}' WHEN hg IS NOT NULL THEN '{LOST}' END AS result
    FROM league, (VALUES (true), (false)) s(home)),
  scored AS (SELECT *, CASE result WHEN '{WON}' THEN 3.0::DOUBLE WHEN '{DRAWN}' THEN 1.0::DOUBLE WHEN '{LOST}' THEN 0.0::DOUBLE END AS pts FROM sides),
  features AS (SELECT *, lag(goals) OVER t AS last_goals, CASE WHEN count(goals) OVER b = 3 THEN sum(goals) OVER b END AS goals3,
    lag(result) OVER t AS last_result, CASE WHEN count(pts) OVER b = 3 THEN sum(pts) OVER b END AS points3,
    CASE WHEN count(pts) OVER s = count(*) OVER s THEN sum(pts) OVER s END AS so_far,
    lag(tilskuere) OVER (PARTITION BY hold, kamp ORDER BY season, o_orderkey) AS met_gate,
    lag(result) OVER (PARTITION BY hold, modstander ORDER BY season, o_orderkey) AS met_result FROM scored
    WINDOW t AS (PARTITION BY hold ORDER BY season, o_orderkey), b AS (PARTITION BY hold ORDER BY season, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
      s AS (PARTITION BY hold, season ORDER BY season, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  history AS (SELECT *, lag(so_far) OVER (PARTITION BY hold ORDER BY season, o_orderkey) AS so_far_before FROM features)"""


@query(
    "plan_team_history",
    f"""WITH {LEAGUE_SQL} SELECT o_orderkey, home, hold, modstander, goals, result, pts, last_goals, goals3, last_result, points3, so_far, so_far_before,
        round(met_gate, 3) AS met_gate, met_result FROM history""",
)
def plan_team_history(spark, sf):
    """Both sides of every match with score, points and look-backs."""
    done = mf.team_history(league(spark, sf), LEAGUE_ORDER)
    names = {
        "er_hjemme": "home", "hold": "hold", "modstander": "modstander", "mål": "goals", "holdets_resultat": "result", "point_kamp": "pts",
        "mål_sidste_kamp": "last_goals", "mål_sidste3_lagged": "goals3", "resultat_lagged": "last_result", "point_sidste3_lagged": "points3",
        "point_sæson": "so_far", "point_sæson_lagged": "so_far_before", "sidste_møde_resultat": "met_result",
    }
    return done.select("o_orderkey", *[F.col(c).alias(name) for c, name in names.items()], r6("sidste_møde_tilskuere", 3).alias("met_gate"))


def side_inputs(spark, sf):
    """Observations for the hours that matches start in, holidays, and advance sales per year and round."""
    matches = materialize(mf.add_times(league(spark, sf)), "league")
    hours = matches.select(F.to_timestamp("time_key").alias("hour"), "time_key").distinct()
    values = {
        "temp_dry": F.dayofyear("hour") / 10 + F.hour("hour"),
        "wind_speed": F.hour("hour") / 2 + F.month("hour"),
        "precip_past1h": F.when(F.dayofmonth("hour") % 5 > 0, F.dayofmonth("hour") / 10),
        "humidity": F.lit(50.0),
    }
    pairs = F.array(*[F.struct(F.lit(p).alias("parameterId"), v.cast("double").alias("value")) for p, v in values.items()])
    observations = hours.select(F.col("time_key").alias("observed"), F.inline(pairs)).where("value IS NOT NULL")
    days = matches.select(F.col("day_key").alias("dato")).distinct()
    holidays = days.where(F.col("dato").endswith("-01")).withColumn("helligdag", F.concat(F.lit("dag "), F.substring("dato", 6, 2)))
    amounts = [F.count("*").cast("double").alias("d10_tilskuere"), F.sum("o_orderkey").cast("double").alias("d7_tilskuere"), F.max("o_orderkey").cast("double").alias("d3_tilskuere")]
    sales = matches.where("o_orderkey % 33 < 30").groupBy(F.col("real_år").alias("år"), F.col("runde_nr").alias("runde")).agg(*amounts)
    return observations, holidays, sales


@query(
    "plan_model_frame",
    f"""WITH {LEAGUE_SQL},
      timed AS (SELECT *, date_trunc('hour', timezone('UTC', timezone('Europe/Copenhagen', datotid))) AS utc FROM history
        WHERE hold = '{TEAM}' AND home AND hg IS NOT NULL AND season::INTEGER >= 1994),
      sales AS (SELECT year(datotid) AS y, runde_nr AS rnd, count(*)::DOUBLE AS d10, sum(o_orderkey)::DOUBLE AS d7, max(o_orderkey)::DOUBLE AS d3 FROM league
        WHERE o_orderkey % 33 < 30 GROUP BY ALL),
      banded AS (SELECT *, CASE WHEN met_gate IS NULL AND tilskuere < 4000 THEN 1 WHEN met_gate IS NULL AND tilskuere > 4000 THEN 2 END AS band FROM timed),
      filled AS (SELECT *, CASE WHEN band IS NOT NULL THEN avg(tilskuere) OVER (PARTITION BY band) ELSE met_gate END AS gate FROM banded),
      dry AS (SELECT * FROM filled WHERE day(utc) % 5 > 0),
      named AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY modstander) < 2 THEN '{RARE_OPPONENTS}' ELSE modstander END AS other FROM dry)
      SELECT kamp, datotid, ugedag, last_result AS resultat_lagged, season AS "sæson_år",
        CASE WHEN hour(datotid) BETWEEN 10 AND 14 THEN 'middag' WHEN hour(datotid) BETWEEN 15 AND 17 THEN 'eftermiddag'
          WHEN hour(datotid) BETWEEN 18 AND 23 THEN 'aften' END AS tidspunkt, other AS modstander,
        coalesce(met_result, '{FIRST_MEETING}') AS "sidste_møde_resultat",
        CASE WHEN month(datotid) = 7 OR (month(datotid) = 6 AND day(datotid) >= 26) OR (month(datotid) = 8 AND day(datotid) <= 12) THEN '1' ELSE '0' END AS sommerferie,
        CASE WHEN day(utc) = 1 THEN '1' ELSE '0' END AS er_helligdag, last_goals AS "mål_sidste_kamp", runde_nr, goals3 AS "mål_sidste3_lagged",
        points3 AS point_sidste3_lagged, so_far_before AS "point_sæson_lagged", round(gate, 3) AS "sidste_møde_tilskuere",
        dayofyear(utc) / 10 + hour(utc) AS temp_dry, hour(utc) / 2 + month(utc) AS wind_speed, day(utc) / 10 AS precip_past1h,
        month(datotid)::INTEGER AS "måned", ((dayofyear(datotid) - 1) // 7 + 1)::INTEGER AS uge_nr, d10 AS d10_tilskuere, d7 AS d7_tilskuere, d3 AS d3_tilskuere,
        round(tilskuere, 3) AS tilskuere
      FROM named LEFT JOIN sales ON y = year(datotid) AND rnd = runde_nr""",
)
def plan_model_frame(spark, sf):
    """From matches and side inputs to the predictors and target of one team's home matches."""
    done = mf.model_frame(league(spark, sf), *side_inputs(spark, sf), TEAM, LEAGUE_ORDER, first_season=1994, expect="one")
    return done.withColumns({c: r6(c, 3) for c in ("sidste_møde_tilskuere", "tilskuere")})


STAGES = (
    {
        "last_value": Lag("value"), "value3": RollingSum("value", shift=1), "last_result": Lag("result"), "points": RunningSum("pts", ("season",)),
        "met_value": Lag("value", within=("o_orderpriority",)), "all_points": RunningSum("pts"),
    },
    {"points_before": Lag("points")},
)


@query(
    "w_history_of_new_rows",
    f"""WITH {GAMES_SQL}, first AS (SELECT *, lag(value) OVER t AS last_value, CASE WHEN count(value) OVER b = 3 THEN round(sum(value) OVER b, 4) END AS value3,
        lag(result) OVER t AS last_result, CASE WHEN count(pts) OVER s = count(*) OVER s THEN sum(pts) OVER s END AS points,
        lag(value) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS met_value,
        CASE WHEN count(pts) OVER a = count(*) OVER a THEN sum(pts) OVER a END AS all_points FROM games
        WINDOW t AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), b AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
          s AS (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          a AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      second AS (SELECT *, lag(points) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS points_before FROM first)
      SELECT o_orderkey, season, last_value, value3, last_result, points, met_value, all_points, points_before FROM second WHERE season >= 1996""",
)
def history_of_new_rows(spark, sf):
    """Seasons up to 1995 as the start, then 1996 and the later ones, each from the stored state: the rows of a full computation."""
    played, path = materialize(games(spark, sf), "games"), new_path(spark, "history-state")
    names = {"team": "o_custkey", "order": ORDER, "path": path}
    update_history(played.where("season < 1996"), *STAGES, **names)
    added = update_history(played.where("season = 1996"), *STAGES, **names)
    added = added.unionByName(update_history(played.where("season > 1996"), *STAGES, **names))
    columns = ["o_orderkey", "season", *STAGES[0], *STAGES[1]]
    return added.select(*columns).withColumn("value3", r6("value3", 4))
