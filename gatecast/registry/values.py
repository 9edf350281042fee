"""Text, date and case expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatecast.functions import cases, dates, text
from gatecast.functions.labels import FIRST_MEETING
from gatecast.operators.impute import impute_group_mean
from gatecast.operators.windows import last_meeting
from gatecast.registry.base import GAMES_SQL, ORDER, games, query, r6, table
from gatecast.session import materialize


@query("x1_str_detect", "SELECT p_partkey, regexp_matches(p_name, '^(red|blue) .*o') AS hit FROM part")
def x1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.detect(F.col("p_name"), "^(red|blue) .*o").alias("hit"))


@query(
    "x2_split_lenient",
    """WITH s AS (SELECT o_orderkey, o_orderpriority, string_split(o_orderpriority, ' ') AS p FROM orders)
       SELECT o_orderkey, o_orderpriority, p[1] AS first_part, p[2] AS second_part, len(p) = 2 AS o_orderpriority_ok,
       len(p)::INTEGER AS o_orderpriority_pieces, '' AS o_orderpriority_remainder FROM s""",
)
def x2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return text.split_lenient(o, "o_orderpriority", ["first_part", "second_part"], " ")


@query("x3_split_strict", "SELECT p_partkey, split_part(p_name, ' ', 1) AS colour, split_part(p_name, ' ', 2) AS thing FROM part")
def x3(spark, sf):
    return text.split_strict(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["colour", "thing"], " ")


@query(
    "x4_concat",
    f"""WITH {GAMES_SQL} SELECT o_orderkey, coalesce(result, 'NA') || ' ' || season::VARCHAR AS spaced,
        o_orderstatus || o_orderpriority AS plain, result || 'T' || season::VARCHAR || 'Z' AS strict FROM games""",
)
def x4(spark, sf):
    return games(spark, sf).select(
        "o_orderkey",
        text.paste(F.col("result"), F.col("season")).alias("spaced"),
        text.paste(F.col("o_orderstatus"), F.col("o_orderpriority"), sep="").alias("plain"),
        text.paste(text.paste(F.col("result"), F.col("season"), sep="T", na=None), F.lit("Z"), sep="", na=None).alias("strict"),
    )


@query(
    "x5_parse_number",
    """SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '(-?[0-9]+)', 1), '') AS DOUBLE) AS brand_number,
       TRY_CAST(nullif(regexp_extract(p_name, '(-?[0-9]+)', 1), '') AS DOUBLE) AS name_number FROM part""",
)
def x5(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        text.parse_number(F.col("p_brand")).alias("brand_number"),
        text.parse_number(F.col("p_name")).alias("name_number"),
    )


@query(
    "x6_format_label",
    r"""SELECT o_orderkey, round_even(o_totalprice / 2, 0)::BIGINT::VARCHAR || ' tilskuere' AS label,
        replace(format('{:,}', round_even(o_totalprice / 2, 0)::BIGINT), ',', '.') AS axis FROM orders""",
)
def x6(spark, sf):
    half = F.col("o_totalprice") / 2
    return table(spark, sf, "orders").select(
        "o_orderkey",
        text.format_label(half, " tilskuere").alias("label"),
        text.format_label(half, big_mark=True).alias("axis"),
    )


SCORES_SQL = """s AS (SELECT o_orderkey, floor(o_totalprice / 40000)::BIGINT AS home, month(o_orderdate)::BIGINT AS away,
  o_orderpriority < '3' AS is_home FROM orders)"""


def _scores(spark, sf):
    """Text scores 0..12 against 1..12, so that text and number order differ."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.floor(F.col("o_totalprice") / 40000).cast("string").alias("home"),
        F.month("o_orderdate").cast("string").alias("away"),
        (F.col("o_orderpriority") < "3").alias("is_home"),
    )


CLASS_SQL = """CASE WHEN {h} = {a} THEN 'uafgjort' WHEN ({h} > {a}) = is_home THEN 'vundet' ELSE 'tabt' END"""


@query(
    "x7_text_compare",
    f"WITH {SCORES_SQL} SELECT o_orderkey, {CLASS_SQL.format(h='home::VARCHAR', a='away::VARCHAR')} AS result FROM s",
)
def x7(spark, sf):
    result = cases.result_class(F.col("home"), F.col("away"), F.col("is_home"), compat="text")
    return _scores(spark, sf).select("o_orderkey", result.alias("result"))


@query("c1_result_class", f"WITH {SCORES_SQL} SELECT o_orderkey, {CLASS_SQL.format(h='home', a='away')} AS result FROM s")
def c1(spark, sf):
    result = cases.result_class(F.col("home"), F.col("away"), F.col("is_home"))
    return _scores(spark, sf).select("o_orderkey", result.alias("result"))


@query("c2_points", f"WITH {GAMES_SQL} SELECT o_orderkey, pts AS points FROM games")
def c2(spark, sf):
    return games(spark, sf).select("o_orderkey", cases.points(F.col("result")).alias("points"))


@query(
    "c3_case_when",
    "SELECT p_partkey, CASE WHEN p_size < 25 THEN 1.0::DOUBLE WHEN p_size > 25 THEN 2.0::DOUBLE END AS band FROM part",
)
def c3(spark, sf):
    band = cases.case_when((F.col("p_size") < 25, 1.0), (F.col("p_size") > 25, 2.0))
    return table(spark, sf, "part").select("p_partkey", band.alias("band"))


@query(
    "c4_opponent",
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
       CASE WHEN l_returnflag = 'A' THEN l_linestatus ELSE l_returnflag END AS opponent FROM lineitem""",
)
def c4(spark, sf):
    other = cases.opponent(F.col("l_returnflag"), F.col("l_linestatus"), F.lit("A"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", other.alias("opponent")
    )


@query(
    "c5_null_to_label",
    f"""WITH {GAMES_SQL} SELECT o_orderkey, coalesce(lag(result) OVER (PARTITION BY o_custkey, o_orderpriority
        ORDER BY o_orderdate, o_orderkey), '{FIRST_MEETING}') AS last_meeting FROM games""",
)
def c5(spark, sf):
    met = last_meeting(games(spark, sf), "result", "met", team="o_custkey", against="o_orderpriority", order=ORDER)
    return met.select("o_orderkey", cases.null_to_label(F.col("met"), FIRST_MEETING).alias("last_meeting"))


@query("c6_null_flag", f"WITH {GAMES_SQL} SELECT o_orderkey, (value IS NULL)::INTEGER AS is_new FROM games")
def c6(spark, sf):
    return games(spark, sf).select("o_orderkey", cases.null_flag(F.col("value")).alias("is_new"))


@query(
    "c7_impute_group_mean",
    f"""WITH {GAMES_SQL}, m AS (SELECT o_orderkey, o_totalprice, lag(value) OVER (PARTITION BY o_custkey, o_orderpriority
          ORDER BY o_orderdate, o_orderkey) AS met FROM games),
        b AS (SELECT *, CASE WHEN met IS NULL AND o_totalprice < 250000 THEN 1 WHEN met IS NULL AND o_totalprice > 250000
          THEN 2 END AS band FROM m),
        g AS (SELECT band, avg(o_totalprice) AS mean FROM b WHERE band IS NOT NULL GROUP BY band)
        SELECT o_orderkey, round(coalesce(met, mean), 4) AS met FROM b LEFT JOIN g ON b.band = g.band""",
)
def c7(spark, sf):
    met = last_meeting(games(spark, sf), "value", "met", team="o_custkey", against="o_orderpriority", order=ORDER)
    stored = materialize(met.select("o_orderkey", "o_totalprice", "met"), "met")
    out = impute_group_mean(stored, "met", "o_totalprice", 250000)
    return out.select("o_orderkey", r6("met", 4).alias("met"))


@query("c8_binary_flag", "SELECT o_orderkey, (o_orderpriority <> '5-LOW')::INTEGER AS flag FROM orders")
def c8(spark, sf):
    flag = cases.binary_flag(F.col("o_orderpriority"), "5-LOW")
    return table(spark, sf, "orders").select("o_orderkey", flag.alias("flag"))


@query(
    "c9_recode",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '3 Dage' WHEN '2-HIGH' THEN '7 Dage'
       WHEN '3-MEDIUM' THEN '10 Dage' ELSE o_orderpriority END AS label FROM orders""",
)
def c9(spark, sf):
    names = {"1-URGENT": "3 Dage", "2-HIGH": "7 Dage", "3-MEDIUM": "10 Dage"}
    label = cases.recode(F.col("o_orderpriority"), names, keep_others=True)
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label"))


@query("c10_side_pick", f"WITH {SCORES_SQL} SELECT o_orderkey, CASE WHEN is_home THEN home ELSE away END AS goals FROM s")
def c10(spark, sf):
    goals = cases.side_pick(F.col("is_home"), F.col("home"), F.col("away")).try_cast("bigint")
    return _scores(spark, sf).select("o_orderkey", goals.alias("goals"))


@query(
    "t1_season_to_year",
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS real_year FROM orders""",
)
def t1(spark, sf):
    season = dates.season_of(F.col("o_orderdate")).cast("string")
    date_text = F.date_format("o_orderdate", "dd/MM HH:mm")
    return table(spark, sf, "orders").select("o_orderkey", dates.season_to_year(season, date_text).alias("real_year"))


@query("t2_parse_local_ts", "SELECT event_id, date_trunc('minute', ts) AS local_ts FROM events")
def t2(spark, sf):
    local = dates.parse_local_ts(F.year("ts"), F.date_format("ts", "dd/MM HH:mm"))
    return table(spark, sf, "events").select("event_id", local.alias("local_ts"))


@query(
    "t3_to_utc",
    """SELECT o_orderkey, timezone('UTC', timezone('Europe/Copenhagen', o_orderdate + INTERVAL 18 HOUR)) AS utc FROM orders""",
)
def t3(spark, sf):
    evening = F.col("o_orderdate") + F.expr("INTERVAL 18 HOURS")
    return table(spark, sf, "orders").select("o_orderkey", dates.to_utc(evening).alias("utc"))


@query(
    "t4_day_part",
    """SELECT event_id, CASE WHEN hour(ts) BETWEEN 10 AND 14 THEN 'middag' WHEN hour(ts) BETWEEN 15 AND 17 THEN 'eftermiddag'
       WHEN hour(ts) BETWEEN 18 AND 23 THEN 'aften' END AS day_part FROM events""",
)
def t4(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.day_part(F.col("ts")).alias("day_part"))


@query("t5_floor_hour", "SELECT event_id, date_trunc('hour', ts) AS hour_ts FROM events")
def t5(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.floor_hour(F.col("ts")).alias("hour_ts"))


@query(
    "t6_iso_key",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso_exact,
       strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso_hour, strftime(ts, '%Y-%m-%d') AS day FROM events""",
)
def t6(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id",
        dates.iso_key(ts).alias("iso_exact"),
        dates.iso_key(dates.floor_hour(ts)).alias("iso_hour"),
        dates.day_key(ts).alias("day"),
    )


@query("t7_month", "SELECT o_orderkey, month(o_orderdate)::INTEGER AS month FROM orders")
def t7(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.month(F.col("o_orderdate")).alias("month"))


@query("t8_week_of_year_simple", "SELECT o_orderkey, ((dayofyear(o_orderdate) - 1) // 7 + 1)::INTEGER AS week FROM orders")
def t8(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.week_of_year_simple(F.col("o_orderdate")).alias("week"))


@query(
    "t9_holiday_season_flag",
    """SELECT o_orderkey, CASE WHEN month(o_orderdate) = 7 OR (month(o_orderdate) = 6 AND day(o_orderdate) >= 26)
       OR (month(o_orderdate) = 8 AND day(o_orderdate) <= 12) THEN 1 ELSE 0 END AS summer FROM orders""",
)
def t9(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.holiday_season_flag(F.col("o_orderdate")).alias("summer"))


@query("t10_to_timestamp_from_stored", "SELECT event_id, date_trunc('second', ts) AS restored FROM events")
def t10(spark, sf):
    stored = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "events").select("event_id", dates.stored_timestamp(stored).alias("restored"))
