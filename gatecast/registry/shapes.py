"""Joins, stacking, pivots and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatecast.functions.cases import rank_of, recode
from gatecast.functions.dates import day_key, floor_hour, iso_key
from gatecast.operators import joins, reshape
from gatecast.registry.base import query, r6, table

OBS_SQL = """obs AS (SELECT strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS observed, round(sum(l_quantity), 2) AS quantity
  FROM lineitem GROUP BY l_shipdate)"""
DAYS = {"01-01": "Nytårsdag", "06-05": "Grundlovsdag", "12-25": "Juledag", "12-26": "2. juledag"}
DAYS_SQL = """days AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS dato, CASE strftime(o_orderdate, '%m-%d')
  WHEN '01-01' THEN 'Nytårsdag' WHEN '06-05' THEN 'Grundlovsdag' WHEN '12-25' THEN 'Juledag' WHEN '12-26' THEN '2. juledag' END
  AS helligdag FROM orders WHERE strftime(o_orderdate, '%m-%d') IN ('01-01', '06-05', '12-25', '12-26'))"""
SALES_SQL = """sales AS (SELECT o_custkey AS cust, year(o_orderdate) AS yr, round(sum(o_totalprice), 2) AS sold
  FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)"""


def _observations(spark, sf):
    ship = table(spark, sf, "lineitem").groupBy("l_shipdate").agg(r6(F.sum("l_quantity"), 2).alias("quantity"))
    return ship.select(iso_key(F.col("l_shipdate")).alias("observed"), "quantity")


def _days(spark, sf):
    label = recode(F.date_format("o_orderdate", "MM-dd"), DAYS)
    days = table(spark, sf, "orders").select(day_key(F.col("o_orderdate")).alias("dato"), label.alias("helligdag"))
    return days.where(F.col("helligdag").isNotNull()).distinct()


def _sales(spark, sf):
    sold = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    return sold.groupBy(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("yr")).agg(
        r6(F.sum("o_totalprice"), 2).alias("sold")
    )


def _matches(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return o.withColumns(
        {
            "iso": iso_key(F.col("o_orderdate")),
            "day": day_key(F.col("o_orderdate")),
            "year": F.year("o_orderdate"),
        }
    )


M_SQL = """m AS (SELECT *, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day,
  year(o_orderdate) AS yr FROM orders)"""


@query(
    "j1_left_join_timestamp",
    f"WITH {OBS_SQL}, {M_SQL} SELECT o_orderkey, quantity FROM m LEFT JOIN obs ON m.iso = obs.observed",
)
def j1(spark, sf):
    out = joins.left_join_timestamp(_matches(spark, sf), _observations(spark, sf), "iso", "observed", ["quantity"], "one")
    return out.select("o_orderkey", "quantity")


@query(
    "j2_left_join_date",
    f"WITH {DAYS_SQL}, {M_SQL} SELECT o_orderkey, helligdag FROM m LEFT JOIN days ON m.day = days.dato",
)
def j2(spark, sf):
    out = joins.left_join_date(_matches(spark, sf), _days(spark, sf), "day", "dato", ["helligdag"])
    return out.select("o_orderkey", "helligdag")


@query(
    "j3_left_join_compound",
    f"""WITH {SALES_SQL}, {M_SQL} SELECT o_orderkey, sold FROM m LEFT JOIN sales ON m.o_custkey = sales.cust
        AND m.yr = sales.yr""",
)
def j3(spark, sf):
    on = {"o_custkey": "cust", "year": "yr"}
    return joins.left_join_compound(_matches(spark, sf), _sales(spark, sf), on, ["sold"]).select("o_orderkey", "sold")


@query(
    "j4_enrich_star",
    f"""WITH {OBS_SQL}, {DAYS_SQL}, {SALES_SQL}, {M_SQL} SELECT o_orderkey, o_custkey, quantity, helligdag, sold FROM m
        LEFT JOIN obs ON m.iso = obs.observed LEFT JOIN days ON m.day = days.dato
        LEFT JOIN sales ON m.o_custkey = sales.cust AND m.yr = sales.yr WHERE o_orderpriority ILIKE '%low%'""",
)
def j4(spark, sf):
    out = joins.enrich_star(
        _matches(spark, sf),
        (_observations(spark, sf), {"iso": "observed"}, ["quantity"]),
        (_days(spark, sf), {"day": "dato"}, ["helligdag"]),
        (_sales(spark, sf), {"o_custkey": "cust", "year": "yr"}, ["sold"]),
        where=F.col("o_orderpriority").ilike("%low%"),
    )
    return out.select("o_orderkey", "o_custkey", "quantity", "helligdag", "sold")


HOURLY_SQL = """hourly AS (SELECT date_trunc('hour', ts) AS observed, max(CASE WHEN event_type = 'click' THEN value END) AS click,
  max(CASE WHEN event_type = 'view' THEN value END) AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)"""


def _hourly(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    per_hour = e.groupBy(floor_hour(F.col("ts")).alias("observed"), "event_type").agg(F.max("value").alias("value"))
    return reshape.pivot_wider(per_hour, ["observed"], "event_type", "value", ["click", "view"])


@query("r1_pivot_wider", f"WITH {HOURLY_SQL} SELECT observed, click, view FROM hourly")
def r1(spark, sf):
    return _hourly(spark, sf)


@query(
    "j5_hour_aligned_join",
    f"""WITH {HOURLY_SQL} SELECT event_id, ts, click, view FROM events LEFT JOIN hourly
        ON date_trunc('hour', ts) = hourly.observed WHERE event_type = 'signup'""",
)
def j5(spark, sf):
    signups = table(spark, sf, "events").where(F.col("event_type") == "signup").select("event_id", "ts")
    return joins.hour_aligned_join(signups, _hourly(spark, sf), "ts", "observed", ["click", "view"])


@query(
    "j6_keyed_lookup",
    """SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND date_trunc('hour', ts) IN
       (SELECT date_trunc('hour', ts) FROM events WHERE event_type = 'signup')""",
)
def j6(spark, sf):
    e = table(spark, sf, "events").withColumn("observed", floor_hour(F.col("ts")))
    wanted = e.where(F.col("event_type") == "signup")
    obs = e.where(F.col("event_type").isin("click", "view"))
    return joins.keyed_lookup(obs, wanted, "observed", "observed").select("event_id", "event_type", "value")


@query(
    "j6_keyed_lookup_large",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)""",
)
def j6_large(spark, sf):
    wanted = table(spark, sf, "orders").where("o_totalprice > 300000")
    found = joins.keyed_lookup_large(table(spark, sf, "lineitem"), wanted, "l_orderkey", "o_orderkey")
    return found.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "u1_union_by_name",
    """SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL
       SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier""",
)
def u1(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    s = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")
    )
    return reshape.union_by_name(c, s)


@query(
    "u2_union_with_type_repair",
    """SELECT c_custkey AS key, c_nationkey::VARCHAR AS place FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier""",
)
def u2(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("place"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("place"))
    return reshape.union_with_type_repair(c, s, place="string")


@query(
    "r2_pivot_longer",
    """SELECT c_custkey, 'c_name' AS name, c_name AS value FROM customer UNION ALL
       SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer""",
)
def r2(spark, sf):
    return reshape.pivot_longer(table(spark, sf, "customer"), ["c_custkey"], ["c_name", "c_mktsegment"], "name", "value")


@query(
    "r3_row_names_to_column",
    """SELECT ['Full Linear', 'Forward Selection', 'Backward Selection', 'Ridge', 'Lasso'][l_linenumber] AS model,
       count(*) AS n FROM lineitem GROUP BY 1""",
)
def r3(spark, sf):
    from gatecast.models.fits import FAMILIES

    counts = table(spark, sf, "lineitem").select("l_linenumber")
    named = reshape.row_names_to_column(FAMILIES, counts, "l_linenumber", "model")
    return named.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


ERR_SQL = """err AS (SELECT o_orderpriority AS model, CASE o_orderstatus WHEN 'F' THEN 'måned1' WHEN 'O' THEN 'dag10' ELSE 'dag7' END
  AS horizon, var_pop(o_totalprice) AS mse FROM orders GROUP BY ALL)"""


def _errors(spark, sf):
    """Error of the mean as a guess, per priority and status: a stand-in for model errors."""
    horizon = F.when(F.col("o_orderstatus") == "F", "måned1").when(F.col("o_orderstatus") == "O", "dag10").otherwise("dag7")
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("model"), horizon.alias("horizon")).agg(
        F.var_pop("o_totalprice").alias("mse")
    )


@query(
    "r4_score_matrix",
    f"""WITH {ERR_SQL} SELECT model, round(sqrt(max(CASE WHEN horizon = 'måned1' THEN mse END)), 4) AS "måned1",
        round(sqrt(max(CASE WHEN horizon = 'dag10' THEN mse END)), 4) AS dag10,
        round(sqrt(max(CASE WHEN horizon = 'dag7' THEN mse END)), 4) AS dag7 FROM err GROUP BY model""",
)
def r4(spark, sf):
    names = ["måned1", "dag10", "dag7"]
    matrix = reshape.score_matrix(_errors(spark, sf), names, "mse", root=True)
    return matrix.select("model", *[r6(n, 4).alias(n) for n in names])


LEVELS = ("måned1", "dag10", "dag7", "dag3")


@query(
    "o1_order_by_level",
    f"""WITH {ERR_SQL} SELECT model, horizon, CASE horizon WHEN 'måned1' THEN 1 WHEN 'dag10' THEN 2 WHEN 'dag7' THEN 3 END AS place
        FROM err ORDER BY place, model""",
)
def o1(spark, sf):
    placed = _errors(spark, sf).select("model", "horizon", rank_of(F.col("horizon"), LEVELS).alias("place"))
    return reshape.order_by_level(placed, "horizon", LEVELS)


@query(
    "o2_order_by_value_desc",
    f"WITH {ERR_SQL} SELECT model, horizon, round(sqrt(mse), 4) AS rmse FROM err ORDER BY rmse DESC",
)
def o2(spark, sf):
    scored = _errors(spark, sf).select("model", "horizon", r6(F.sqrt("mse"), 4).alias("rmse"))
    return reshape.order_by_value_desc(scored, "rmse", "model", "horizon")


@query(
    "o3_top1_per_group",
    f"WITH {ERR_SQL} SELECT horizon, arg_min(model, mse) AS model, round(min(mse), 2) AS mse FROM err GROUP BY horizon",
)
def o3(spark, sf):
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    best = reshape.top1_per_group(_errors(spark, sf), ["horizon"], "model", "mse", levels)
    return best.select("horizon", "model", r6("mse", 2).alias("mse"))
