"""Column work and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatecast.functions.cases import null_flag
from gatecast.functions.text import parse_number
from gatecast.operators import columns as col
from gatecast.operators import filters as flt
from gatecast.registry.base import GAMES_SQL, games, query, r6, table


@query(
    "p1_clean_names",
    """SELECT c_custkey AS cust_key, c_name AS c_name, c_nationkey AS nation_key_2002, c_acctbal AS balance_percent,
       c_mktsegment AS saeson_ar FROM customer""",
)
def p1(spark, sf):
    messy = table(spark, sf, "customer").toDF("Cust Key", "c.Name", "nationKey (2002)", "Balance %", "Sæson_År")
    return col.clean_names(messy)


@query(
    "p2_rename_positional",
    "SELECT s_suppkey AS id, s_name AS label, s_nationkey AS place, s_acctbal AS amount FROM supplier",
)
def p2(spark, sf):
    return col.rename_positional(table(spark, sf, "supplier"), ["id", "label", "place", "amount"])


@query(
    "p3_derive",
    """SELECT o_orderkey, round(o_totalprice / 1000, 6) AS thousands, round(o_totalprice / 1000 * 2, 6) AS twice
       FROM orders""",
)
def p3(spark, sf):
    out = col.derive(
        table(spark, sf, "orders"), thousands=F.col("o_totalprice") / 1000, twice=F.col("thousands") * 2
    )
    return out.select("o_orderkey", r6("thousands").alias("thousands"), r6("twice").alias("twice"))


@query("p4_place_after", "SELECT s_suppkey, s_acctbal * 2 AS doubled, s_name, s_nationkey, s_acctbal FROM supplier")
def p4(spark, sf):
    return col.derive(table(spark, sf, "supplier"), after="s_suppkey", doubled=F.col("s_acctbal") * 2)


@query("p5_keep", "SELECT o_orderdate, o_orderkey FROM orders")
def p5(spark, sf):
    return col.keep(table(spark, sf, "orders"), "o_orderdate", "o_orderkey")


@query("p6_drop", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def p6(spark, sf):
    return col.drop(table(spark, sf, "customer"), "c_name", "c_acctbal")


@query(
    "p7_drop_range",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate FROM lineitem",
)
def p7(spark, sf):
    return col.drop_range(table(spark, sf, "lineitem"), "l_quantity", "l_tax")


@query("p8_rename_select", "SELECT o_orderdate AS dato, o_orderpriority AS helligdag FROM orders")
def p8(spark, sf):
    return col.rename_select(table(spark, sf, "orders"), dato="o_orderdate", helligdag="o_orderpriority")


@query(
    "p9_map_columns_by_type",
    """SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand, upper(p_type) AS p_type, p_size,
       p_retailprice FROM part""",
)
def p9(spark, sf):
    return col.map_columns_by_type(table(spark, sf, "part"), T.StringType, F.upper)


@query(
    "p10_cast",
    """SELECT p_partkey, TRY_CAST(p_name AS DOUBLE) AS name_number, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_number,
       p_size::VARCHAR AS size_text FROM part""",
)
def p10(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_name").alias("name_number"),
        F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand_number"),
        F.col("p_size").alias("size_text"),
    )
    return col.cast_columns(parts, name_number="double", brand_number="double", size_text="string")


@query(
    "p11_constant_key",
    """SELECT p_partkey, p_brand, '2002' AS season_year, TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE) AS round
       FROM part""",
)
def p11(spark, sf):
    batch = col.constant_key(table(spark, sf, "part").select("p_partkey", "p_brand"), season_year="2002")
    return batch.withColumn("round", parse_number(F.col("p_brand")))


@query("p12_scale", "SELECT o_orderkey, round(o_totalprice * 1000, 2) AS o_totalprice FROM orders")
def p12(spark, sf):
    out = col.scale(table(spark, sf, "orders"), "o_totalprice", 1000)
    return out.select("o_orderkey", r6("o_totalprice", 2).alias("o_totalprice"))


@query("p13_copy_column", "SELECT *, n_name AS n_name2 FROM nation")
def p13(spark, sf):
    return col.copy_column(table(spark, sf, "nation"), "n_name", "n_name2")


@query("p14_key_vector", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL")
def p14(spark, sf):
    return col.key_vector(table(spark, sf, "orders"), "o_custkey")


@query(
    "p15_select_star_plus",
    "SELECT o.*, c.c_acctbal, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey",
)
def p15(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(col.star_plus(o, c, ["c_acctbal", "c_mktsegment"]))


@query("f1_contains_any", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'blue') OR contains(p_name, 'bolt')")
def f1(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return parts.where(flt.contains_any(F.col("p_name"), "blue", "bolt"))


@query("f2_contains_one", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red')")
def f2(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return parts.where(flt.contains_any(F.col("p_name"), "red"))


@query(
    "f3_not_null_not_sentinel",
    f"""WITH {GAMES_SQL} SELECT o_orderkey, result FROM games WHERE result IS NOT NULL AND result <> 'uafgjort'""",
)
def f3(spark, sf):
    return games(spark, sf).where(flt.played(F.col("result"), "uafgjort")).select("o_orderkey", "result")


@query(
    "f4_threshold_after_cast",
    "SELECT p_partkey, p_brand FROM part WHERE TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) >= 13",
)
def f4(spark, sf):
    number = F.split_part("p_brand", F.lit("#"), F.lit(2))
    return table(spark, sf, "part").where(flt.at_least(number, 13)).select("p_partkey", "p_brand")


@query("f5_in_list", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view', 'error')")
def f5(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return events.where(F.col("event_type").isin("click", "view", "error"))


@query("f6_not_null", f"WITH {GAMES_SQL} SELECT o_orderkey, value FROM games WHERE value IS NOT NULL")
def f6(spark, sf):
    return games(spark, sf).where(F.col("value").isNotNull()).select("o_orderkey", "value")


@query("f7_like_pattern", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BLUE %'")
def f7(spark, sf):
    return table(spark, sf, "part").where(flt.like_any_case(F.col("p_name"), "%BLUE %")).select("p_partkey", "p_name")


@query("f8_equals_flag", f"WITH {GAMES_SQL} SELECT o_orderkey, o_custkey FROM games WHERE value IS NULL")
def f8(spark, sf):
    flagged = games(spark, sf).withColumn("is_new", null_flag(F.col("value")))
    return flagged.where(F.col("is_new") == 1).select("o_orderkey", "o_custkey")


@query(
    "f9_or_of_ands",
    """SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
       OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW') OR (o_orderstatus = 'P' AND o_orderpriority = '2-HIGH')""",
)
def f9(spark, sf):
    pairs = [("F", "1-URGENT"), ("O", "5-LOW"), ("P", "2-HIGH")]
    keep = flt.any_pair(pairs, F.col("o_orderstatus"), F.col("o_orderpriority"))
    return table(spark, sf, "orders").where(keep).select("o_orderkey")


@query(
    "f10_complement",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def f10(spark, sf):
    large = table(spark, sf, "orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    return flt.complement(table(spark, sf, "customer").select("c_custkey", "c_name"), large, ["c_custkey"])
