"""Sources and sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatecast.functions.dates import iso_key
from gatecast.operators.joins import left_join
from gatecast.plans.matches import matches_from_pages
from gatecast.registry.base import query, r6, table
from gatecast.session import new_path
from gatecast.sources import pages as pg
from gatecast.sources import responses as rs
from gatecast.sources import tables as tb


@query(
    "s1_html_rows",
    """WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS h,
         regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS c FROM pages)
       SELECT page_id, generate_subscripts(h, 1)::INTEGER AS row_no, unnest(h) AS href,
       trim(replace(unnest(c), '&amp;', '&')) AS cell FROM l""",
)
def s1(spark, sf):
    """The link lists of the pages, which hold no tables: lists as tables, items as rows."""
    rows = pg.html_rows(table(spark, sf, "pages"), keep=["page_id"], within="nav", table="ul", row="li", cells=["a"])
    return rows.select("page_id", "row_no", "href", "cell")


@query(
    "s2_multi_source_ingest",
    r"""SELECT 'pages' AS source, page_id, nullif(regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1), '') AS section,
        TRY_CAST(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS DOUBLE) AS page_no FROM pages""",
)
def s2(spark, sf):
    read = tb.with_key_from_path(spark.read.parquet(f"{sf}/page*.parquet"), "source", r"/([a-z]+)\.parquet")
    return read.select(
        "source",
        "page_id",
        pg.key_from(F.col("url"), "^https?://[^/]+/([a-z]+)/").alias("section"),
        pg.key_from(F.col("url"), "page=([0-9]+)").try_cast("double").alias("page_no"),
    )


@query(
    "s2_two_sources",
    """SELECT 'customer' AS source, c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL
       SELECT 'supplier', s_suppkey, s_nationkey, s_acctbal FROM supplier""",
)
def s2_two(spark, sf):
    """Two stored sources in one read, the batch key from the path; columns that a source lacks are null."""
    paths = [f"{sf}/{name}.parquet" for name in ("customer", "supplier")]
    both = tb.with_key_from_path(spark.read.option("mergeSchema", "true").parquet(*paths), "source", r"/([a-z]+)\.parquet")
    either = {"key": ("c_custkey", "s_suppkey"), "nation": ("c_nationkey", "s_nationkey"), "balance": ("c_acctbal", "s_acctbal")}
    return both.select("source", *[F.coalesce(*pair).alias(name) for name, pair in either.items()])


@query(
    "s3_json_flatten",
    """SELECT event_type AS "parameterId", value, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS observed FROM events""",
)
def s3(spark, sf):
    """Observations wrapped as nested responses, then taken out again."""
    props = F.struct(F.col("event_type").alias("parameterId"), "value", iso_key(F.col("ts")).alias("observed"))
    body = F.to_json(F.struct(F.array(F.struct(props.alias("properties"))).alias("features")))
    return rs.weather_long(table(spark, sf, "events").select(body.alias("body")))


@query(
    "s3_json_observations",
    """SELECT strftime(ts, '%Y-%m-%d') AS created, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS observed, event_type AS "parameterId",
       user_id::VARCHAR AS "stationId", value FROM events""",
)
def s3_all(spark, sf):
    """Observations wrapped as nested responses, taken out with every property."""
    events = table(spark, sf, "events")
    props = F.struct(
        F.date_format("ts", "yyyy-MM-dd").alias("created"), iso_key(F.col("ts")).alias("observed"), F.col("event_type").alias("parameterId"),
        F.col("user_id").cast("string").alias("stationId"), "value",
    )
    body = F.to_json(F.struct(F.array(F.struct(props.alias("properties"))).alias("features")))
    return rs.observations(events.select(body.alias("body")))


@query("s3_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s3_props(spark, sf):
    body = F.concat(F.lit('{"rows":['), F.col("props"), F.lit("]}")).alias("body")
    events = table(spark, sf, "events").select("event_id", body)
    return rs.json_flatten(events, "body", "rows array<struct<k: bigint>>", "rows", "", keep=("event_id",))


def _stored_name(label: str) -> str:
    return f"gatecast_{label}_{uuid.uuid4().hex[:12]}"


@query("s4_table_overwrite", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def s4(spark, sf):
    name, c = _stored_name("s4"), table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    tb.table_overwrite(c, name, new_path(spark, "s4"))
    tb.table_overwrite(c.where(F.col("c_acctbal") > 0), name, new_path(spark, "s4"))
    return tb.table_read(spark, name)


@query("s5_table_create", "SELECT o_orderkey, o_orderdate, year(o_orderdate)::INTEGER AS yr FROM orders")
def s5(spark, sf):
    name = _stored_name("s5")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("yr"))
    tb.table_create(o, name, new_path(spark, "s5"), partition_by=["yr"])
    return tb.table_read(spark, name)


@query("s6_table_read", "SELECT * FROM supplier")
def s6(spark, sf):
    name = _stored_name("s6")
    tb.table_create(table(spark, sf, "supplier"), name, new_path(spark, "s6"))
    return tb.table_read(spark, name)


@query("s7_table_list", "SELECT name FROM (VALUES ('nation'), ('region')) t(name)")
def s7(spark, sf):
    prefix = _stored_name("s7")
    for source in ("region", "nation"):
        tb.table_create(table(spark, sf, source), f"{prefix}_{source}", new_path(spark, "s7"))
    listed = tb.table_list(spark, f"{prefix}*")
    return listed.select(F.replace("name", F.lit(f"{prefix}_"), F.lit("")).alias("name"))


STAR = """SELECT o.o_orderkey, o.o_totalprice, c.c_mktsegment, n.n_name FROM {orders} o
  LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_orderpriority ILIKE '%urgent%'"""


@query("s8_sql_query", STAR.format(orders="orders", customer="customer", nation="nation"))
def s8(spark, sf):
    return tb.sql_query(spark, STAR, **{t: table(spark, sf, t) for t in ("orders", "customer", "nation")})


@query(
    "s9_snapshot",
    """SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment)::INTEGER AS position FROM customer""",
)
def s9(spark, sf):
    path = new_path(spark, "s9")
    tb.snapshot_write(table(spark, sf, "customer"), path, ["c_mktsegment"])
    levels = tb.snapshot_levels(spark, path).where(F.col("variable") == "c_mktsegment")
    rows = tb.snapshot_read(spark, path).select("c_custkey", "c_mktsegment")
    return left_join(rows, levels, {"c_mktsegment": "level"}, ["position"])


@query(
    "s10_inline_rows",
    """WITH s(scenario, priority, factor) AS (VALUES ('best', '1-URGENT', 1.5::DOUBLE), ('worst', '5-LOW', 0.5::DOUBLE)),
       m AS (SELECT o_orderpriority, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
       SELECT scenario, priority, round(factor * mean, 4) AS expected FROM s LEFT JOIN m ON priority = o_orderpriority""",
)
def s10(spark, sf):
    rows = {"scenario": ["best", "worst"], "priority": ["1-URGENT", "5-LOW"], "factor": [1.5, 0.5]}
    scenarios = tb.inline_rows(spark, rows, "scenario string, priority string, factor double")
    means = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    out = left_join(scenarios, means, {"priority": "o_orderpriority"}, ["mean"])
    return out.select("scenario", "priority", r6(F.col("factor") * F.col("mean"), 4).alias("expected"))


PLAN_PAGES_SQL = """WITH o AS (SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS page, day(o_orderdate)::INTEGER AS d, * FROM orders)
  SELECT y::VARCHAR AS season, page, dense_rank() OVER (PARTITION BY y, page ORDER BY d)::INTEGER AS table_no,
    (row_number() OVER (PARTITION BY y, page, d ORDER BY o_orderkey) + 1)::INTEGER AS row_no, d::DOUBLE AS round,
    'C' || o_custkey || '-K' || o_orderkey AS fixture, o_orderstatus AS result, round(floor(o_totalprice) / 1000 * 1000, 3) AS value FROM o"""


PAGE_KEYS = 1 << 14  # order keys of a page; keys do not repeat, so a page has at most as many rows, some 2 MB


@query("plan_matches", PLAN_PAGES_SQL)
def plan_matches(spark, sf):
    """Orders written as schedule pages (a table per day, on pages of at most ``PAGE_KEYS`` order keys) and read back as a page a month."""
    day, key = F.col("o_orderdate"), ["season", "p", "d", "part"]
    o = table(spark, sf, "orders").withColumns({"season": F.year(day), "p": F.month(day), "d": F.dayofmonth(day), "part": F.floor(F.col("o_orderkey") / PAGE_KEYS)})
    cells = [F.lit("Man"), F.date_format(day, "dd/MM"), F.concat(F.lit("C"), "o_custkey", F.lit("-K"), "o_orderkey"), F.col("o_orderstatus")]
    cells += [(F.floor("o_totalprice") / 1000).cast("decimal(18,3)").cast("string"), F.lit("A &amp; B"), F.lit("")]
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    lines = o.select(*key, F.struct("o_orderkey", line.alias("t")).alias("l"))
    head = F.concat(F.lit('<html><div id="content"><table><tr><th>Runde '), F.col("d").cast("string"), F.lit("</th><th>Dato</th></tr>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["t"]), "")
    pages = lines.groupBy(*key).agg(F.concat(head, body, F.lit("</table></div></html>")).alias("html"))
    name = F.concat_ws("-", *key)
    found = matches_from_pages(pages.select("season", name.alias("name"), "html"), page="name").withColumnRenamed("page", "name")
    # Where a page's rows stand in the month: the tables of earlier days, and the day's rows on earlier pages.
    sizes = o.groupBy(*key).agg(F.count("*").alias("n"))
    days = sizes.select("season", "p", "d").distinct().withColumn("table_no", F.dense_rank().over(Window.partitionBy("season", "p").orderBy("d")))
    earlier = Window.partitionBy("season", "p", "d").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("name", name)
    same = reduce(lambda x, y: x & y, [sizes[c].eqNullSafe(days[c]) for c in ("season", "p", "d")])
    places = sizes.join(days, same).select("name", sizes["p"].alias("page"), days["table_no"], "before")
    found = found.drop("table_no").join(places, "name").withColumn("row_no", (F.col("before") + F.col("row_no")).cast("int"))
    return found.select(
        F.col("sæson_år").alias("season"), "page", "table_no", "row_no", F.col("runde_nr").alias("round"),
        F.col("kamp").alias("fixture"), F.col("resultat").alias("result"), r6("tilskuere", 3).alias("value"),
    )
