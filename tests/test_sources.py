import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from gatecast.plans.matches import matches_from_pages
from gatecast.registry import QUERIES
from gatecast.sources import pages, responses, tables
from gatecast.session import materialize, new_path, shared_folder
from tests.conftest import rows

PAGE = """<html><body><table><tr><td>outside</td></tr></table>
<div id="content"><p>x</p><div><table><thead><tr><th>Runde 1</th><th>Kamp</th></tr></thead>
<tr><td> Søn </td><td><a href="/k/1">HFC-ANK</a> &amp; co</td></tr></table></div>
<img src="a.png"><br><table><tr><th>Runde 2</th></tr><tr><td>Man</td></tr></table></div>
<table><tr><td>after</td></tr></table></body></html>"""


def test_tables_below_the_content_element(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, "w", "<p>no table")], "page_id int, url string, html string")
    got = rows(pages.html_rows(df).select("page_id", "table_no", "row_no", "col_no", "tag", "cell", "href"), "table_no", "row_no", "col_no")
    assert got == [
        (1, 1, 1, 1, "th", "Runde 1", None), (1, 1, 1, 2, "th", "Kamp", None), (1, 1, 2, 1, "td", "Søn", None),
        (1, 1, 2, 2, "td", "HFC-ANK & co", "/k/1"), (1, 2, 1, 1, "th", "Runde 2", None), (1, 2, 2, 1, "td", "Man", None),
    ]


def test_pages_from_files_carry_their_season(spark, tmp_path):
    for season in (2002, 2003):
        folder = tmp_path / f"season={season}"
        folder.mkdir()
        (folder / "page.html").write_text(PAGE, encoding="utf-8")
    got = pages.read_pages(spark, f"{tmp_path}/*/*.html")
    assert rows(got.select("season"), "season") == [("2002",), ("2003",)]
    assert pages.html_rows(got, keep=["season"]).count() == 12


def test_weather_and_holidays(spark):
    item = lambda p, v: {"properties": {"parameterId": p, "value": v, "observed": "2024-01-01T12:00:00Z", "other": 1}}
    bodies = [(json.dumps({"features": [item("temp_dry", 1.5), item("wind_speed", 3.0)]}),), ('{"features": []}',), ("broken",)]
    got = responses.weather_long(spark.createDataFrame(bodies, "body string"))
    assert rows(got, "parameterId") == [("temp_dry", 1.5, "2024-01-01T12:00:00Z"), ("wind_speed", 3.0, "2024-01-01T12:00:00Z")]
    days = [(json.dumps([{"date": "2024-12-25", "localName": "Juledag", "fixed": True}]),)]
    assert rows(responses.holidays(spark.createDataFrame(days, "body string")), "dato") == [("2024-12-25", "Juledag")]


def test_tables_overwrite_create_list(spark, tmp_path):
    a, b = spark.range(3), spark.range(5)
    tables.table_overwrite(a, "gc_t1", str(tmp_path / "a"))
    tables.table_overwrite(b, "gc_t1", str(tmp_path / "b"))
    assert tables.table_read(spark, "gc_t1").count() == 5
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        tables.table_create(a, "gc_t1", str(tmp_path / "c"))
    tables.table_create(a, "gc_t2", str(tmp_path / "d"))
    a.createOrReplaceTempView("gc_view")
    assert rows(tables.table_list(spark, "gc_*"), "name") == [("gc_t1",), ("gc_t2",)]
    assert tables.sql_query(spark, "SELECT max(id) AS m FROM {t}", t=b).first().m == 4


def test_snapshot_keeps_types_and_levels(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "m string, n int")
    tables.snapshot_write(df, str(tmp_path / "s"), ["m"])
    back = tables.snapshot_read(spark, str(tmp_path / "s"))
    assert [f.dataType for f in back.schema] == [f.dataType for f in df.schema] and rows(back, "n") == rows(df, "n")
    assert rows(tables.snapshot_levels(spark, str(tmp_path / "s")), "position") == [("m", "a", 1), ("m", "b", 2)]


def test_inline_rows(spark):
    got = tables.inline_rows(spark, {"s": ["x", "y"], "v": [1.0, 2.0]}, "s string, v double")
    assert rows(got, "s") == [("x", 1.0), ("y", 2.0)]
    with pytest.raises(ValueError):
        tables.inline_rows(spark, {"s": ["x"], "v": [1.0, 2.0]}, "s string, v double")


def test_materialize_goes_to_the_shared_folder(spark):
    folder = shared_folder(spark)
    df = materialize(spark.range(4).withColumn("å b", F.lit(1)), "t")
    assert df.columns == ["id", "å b"] and all(folder in f for f in df.inputFiles())
    assert new_path(spark, "x") != new_path(spark, "x")


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session as one whose executors run apart from the driver, with the folders it names given back afterwards."""
    kept = spark.conf.get("gatecast.folder")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://driver:7077")
    yield spark
    spark.conf.set("gatecast.folder", kept)


def test_a_cluster_takes_a_local_path_that_all_executors_reach(cluster, tmp_path):
    cluster.conf.set("gatecast.folder", f"{tmp_path}/mounted/")
    assert shared_folder(cluster) == f"{tmp_path}/mounted" and rows(materialize(cluster.range(3), "t"), "id") == [(0,), (1,), (2,)]
    assert [p.name.split("-")[0] for p in (tmp_path / "mounted/gatecast").iterdir()] == ["t"]
    orders = cluster.createDataFrame([(k, 1, "5-LOW", "F", 1000.0 * k, datetime.date(1995, 1, k)) for k in range(20, 30)],
                                     "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double, o_orderdate date")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = rows(QUERIES["c7_impute_group_mean"](cluster, str(tmp_path)), "o_orderkey")
    assert got == [(k, 1000.0 * (k - 1) if k > 25 else 22500.0) for k in range(20, 30)]


def test_a_cluster_without_a_shared_folder_is_refused(cluster, tmp_path, monkeypatch):
    (tmp_path / "file").touch()
    cluster.conf.set("gatecast.folder", f"{tmp_path}/file")
    for _ in range(2):
        with pytest.raises(ValueError, match="all executors reach"):
            new_path(cluster, "x")
    # An executor with a disk of its own: what it writes is not there for the others.
    read = type(cluster.read).parquet
    monkeypatch.setattr(type(cluster.read), "parquet", lambda self, *paths: read(self, *paths).where("id % 3 > 0"))
    cluster.conf.set("gatecast.folder", f"{tmp_path}/apart")
    with pytest.raises(ValueError, match="of 16 rows came back"):
        materialize(cluster.range(3), "t")


def test_a_cluster_turns_to_the_warehouse(cluster, tmp_path, monkeypatch):
    cluster.conf.unset("gatecast.folder")
    named = {"spark.checkpoint.dir": None, "spark.sql.warehouse.dir": f"file:{tmp_path}/warehouse"}
    get = type(cluster.conf).get
    monkeypatch.setattr(type(cluster.conf), "get", lambda self, key, *default: named[key] if key in named else get(self, key, *default))
    monkeypatch.setattr(type(cluster.sparkContext), "getCheckpointDir", lambda self: None)
    assert shared_folder(cluster) == f"file:{tmp_path}/warehouse"
    (tmp_path / "file").touch()
    named["spark.checkpoint.dir"] = f"{tmp_path}/file"
    assert shared_folder(cluster) == f"file:{tmp_path}/warehouse"
    monkeypatch.setattr(type(cluster.sparkContext), "getCheckpointDir", lambda self: f"file:{tmp_path}/set")
    named["spark.checkpoint.dir"] = None
    assert shared_folder(cluster) == f"file:{tmp_path}/set"


def test_spanning_cells_are_repeated_and_nested_tables_kept_apart(spark):
    page = """<div id="content"><table><tr><th colspan="2">Head</th><th>C</th></tr>
    <tr><td rowspan="2">a</td><td>b<table><tr><td>inner</td></tr></table></td><td>c</td></tr><tr><td>d</td><td>e</td></tr>
    <tr><td colspan="x">f</td><td rowspan="9">g</td></tr></table></div>"""
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    got = rows(pages.html_rows(df, keep=["page_id"]).select("table_no", "row_no", "col_no", "cell", "head"), "table_no", "row_no", "col_no")
    assert [g[:4] for g in got] == [
        (1, 1, 1, "Head"), (1, 1, 2, "Head"), (1, 1, 3, "C"), (1, 2, 1, "a"), (1, 2, 2, "b"), (1, 2, 3, "c"),
        (1, 3, 1, "a"), (1, 3, 2, "d"), (1, 3, 3, "e"), (1, 4, 1, "f"), (1, 4, 2, "g"), (2, 1, 1, "inner"),
    ]
    assert {g[0]: g[4] for g in got} == {1: "Head", 2: None}


def test_cells_leave_in_pieces(spark):
    page = "<table>" + "<tr><td>x</td><td>y</td></tr>" * 7000 + "</table>"
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    got = pages.html_rows(df, keep=["page_id"], within="").agg(F.count("*").alias("n"), F.max("row_no").alias("r")).first()
    assert (got.n, got.r) == (14000, 7000)


def test_two_pages_of_a_season_stay_apart(spark):
    def page(number, match):
        head = f"<tr><th>Runde {number}</th><th></th><th></th></tr>" if number else "<tr><td>Man</td><td>1</td><td>EEE-FFF</td></tr>"
        return f"<div id='content'><table>{head}<tr><td>Søn</td><td>1</td><td>{match}</td></tr></table></div>"

    df = spark.createDataFrame([(2002, 1, page(1, "AAA-BBB")), (2002, 2, page(9, "CCC-DDD")), (2002, 3, page(0, "GGG-HHH"))], "season int, p int, html string")
    got = rows(matches_from_pages(df, page="p").select("page", "runde_nr", "kamp", "row_no"), "page", "row_no")
    assert got == [(1, 1.0, "AAA-BBB", 2), (2, 9.0, "CCC-DDD", 2), (3, None, "EEE-FFF", 1), (3, None, "GGG-HHH", 2)]
    assert matches_from_pages(df).count() == 4


def test_a_page_of_elements_left_open_takes_linear_time():
    reader = pages._Cells("", "table", "tr", ("td",))
    began = time.perf_counter()
    reader.feed("<table><tr>" + "<i>" * 40_000 + "<td>x</b></td>" * 40_000)
    reader.close()
    reader.finish()
    assert time.perf_counter() - began < 10 and len(list(reader.rows())) == 40_000
