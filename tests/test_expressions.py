import datetime as dt

import pytest
from pyspark.sql import functions as F

from gatecast.functions import cases, dates, text
from gatecast.operators import columns, filters
from tests.conftest import rows


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", dt.datetime: "timestamp", dt.date: "date"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("compat,want", [("number", "vundet"), ("text", "tabt")])
def test_score_compared_as_number_or_text(spark, compat, want):
    assert one(spark, cases.result_class(F.col("h"), F.col("a"), F.lit(True), compat), h="10", a="9") == want


@pytest.mark.parametrize(
    "h,a,home,want",
    [("2", "1", True, "vundet"), ("2", "1", False, "tabt"), ("0", "3", True, "tabt"), ("0", "3", False, "vundet"),
     ("1", "1", True, "uafgjort"), ("1", "1", False, "uafgjort"), (None, "1", True, None), ("Optakt", None, True, None)],
)
def test_result_class(spark, h, a, home, want):
    result = cases.result_class(F.col("h"), F.col("a"), F.col("home"))
    assert one(spark, result, h=h, a=a, home=home) == want


@pytest.mark.parametrize("result,want", [("vundet", 3.0), ("uafgjort", 1.0), ("tabt", 0.0), (None, None), ("?", None)])
def test_points(spark, result, want):
    assert one(spark, cases.points(F.col("r")), r=result) == want


@pytest.mark.parametrize(
    "day,week", [("2021-01-01", 1), ("2021-01-07", 1), ("2021-01-08", 2), ("2024-12-31", 53), ("2024-02-18", 7)]
)
def test_week_counts_from_new_year(spark, day, week):
    assert one(spark, dates.week_of_year_simple(F.col("d")), d=dt.date.fromisoformat(day)) == week


def test_like_ignores_case(spark):
    assert one(spark, filters.like_any_case(F.col("k"), "%HFC-%"), k="hfc-ANK") is True
    assert one(spark, F.col("k").like("%HFC-%"), k="hfc-ANK") is False


def test_lenient_split(spark):
    df = spark.createDataFrame([("2-1",), ("Optakt",), ("1-2-3",), (None,)], "resultat string")
    out = text.split_lenient(df, "resultat", ["h", "u"])
    got = {r.resultat: (r.h, r.u, r.resultat_ok, r.resultat_pieces, r.resultat_remainder) for r in out.collect()}
    assert got["2-1"] == ("2", "1", True, 2, "")
    assert got["Optakt"] == ("Optakt", None, False, 1, "")
    assert got["1-2-3"] == ("1", "2", False, 3, "-3")
    assert got[None][0] is None and got[None][1] is None


def test_strict_split_fails_on_other_counts(spark):
    df = spark.createDataFrame([("HFC-ANK",)], "kamp string")
    out = text.split_strict(df, "kamp", ["h", "u"])
    assert out.columns == ["h", "u"] and tuple(out.first()) == ("HFC", "ANK")
    bad = spark.createDataFrame([("HFC",)], "kamp string")
    with pytest.raises(Exception, match="expected 2 parts"):
        text.split_strict(bad, "kamp", ["h", "u"]).collect()


@pytest.mark.parametrize("x,want", [(2.5, 2.0), (3.5, 4.0), (2.51, 3.0), (-2.5, -2.0)])
def test_halves_go_to_even(spark, x, want):
    assert one(spark, text.round_even(F.col("x")), x=x) == want


def test_labels(spark):
    assert one(spark, text.format_label(F.col("x"), " tilskuere"), x=2.5) == "2 tilskuere"
    assert one(spark, text.format_label(F.col("x"), big_mark=True), x=1234567.0) == "1.234.567"


@pytest.mark.parametrize(
    "t,want", [("runde_7", 7.0), ("x", None), ("1,234.5 kr", 1234.5), ("-3 grader", -3.0), (None, None), ("a12b7", 12.0)]
)
def test_parse_number(spark, t, want):
    assert one(spark, text.parse_number(F.col("t")), t=t) == want


@pytest.mark.parametrize("t,want", [("5.123", 5123.0), ("987", 987.0), ("1.234.567", 1234567.0), ("-", None)])
def test_parse_grouped_number(spark, t, want):
    assert one(spark, text.parse_grouped_number(F.col("t")), t=t) == want


def test_paste_writes_nulls(spark):
    assert one(spark, text.paste(F.col("a"), F.col("b")), a="x", b=None) == "x NA"
    assert one(spark, text.paste(F.col("a"), F.col("b"), na=None), a="x", b=None) is None
    assert one(spark, text.paste(F.col("a"), F.col("b"), sep="T", na=None), a="x", b="y") == "xTy"


@pytest.mark.parametrize("d,want", [("30/06 18:00", 2005), ("01/07 18:00", 2004), ("31/12 14:00", 2004), ("07/01 14:00", 2005)])
def test_season_to_year(spark, d, want):
    assert one(spark, dates.season_to_year(F.col("s"), F.col("d")), s="2005", d=d) == want


@pytest.mark.parametrize("local,utc", [("21/07 18:00", "2024-07-21T16:00:00Z"), ("21/02 18:35", "2024-02-21T17:35:00Z")])
def test_local_time_to_utc(spark, local, utc):
    parsed = dates.parse_local_ts(F.lit(2024), F.col("d"))
    assert one(spark, dates.iso_key(dates.to_utc(parsed)), d=local) == utc


def test_unreadable_time_is_null(spark):
    assert one(spark, dates.parse_local_ts(F.lit(2024), F.col("d")), d="?") is None


@pytest.mark.parametrize(
    "hour,want",
    [(9, None), (10, "middag"), (14, "middag"), (15, "eftermiddag"), (17, "eftermiddag"), (18, "aften"), (23, "aften")],
)
def test_day_part(spark, hour, want):
    assert one(spark, dates.day_part(F.col("t")), t=dt.datetime(2024, 5, 5, hour, 30)) == want


@pytest.mark.parametrize(
    "day,want", [("06-25", 0), ("06-26", 1), ("06-30", 1), ("07-31", 1), ("08-12", 1), ("08-13", 0), ("05-28", 0)]
)
def test_holiday_season(spark, day, want):
    assert one(spark, dates.holiday_season_flag(F.col("d")), d=dt.date.fromisoformat(f"2024-{day}")) == want


def test_threshold_skips_text_that_is_no_number(spark):
    df = spark.createDataFrame([("2003",), ("2002",), ("x",), (None,)], "s string")
    assert rows(df.where(filters.at_least(F.col("s"), 2003)), "s") == [("2003",)]


def test_played(spark):
    df = spark.createDataFrame([("2-1",), ("Optakt",), (None,)], "s string")
    assert rows(df.where(filters.played(F.col("s"), "Optakt")), "s") == [("2-1",)]


@pytest.mark.parametrize(
    "name,want",
    [("parameterId", "parameter_id"), ("Sæson År", "saeson_ar"), ("Balance %", "balance_percent"), ("2002 mål", "x2002_mal"),
     ("Møde", "mode"), ("Dato/tid", "dato_tid"), ("HTMLTable", "html_table")],
)
def test_snake(name, want):
    assert columns.snake(name) == want


def test_clean_names_numbers_repeats(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["A b", "a-b", "c"])
    assert columns.clean_names(df).columns == ["a_b", "a_b_2", "c"]


def test_placing_and_dropping(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a", "b", "c", "d"])
    assert columns.derive(df, after="a", x=F.col("b") + 1, y=F.col("x") + 1).columns == ["a", "x", "y", "b", "c", "d"]
    assert columns.drop_range(df, "b", "c").columns == ["a", "d"]
    with pytest.raises(ValueError):
        columns.drop(df, "nope")
    with pytest.raises(ValueError):
        columns.rename_positional(df, ["x"])
