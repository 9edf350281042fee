import random

import pytest
from pyspark.sql import functions as F

from gatecast.operators import hotgroups, incremental
from gatecast.operators import windows as win
from gatecast.operators.windows import (
    Lag, RollingSum, RunningSum, add_history, lag_value, last_meeting, rolling_sum, running_sum, running_sum_lagged,
)
from tests.conftest import rows

T = {"team": "team", "order": ["seq"]}


def history(spark, values, shuffle=False):
    data = [("A", 2000 + i // 3, i, v) for i, v in enumerate(values)]
    if shuffle:
        random.Random(1).shuffle(data)
    return spark.createDataFrame(data, "team string, season int, seq int, x double")


def test_lag_ignores_storage_order(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0]
    want = [(0, None), (1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]
    for shuffle in (False, True):
        out = lag_value(history(spark, values, shuffle), "x", "l", **T)
        assert rows(out.select("seq", "l"), "seq") == want


def test_rolling_and_running_turn_null(spark):
    df = history(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0]).withColumn("season", F.lit(1))
    out = rolling_sum(df, "x", "r", **T)
    assert [r.r for r in out.orderBy("seq").collect()] == [None] * 5 + [15.0]
    out = running_sum(df, "x", "s", season="season", **T)
    assert [r.s for r in out.orderBy("seq").collect()] == [1.0, 3.0, None, None, None, None]


def test_lagged_rolling_is_rolling_one_row_earlier(spark):
    df = history(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    out = rolling_sum(df, "x", "r", shift=1, **T)
    assert [r.r for r in out.orderBy("seq").collect()] == [None, None, None, 6.0, 9.0]


def test_running_lag_crosses_seasons_unless_reset(spark):
    df = history(spark, [1.0, 1.0, 1.0, 3.0, 3.0, 3.0])
    out = running_sum_lagged(df, "x", "s", season="season", **T)
    assert [r.s for r in out.orderBy("seq").collect()] == [None, 1.0, 2.0, 3.0, 3.0, 6.0]
    out = running_sum_lagged(df, "x", "s", season="season", reset=True, **T)
    assert [r.s for r in out.orderBy("seq").collect()] == [None, 1.0, 2.0, None, 3.0, 6.0]
    assert "_s_total" not in out.columns


def test_last_meeting(spark):
    data = [("A", i, f, float(i)) for i, f in enumerate(["A-B", "A-C", "B-A", "A-B", "A-C"])]
    df = spark.createDataFrame(data, "team string, seq int, fixture string, x double")
    out = last_meeting(df, "x", "m", against="fixture", **T)
    assert [r.m for r in out.orderBy("seq").collect()] == [None, None, None, 0.0, 1.0]


FEATURES = (
    {
        "l1": Lag("x"),
        "l4": Lag("label", 4),
        "r3": RollingSum("x"),
        "r3l": RollingSum("x", shift=1),
        "r5": RollingSum("y", 5),
        "run": RunningSum("y", ("season",)),
        "runx": RunningSum("x", ("season",)),
        "all": RunningSum("y"),
        "met": Lag("x", within=("opponent",)),
    },
    {"runl": Lag("run"), "r3ll": Lag("r3")},
)


@pytest.fixture(scope="module")
def skewed(spark):
    """One team with a third of the rows, another that is null, many small ones; ties in the first order column."""
    rng = random.Random(7)
    data = []
    for i in range(1500):
        team = "hot" if i % 3 == 0 else None if i % 3 == 1 and i < 700 else f"t{rng.randrange(60)}"
        x = None if rng.random() < 0.05 else float(rng.randrange(9))
        data.append((team, rng.choice("abcd"), 2000 + i // 400, i // 50, i, x, float(i % 7), rng.choice(["w", None, "l"])))
    rng.shuffle(data)
    return spark.createDataFrame(
        data, "team string, opponent string, season int, day int, seq int, x double, y double, label string"
    ).cache()


@pytest.mark.parametrize("hot_rows", [400, 60, 7])
def test_chunks_give_the_plain_result(spark, skewed, hot_rows):
    order = {"team": "team", "order": ["day", "seq"]}
    plain = add_history(skewed, *FEATURES, hot_rows=None, **order)
    chunked = add_history(skewed, *FEATURES, hot_rows=hot_rows, **order)
    assert plain.columns == chunked.columns
    assert rows(plain, "seq") == rows(chunked, "seq")


def test_hot_groups_are_really_split(spark, skewed):
    cold, chunked = hotgroups.split_hot_groups(skewed, ["team"], ["day", "seq"], 60)
    sizes = chunked.groupBy("team", hotgroups.CHUNK).count()
    assert {r.team for r in sizes.select("team").distinct().collect()} >= {"hot", None}
    assert sizes.agg(F.max("count")).first()[0] <= 240
    assert cold.count() + chunked.count() == skewed.count()
    assert cold.where(F.col("team") == "hot").count() == 0


def test_default_size_bounds_the_rows_of_a_task(spark):
    """A team of 600,000 rows is worked in chunks without being asked for, with the plain results."""
    one = spark.range(0, 600_000, 1, 4).select(F.lit("t").alias("team"), (F.col("id") * 7 % 600_000).alias("seq"), (F.col("id") % 5).cast("double").alias("v"))
    _, chunked = hotgroups.split_hot_groups(one, ["team"], ["seq"])
    assert chunked is not None and chunked.groupBy(hotgroups.CHUNK).count().agg(F.max("count")).first()[0] < 500_000
    features = {"before": win.Lag("v"), "three": win.RollingSum("v"), "all": win.RunningSum("v")}
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("seq", "before", "three", "all").cast("decimal(38,0)"))).first()
    assert digest(win.add_history(one, features, team="team", order=["seq"])) == digest(win.add_history(one, features, team="team", order=["seq"], hot_rows=None))


def test_no_split_without_hot_groups(spark, skewed):
    cold, chunked = hotgroups.split_hot_groups(skewed, ["team"], ["seq"], 10_000)
    assert chunked is None and cold is skewed


def test_one_exchange_serves_all_features(spark, skewed):
    plain = add_history(skewed.select("*"), *FEATURES, team="team", order=["seq"], hot_rows=None)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_new_rows_from_a_stored_state_equal_the_whole_history(spark, tmp_path):
    rng = random.Random(9)
    data = [(rng.choice(["a", "b", None]), day, rng.choice([None, 1.0, 2.0, 5.0, 8.0]), rng.choice("xy"), day // 40) for day in range(160)]
    table = spark.createDataFrame(data, "team string, day int, v double, other string, season int")
    stages = (
        {"l2": win.Lag("v", 2), "r": win.RollingSum("v", 3, 1), "s": win.RunningSum("v", ("season",)), "all": win.RunningSum("v"), "met": win.Lag("v", within=("other",))},
        {"s_before": win.Lag("s")},
    )
    names = {"team": "team", "order": ["day"]}
    key = lambda rows: sorted((str(tuple(r)) for r in rows))
    want = key(win.add_history(table, *stages, **names).collect())
    for borders in ([0, 60, 61, 130, 160], [0, 160], [0, 80, 100, 160]):
        path, got = f"{tmp_path}/state{len(borders)}{borders[1]}", []
        for a, b in zip(borders, borders[1:]):
            new = table.where(f"day >= {a} AND day < {b}")
            got += incremental.update_history(new, *stages, path=path, **names).collect()
            assert incremental.latest_version(spark, path) >= 1
        assert key(got) == want
    with pytest.raises(ValueError, match="come before"):
        incremental.update_history(table.where("day = 70"), *stages, path=path, **names)
    assert incremental.update_history(table.where("day < 0"), *stages, path=path, **names).count() == 0
