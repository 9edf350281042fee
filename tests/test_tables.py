import pytest
from pyspark.sql import functions as F

from gatecast.functions.labels import RARE_OPPONENTS
from gatecast.operators import aggregates as agg
from gatecast.operators import categorical as cat
from gatecast.operators import filters, joins, reshape
from gatecast.operators.impute import impute_group_mean
from tests.conftest import rows


def test_group_mean_is_null_with_a_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", None), (None, 7.0)], "k string, x double")
    out = agg.group_mean_broadcast(df, ["k"], "x", "m")
    assert rows(out, "k", "x") == [(None, 7.0, 7.0), ("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", None, None), ("b", 5.0, None)]
    out = agg.group_mean_broadcast(df, ["k"], "x", "m", na="skip")
    assert [r.m for r in out.where("k = 'b'").collect()] == [5.0, 5.0]


def test_summary_joins_the_same_with_and_without_broadcast(spark):
    df = spark.range(100).withColumn("k", F.when(F.col("id") > 5, F.col("id") % 7))
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    small = rows(agg.attach_summary(df, counts, ["k"]), "id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        large = agg.attach_summary(df, counts, ["k"])
        assert "Broadcast" not in large._jdf.queryExecution().executedPlan().toString()
        assert rows(large, "id") == small and len(small) == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_impute_bands_are_strict(spark):
    data = [(1, None, 3999.0), (2, None, 4000.0), (3, None, 4001.0), (4, 77.0, 3000.0), (5, None, 2001.0)]
    df = spark.createDataFrame(data, "id int, met double, att double")
    out = impute_group_mean(df, "met", "att")
    assert out.columns == df.columns
    assert rows(out.select("id", "met"), "id") == [(1, 3000.0), (2, None), (3, 4001.0), (4, 77.0), (5, 3000.0)]


def test_fold_mean_leaves_out_sizes_missing_in_a_fold(spark):
    data = [(f, s, float(s)) for f in (1, 2, 3) for s in (1, 2, 3) if not (f == 2 and s == 1)]
    out = agg.fold_mean(spark.createDataFrame(data, "fold int, size int, mse double"), ["size"], "mse", 3)
    assert rows(out, "size") == [(2, 2.0), (3, 3.0)]


def test_arg_min_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("h", "Ridge", 2.0), ("h", "Full Linear", 2.0), ("h", "Lasso", None)], "h string, m string, v double")
    best = reshape.top1_per_group(df, ["h"], "m", "v", ["Full Linear", "Ridge", "Lasso"])
    assert rows(best, "h") == [("h", "Full Linear", 2.0)]
    assert rows(agg.arg_min(df, ["h"], "m", "v"), "h") == [("h", "Full Linear", 2.0)]


def test_one_standard_error(spark):
    data = [(lam, f, 10.0, m) for lam, ms in {3.0: (4, 6), 2.0: (3, 5), 1.0: (2.5, 5)}.items() for f, m in enumerate(ms)]
    df = spark.createDataFrame([("x", *d[:3], float(d[3])) for d in data], "g string, lambda double, fold int, n double, mse double")
    cv = agg.cv_summary(df, ["g", "lambda"])
    got = {r["lambda"]: (r.cvm, r.cvsd) for r in cv.collect()}
    assert got[3.0] == (5.0, 1.0) and got[1.0] == (3.75, 1.25)
    best = agg.one_se(cv, ["g"]).first()
    assert (best.lambda_min, best.lambda_1se) == (1.0, 3.0)


LEFT = [(1, "2024-01-01"), (2, "2024-01-02"), (3, None)]


def sides(spark, holidays):
    return spark.createDataFrame(LEFT, "id int, day string"), spark.createDataFrame(holidays, "dato string, navn string")


def test_two_holidays_on_one_date(spark):
    left, right = sides(spark, [("2024-01-01", "b"), ("2024-01-01", "a"), (None, "n")])
    both = joins.left_join_date(left, right, "day", "dato", ["navn"])
    assert rows(both.select("id", "navn"), "id", "navn") == [(1, "a"), (1, "b"), (2, None), (3, None)]
    first = joins.left_join_date(left, right, "day", "dato", ["navn"], expect="first")
    assert rows(first.select("id", "navn"), "id") == [(1, "a"), (2, None), (3, None)]
    with pytest.raises(Exception, match="repeated key"):
        joins.left_join_date(left, right, "day", "dato", ["navn"], expect="one").collect()


def test_expect_one_passes_when_unique(spark):
    left, right = sides(spark, [("2024-01-01", "a"), (None, "x"), (None, "y")])
    out = joins.left_join_date(left, right, "day", "dato", ["navn"], expect="one")
    assert rows(out.select("id", "navn"), "id") == [(1, "a"), (2, None), (3, None)]


def test_join_of_frames_with_one_origin(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    out = joins.left_join(df, df.withColumn("c", F.col("a") * 10), {"b": "a"}, ["c"])
    assert rows(out, "a") == [(1, 2, 20), (2, 3, 30), (3, 1, 10)]


def test_star_filter_moves_below_the_joins(spark, tmp_path):
    left, right = sides(spark, [("2024-01-01", "a")])
    left.write.parquet(str(tmp_path / "l"))
    stored = spark.read.parquet(str(tmp_path / "l"))
    out = joins.enrich_star(stored, (right, {"day": "dato"}, ["navn"]), where=F.col("id") > 1)
    assert "GreaterThan(id,1)" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 2


def test_a_hot_key_is_split_by_the_join(spark):
    """A third of the left rows share one key: the left join works that partition in several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "12",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(0, 240_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("k"))
        right = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
        out = joins.left_join(left, right, {"k": "key"}, ["v"])
        assert out.where(F.col("v") != F.col("k") * 2).count() == 0
        got = out.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
        total = left.agg(F.sum(F.col("k") * 2)).first()[0]
        assert tuple(got.collect()[0]) == (240_000, total)
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_keyed_lookup_does_not_multiply(spark):
    obs = spark.createDataFrame([("h1", 1), ("h2", 2)], "observed string, v int")
    wanted = spark.createDataFrame([("h1",), ("h1",), (None,)], "k string")
    assert rows(joins.keyed_lookup(obs, wanted, "observed", "k"), "v") == [("h1", 1)]


def test_pivot_checks_for_repeated_cells(spark):
    long = [("t", "a", 1.0), ("t", "b", 2.0), ("u", "a", 3.0), ("u", "z", 9.0)]
    df = spark.createDataFrame(long, "t string, p string, v double")
    assert rows(reshape.pivot_wider(df, ["t"], "p", "v", ["a", "b"]), "t") == [("t", 1.0, 2.0), ("u", 3.0, None)]
    twice = df.union(spark.createDataFrame([("t", "a", 5.0)], df.schema))
    with pytest.raises(Exception, match="more than one value for a"):
        reshape.pivot_wider(twice, ["t"], "p", "v", ["a", "b"]).collect()
    assert reshape.pivot_wider(twice, ["t"], "p", "v", ["a"], check=False).where("t = 't'").first()["a"] == 5.0


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "id int, kamp string")
    b = spark.createDataFrame([(7, 2)], "kamp int, id int")
    assert rows(reshape.union_with_type_repair(a, b, kamp="string"), "id") == [(1, "x"), (2, "7")]
    c = spark.createDataFrame([(3,)], "id int")
    assert rows(reshape.union_by_name(a, c), "id") == [(1, "x"), (3, None)]


def test_level_order(spark):
    df = spark.createDataFrame([("dag3",), ("måned1",), ("?",), ("dag10",)], "h string")
    assert [r.h for r in reshape.order_by_level(df, "h", ["måned1", "dag10", "dag7", "dag3"]).collect()] == ["måned1", "dag10", "dag3", "?"]


def test_lump_and_align(spark):
    df = spark.createDataFrame([("ANK",), ("ANK",), ("BYN",), (None,)], "m string")
    assert rows(cat.lump_rare(df, "m", 2, RARE_OPPONENTS), "m") == [(None,), ("ANK",), ("ANK",), ("andre_hold",)]
    out = cat.align_levels(df, {"m": ["BYN"]})
    assert rows(out, "m") == [(None,), (None,), (None,), ("BYN",)]


def test_pairs_and_complement(spark):
    df = spark.createDataFrame([("Ridge", "a"), ("Ridge", "b"), ("Lasso", "b")], "m string, h string")
    assert rows(df.where(filters.any_pair([("Ridge", "a"), ("Lasso", "b")], F.col("m"), F.col("h"))), "m") == [("Lasso", "b"), ("Ridge", "a")]
    assert rows(filters.complement(df, df.where("h = 'b'"), ["m", "h"]), "m") == [("Ridge", "a")]


def test_levels_beyond_a_thousand_are_all_known(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("c"))
    levels = df.where("cast(c AS int) < 2500").select(F.col("c").alias("level"))
    assert cat.align_to_levels(df, "c", levels).agg(F.count("c").alias("n")).first().n == 2500


def test_keyed_lookup_large_gives_the_rows_of_the_plain_lookup(spark):
    rows_of = [(k % 700, k) for k in range(3000)] + [(None, 1), (5, 2), (5, 3)]
    observed = spark.createDataFrame(rows_of, "key int, _word int")
    wanted = spark.createDataFrame([(3 * k,) for k in range(400)] + [(3,), (None,), (1 << 40,)], "id long")
    want = sorted((k, v) for k, v in rows_of if k is not None and k % 3 == 0 and k < 1200)
    for most in (joins.MOST_WORDS, 8):  # with a filter, and without one as it would be too large
        got = joins.keyed_lookup_large(observed, wanted, "key", "id", most)
        assert got.columns == observed.columns
        assert sorted(map(tuple, got.collect())) == want
    assert joins.keyed_lookup_large(observed, wanted.where("id < 0"), "key", "id").count() == 0
    assert joins.keyed_lookup_large(observed.where("key < 0"), wanted, "key", "id").count() == 0


def test_key_filter_passes_all_keys_and_few_others(spark):
    keys, others = spark.range(10_000), spark.range(1_000_000, 1_100_000)
    filtered = joins.key_filter(keys, F.col("id"), 10_000)
    assert joins.may_match(keys, filtered, F.col("id"), 10_000).count() == 10_000
    passed = joins.may_match(others, filtered, F.col("id"), 10_000)
    assert passed.count() < 4_000
    assert "Exchange hashpartitioning(id" not in passed._jdf.queryExecution().executedPlan().toString()


def test_without_keys(spark):
    table = spark.range(2000).withColumn("a.b", F.lit(1)).withColumn("text", F.col("id").cast("string"))
    for most in (joins.MOST_WORDS, 4):
        got = joins.without_keys(table, spark.range(500, 900), "id", most)
        assert got.columns == table.columns
        assert sorted(r.id for r in got.collect()) == [*range(500), *range(900, 2000)]
        assert joins.without_keys(table, spark.range(0), "id", most).count() == 2000
