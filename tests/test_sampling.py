import pytest
from pyspark.sql import functions as F

from gatecast.operators import sampling


@pytest.mark.parametrize("n", [1, 2, 10, 101, 1000])
@pytest.mark.parametrize("edge_rows", [20_000, 1])
def test_split_sizes_are_exact(spark, n, edge_rows):
    df = sampling.split_exact(spark.range(n), ["id"], 0.7, 2, edge_rows=edge_rows)
    assert df.where("is_train").count() == int(0.7 * n)
    assert df.count() == n


def test_split_does_not_depend_on_buckets_or_order(spark):
    take = lambda df, e: {r.id for r in sampling.split_exact(df, ["id"], edge_rows=e).where("is_train").collect()}
    df = spark.range(9000)
    assert take(df, 20_000) == take(df.repartition(7).orderBy(F.rand(3)), 1)


def test_split_follows_the_hash_order(spark):
    df = sampling.split_exact(spark.range(300), ["id"], 0.5)
    by_hash = [r.id for r in sampling.with_hash(spark.range(300), ["id"], 2).orderBy("_hash").collect()]
    assert {r.id for r in df.where("is_train").collect()} == set(by_hash[:150])


def test_labels_need_no_shuffle(spark):
    split = sampling.split_exact(spark.range(1000), ["id"])
    folds = sampling.balanced_folds(spark.range(1000), ["id"])
    parts = sampling.split_and_folds(spark.range(1000), ["id"], name="_part")
    for df in (split, folds, parts):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_seed_changes_the_split(spark):
    take = lambda seed: {r.id for r in sampling.split_exact(spark.range(500), ["id"], seed=seed).where("is_train").collect()}
    assert take(2) != take(3)


@pytest.mark.parametrize("n,edge_rows", [(95, 20_000), (3, 20_000), (10_003, 1), (10_003, 20_000)])
def test_folds_are_balanced(spark, n, edge_rows):
    folds = sampling.balanced_folds(spark.range(n), ["id"], 10, edge_rows=edge_rows)
    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert sizes == {f: n // 10 + (f <= n % 10) for f in range(1, 11) if n // 10 + (f <= n % 10)}


@pytest.mark.parametrize("edge_rows", [20_000, 5])
def test_folds_are_runs_of_the_hash_order(spark, edge_rows):
    got = {r.id: r.fold for r in sampling.balanced_folds(spark.range(97), ["id"], 4, edge_rows=edge_rows).collect()}
    by_hash = [r.id for r in sampling.with_hash(spark.range(97), ["id"], 2).orderBy("_hash").collect()]
    assert [got[i] for i in by_hash] == sorted(got.values())


def test_repeated_keys_are_refused(spark):
    for n in (3, 40_000):
        with pytest.raises(ValueError, match="not unique"):
            sampling.split_exact(spark.range(n).select(F.lit(1).alias("id")), ["id"])


def test_parts(spark):
    parts = sampling.split_and_folds(spark.range(1000), ["id"], name="_part")
    sizes = {r._part: r["count"] for r in parts.groupBy("_part").count().collect()}
    assert sizes[0] == 300 and sorted(sizes) == list(range(11)) and all(sizes[f] == 70 for f in range(1, 11))


def test_all_borders_are_refined_in_one_pass_per_level(spark, monkeypatch):
    passes = []
    counts = sampling._counts
    monkeypatch.setattr(sampling, "_counts", lambda *a: passes.append(a[1:]) or counts(*a))
    df = spark.range(40_000)
    got = sampling.balanced_folds(df, ["id"], folds=10, edge_rows=4)
    assert len(passes) <= 3
    sizes = {r["fold"]: r["count"] for r in got.groupBy("fold").count().collect()}
    assert sizes == {f: 4000 for f in range(1, 11)}
