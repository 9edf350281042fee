"""History features of new rows only: a stored state per team stands for all rows before them.

The state holds, for every group of look-backs, the last rows that they can still see, and for every running sum the sum so far
(null once a value was null). A new season is worked with these in front, by the window expressions of ``add_history``, so its
features are those of a full computation; the history itself is not read. Then the state moves on.

The state is a folder of versions. A version is written whole (some rows per team), and counts once its last table, the latest place
in the order per team, is complete; so a job that dies leaves the version before, and can be run again. Rows must come
after those of their team in the state: others are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatecast.operators.hotgroups import CHUNK, over_chunks
from gatecast.operators.windows import Feature, RunningSum, _passes
from gatecast.session import materialize, remove_paths


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def latest_version(spark: SparkSession, path: str) -> int:
    """The last complete version of a state, 0 if there is none."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return 0
    found = [status.getPath() for status in files.listStatus(place) if status.getPath().getName().startswith("v")]
    done = [int(p.getName()[1:]) for p in found if files.exists(_files(spark, f"{p}/last/_SUCCESS")[1])]
    return max(done, default=0)


def update_history(rows: DataFrame, *stages: dict[str, Feature], team: str | Sequence[str], order: Sequence[str], path: str) -> DataFrame:
    """``rows`` with the named features, from the state in ``path`` (none yet: the rows are the start), which then includes them."""
    spark = rows.sparkSession
    keys, order = [team] if isinstance(team, str) else list(team), list(order)
    version = latest_version(spark, path)
    old, new = f"{path}/v{version}", f"{path}/v{version + 1}"
    now = materialize(rows.withColumn(CHUNK, F.lit(0)), "history-new")
    last = now.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"), F.max(F.struct(*order)).alias("_last"))
    if version:
        before = spark.read.parquet(f"{old}/last")
        same = [before[k].eqNullSafe(last[k]) for k in keys]
        if not last.join(before, same).where(last["_first"] <= before["_last"]).isEmpty():
            raise ValueError("rows come before rows that the state holds: compute the history anew")
        last = last.drop("_first").unionByName(before).groupBy(*keys).agg(F.max("_last").alias("_last"))
    number = 0
    for n, stage in enumerate(stages):
        if n:
            now = materialize(now, "history-stage")
        source = now
        for features, group in _passes(stage, keys):
            number += 1
            label = f"carry-{number}"
            values = list(dict.fromkeys(f.value for f in features.values()))
            running = isinstance(next(iter(features.values())), RunningSum)
            needed = list(dict.fromkeys([*group, *values] if running else [*group, *order, *values]))
            own = source.select(*needed)
            carry = spark.read.parquet(f"{old}/{label}").select(*needed) if version else own.limit(0)
            now = over_chunks(now, carry.withColumn(CHUNK, F.lit(0)), group, order, lambda df, partition, ordering: df.withColumns({name: f.column(partition, ordering) for name, f in features.items()}))
            both = carry.unionByName(own)
            if running:
                total = F.when(F.count(values[0]) == F.count(F.lit(1)), F.sum(values[0])).alias(values[0])
                moved = both.groupBy(*group).agg(total)
            else:
                newest = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
                reach = max(f.reach for f in features.values())
                moved = both.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= reach).drop("_age")
            moved.write.mode("overwrite").parquet(f"{new}/{label}")
    done = materialize(now.select(*rows.columns, *[name for stage in stages for name in stage]), "history-done")
    last.select(*keys, "_last").write.mode("overwrite").parquet(f"{new}/last")
    if version > 1:
        remove_paths(spark, [f"{path}/v{version - 1}"])
    return done
