"""Session settings and the two helpers that touch storage shared by executors."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE plans joins from measured sizes, splits skewed join partitions and merges
# small shuffle partitions; UTC keeps stored timestamps free of a local zone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "gatecast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Python workers find this package where the driver does; on a cluster it has to be installed there or shipped.
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for key, value in {**SETTINGS, "spark.executorEnv.PYTHONPATH": here, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# What trials found out about folders: empty if all is well, else what went wrong; by application and folder.
_trials: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``gatecast.folder`` if set, else Spark's checkpoint folder, else the warehouse.

    A path without a scheme means the cluster's default file system. Executors that each write to a disk of
    their own lose rows without an error, so where executors run apart from the driver a folder is tried once
    per application, and one that fails is never used: a local path is right if all machines mount it. Only
    where the session names no folder and runs in one process (tests) a new temporary folder is made and
    remembered in the session.
    """
    context, chosen = spark.sparkContext, spark.conf.get("gatecast.folder", None)
    folder = chosen or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if re.match(r"local(\[|$)", context.master):
        if not folder:
            folder = tempfile.mkdtemp(prefix="gatecast-")
            spark.conf.set("gatecast.folder", folder)
        return folder.rstrip("/")
    faults = []
    for place in [chosen] if chosen else filter(None, [folder, spark.conf.get("spark.sql.warehouse.dir", None)]):
        place = place.rstrip("/")
        key = (context.applicationId, place)
        if key not in _trials:
            _trials[key] = _trial(spark, place)
        if not _trials[key]:
            return place
        faults.append(f"{place}: {_trials[key]}")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors reach; " + "; ".join(faults))


def _trial(spark: SparkSession, folder: str) -> str:
    """Empty if all rows that tasks write below ``folder`` come back, else what went wrong."""
    path = f"{folder}/gatecast/trial-{uuid.uuid4().hex}"
    tasks = 2 * spark.sparkContext.defaultParallelism
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        found = spark.read.schema("id long").parquet(path).count()
        fault = "" if found == tasks else f"{found} of {tasks} rows came back"
    except Exception as error:
        fault = f"{type(error).__name__} {str(error)[:300]}"
    with contextlib.suppress(Exception):
        remove_paths(spark, [path])
    return fault


# Paths made in the shared folder, by application, in order. Each thread has its own, so queries that run side by side
# never remove each other's stages.
_made = threading.local()


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder."""
    path = f"{shared_folder(spark)}/gatecast/{label}-{uuid.uuid4().hex}"
    made_paths(spark).append(path)
    return path


def made_paths(spark: SparkSession) -> list[str]:
    """The paths that ``new_path`` gave out to this thread in this application and that have not been removed."""
    return _made.__dict__.setdefault(spark.sparkContext.applicationId, [])


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored stages that nothing reads any more, in whatever file system they are."""
    made = made_paths(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        if path in made:
            made.remove(path)


def remove_since(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Delete the stages made after the first ``mark`` ones, but for the last ``keep``."""
    made = made_paths(spark)
    remove_paths(spark, made[mark : len(made) - keep])


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, fixes values that depend on how Spark spread the rows, and
    survives lost executors. Parquet keeps column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
