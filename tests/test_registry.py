"""Every registered query runs, and gives the rows of its SQL, on the smallest tables."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df):
    """Rows as sorted text, columns in name order."""

    def text(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return "∅"
        if isinstance(v, bool) or str(type(v).__name__) == "bool_":
            return str(bool(v))
        if hasattr(v, "isoformat"):
            return v.isoformat()
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v) + 0.0:.6g}" if not math.isinf(float(v)) else str(v)
        return str(v)

    names = sorted(df.columns)
    return names, sorted(tuple(text(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.fixture(scope="module")
def results(spark):
    """All queries, a few at a time."""
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(lambda fn=fn: fn(spark, SF).toPandas()) for name, fn in QUERIES.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(results, con, name):
    ours = plain(results[name].result())
    theirs = plain(con.execute(SQL[name]).fetchdf())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(results, name):
    assert len(results[name].result()) > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == QUERIES["p5_keep"](spark, SF).count()


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
