"""Queries against their SQL on the smallest tables; skipped where there are none."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and not n.startswith("bfs_")]


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return found


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True).fillna(-9) for x in (got, want))
    for c in columns:
        assert (got[c] == want[c]).all(), c


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"))
def test_query_without_sql_labels_everything(spark, name):
    got = entry.queries()[name](spark, SF)
    rows = got.agg(F.count(F.lit(1)), F.count("v"), F.count_distinct("v")).first()
    whole = spark.read.parquet(f"{SF}/orders.parquet").count() if name.endswith("_labels") else rows[0]
    assert 0 < rows[0] == rows[1] == whole and (rows[2] == whole or name == "walked_seeds")


def test_entry(spark):
    assert entry.entry(spark).count() == 500
