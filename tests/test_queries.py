"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from gistmill import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    show = lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), db.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 and plain(got) == plain(want)


@pytest.mark.parametrize("name", ["json_lift_deep", "json_lift_keys"])
def test_deep_arrays_equal_sql_below_zero(spark, tmp_path, name):
    """Users on both sides of zero, with ids beyond a million."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (event_id + 5999500 AS event_id, user_id - 7 AS user_id) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = catalogue.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert len(got) > 0 and plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() > 0 and "saved_bytes" in found.columns
    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_shared_plan_equals_row_plan(spark):
    from pyspark.sql import functions as F

    from gistmill.plans.engine import Engine
    from gistmill.sources import fixtures

    made = fixtures.log_bodies(spark, SF)
    one = {tuple(r) for r in Engine(spark).apply(made).select("request_id", "blocks", F.sha2("body", 256)).collect()}
    assert one == {tuple(r) for r in catalogue.queries()["shared_plan"](spark, SF).collect()}
