"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from tessera.plans import document_queries, operator_queries, queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{driver.SMALLEST}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.ORACLES)
def test_same_as_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, driver.SMALLEST).toPandas(), duck.sql(queries.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = [df[columns].astype(str).sort_values(columns).values.tolist() for df in (ours, theirs)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, driver.SMALLEST).limit(1).count() == 1


def test_entry_has_both_routes(spark):
    assert {r["kind"] for r in driver.entry(spark).collect()} == {"chunk", "wiki"}


def test_top_k_plan_needs_no_full_sort(spark):
    df = queries.single_route_search(spark, driver.SMALLEST)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = queries.log_page(spark, driver.SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(event_id" in plan
