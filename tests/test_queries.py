"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.derived import Inputs
from checks.registry import BUILDS, SQL
from tools.compare import BASE, compare
from wayreach.functions.scratch import Scratch

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in BASE:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module")
def inputs(spark):
    """One set of derived tables for all queries; those used most are written once."""
    shared, scratch = Inputs(spark, SF_DIR), Scratch(spark, "test-inputs")
    for name in "routes trips stop_times links footpaths sources near_buildings".split():
        shared._made[name] = scratch.keep(getattr(shared, name), name)
    return shared


@pytest.mark.parametrize("name", BUILDS)
def test_query(spark, con, inputs, name):
    def query(_spark, _sf_dir):
        return BUILDS[name](inputs)

    text, _seconds, ok = compare(spark, con, SF_DIR, name, query, entry.oracle_sql().get(name))
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["star", "bin", "bound_s", "nbldg", "jobs"] and df.count() > 0


def test_every_query_has_sql():
    assert BUILDS.keys() == SQL.keys() and BUILDS.keys() <= entry.queries().keys()


def test_walks_reverse_has_both_rounds(inputs):
    rounds = BUILDS["p10_walks_reverse"](inputs).groupBy("k").count().collect()
    assert {r["k"] for r in rounds if r["count"]} == {1, 2}
