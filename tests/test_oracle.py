"""Every query with SQL must give the SQL's rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import TESTDATA
from oracle import compare, duck

# The smallest tables repeat a row key; queries that rank by it use the next scale.
UNIQUE_KEYS = {"stratified_split", "split_counts", "bootstrap_rows", "jitter", "generate_synthetic",
               "attribution_check", "scoring_stream", "extreme_examples"}
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duckdb_at():
    cons = {}
    return lambda sf_dir: cons.setdefault(sf_dir, duck(sf_dir))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duckdb_at, name):
    sf_dir = f"{TESTDATA}/sf{'0.01' if name in UNIQUE_KEYS else '0.001'}"
    assert compare(spark, duckdb_at(sf_dir), sf_dir, name, queries()[name], SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_tune_leaves_static_and_given_settings_alone(spark):
    from flowmill.session import SETTINGS, tune

    other = spark.newSession()
    tune(other)
    assert other.conf.get("spark.sql.codegen.hugeMethodLimit") == SETTINGS["spark.sql.codegen.hugeMethodLimit"]
