"""Every query with a SQL equivalent, against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries
from tools.check import TABLES, canonical
from touchstone.plans.catalog import QUERIES as CORE

FOLDER = "/root/testdata/sf0.001"
# On the smallest tables these groups fall under the operators' minimum sizes, which their SQL leaves out.
NEED_LARGER = {"auc_permutation", "supervised_metrics", "diagnose"}


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for schema, folder in (("main", FOLDER), ("larger", LARGER)):
        c.execute(f"create schema if not exists {schema}")
        for name in TABLES:
            c.execute(f"create view {schema}.{name} as select * from '{folder}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    larger = name in NEED_LARGER
    con.execute(f"set schema = '{'larger' if larger else 'main'}'")
    got = queries()[name](spark, LARGER if larger else FOLDER).toPandas()
    want = con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


# The corpus operators' own tests run their queries.
@pytest.mark.parametrize("name", sorted(n for n in set(queries()) - set(oracle_sql()) if n in CORE))
def test_without_sql_runs(spark, name):
    """Every other registered query of the library at least runs and has rows."""
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry_and_registry(spark):
    from __spark_entry__ import entry

    assert len(entry(spark).columns) > 5
    assert set(oracle_sql()) <= set(queries())
