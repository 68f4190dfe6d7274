"""Registered queries against their DuckDB twins; HEREDIUM_ALL=1 runs every one, otherwise a spread of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from heredium.tables import BASE
from tools.check_oracle import rows as normal
from tests.conftest import SF

ORACLE = entry.oracle_sql()
NAMES = sorted(ORACLE) if os.environ.get("HEREDIUM_ALL") else sorted(ORACLE)[::7]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_registry_names():
    assert set(ORACLE) <= set(entry.queries())
    assert len(ORACLE) > 200


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    assert normal(df.columns, df.collect()) == normal([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    got = entry.entry(spark).collect()
    assert len(got) == 4 and {"child_id", "n_denovo", "n_lof"} <= set(got[0].asDict())
