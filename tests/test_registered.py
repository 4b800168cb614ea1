"""Every registered query against its SQL twin at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from check import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES.split():
        if Path(f"{SF_DIR}/{table}.parquet").exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(E.queries()))
def test_query(spark, db, name):
    assert compare(spark, db, name, SF_DIR).startswith(("ok", "rows only"))


def test_entry(spark):
    assert {r["outcome"] for r in E.entry(spark).collect()} >= {"invalid", "exact_hit", "miss"}
