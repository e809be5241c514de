"""Every registered query against its DuckDB twin (the driver's gate) at sf 0.001,
and the entry smoke check."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import rows_of  # noqa: E402
from conftest import SF001  # noqa: E402
from storelens.plans import oracle as O  # noqa: E402
from storelens.plans import registry as REG  # noqa: E402
from storelens.sources.tables import TABLES, table_path  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF001, t)}')")
    return c


QUERIES = REG.QUERIES
SQL = O.SQL


def test_entry_registers_all():
    assert set(REG.QUERIES) <= set(E.queries()) and set(O.SQL) <= set(E.oracle_sql())


def test_every_query_has_an_oracle_or_is_listed():
    rows_only = {"extract_pages"}
    assert set(QUERIES) - set(SQL) == rows_only


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    rel = con.sql(SQL[name])
    dcols, drows = rel.columns, rel.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(scols, srows) == rows_of(dcols, drows)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "content_processed" in df.columns and "processed_length" in df.columns


def test_rows_only_query(spark):
    df = QUERIES["extract_pages"](spark, SF001)
    assert df.count() == spark.read.parquet(table_path(SF001, "pages")).count()
