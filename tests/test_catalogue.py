"""Every registered query of the ledger against DuckDB on the same tables."""

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlark.plans import catalogue, ingest, measures, reporting, written

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(catalogue.ORACLES[name])
    assert sorted(expected.columns) == columns
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    at = [expected.columns.index(c) for c in columns]
    rows = lambda found: sorted(tuple(map(repr, r)) for r in found)
    assert rows(df.select(columns).collect()) == rows(tuple(r[i] for i in at) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_is_registered():
    """``query(...)`` only makes a decorator: one that stands alone registers nothing."""
    for module in (catalogue, ingest, measures, reporting, written):
        tree = ast.parse(Path(module.__file__).read_text())
        lost = [n.lineno for n in ast.walk(tree) if isinstance(n, ast.Expr) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name) and n.value.func.id == "query"]
        assert not lost, (module.__name__, lost)
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
