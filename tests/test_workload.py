"""Every registered query against its SQL in DuckDB."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def key(row):
    return [(v is None, str(v)) for v in row]


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    got = contract.queries()[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(*names).collect()), key=key)
    assert rows
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return
    relation = duck.sql(sql)
    assert sorted(relation.columns) == names
    order = [relation.columns.index(c) for c in names]
    types = {f.name: TYPES[f.dataType.simpleString()] for f in got.schema}
    assert {c: str(t) for c, t in zip(relation.columns, relation.types)} == types
    want = sorted((tuple(plain(r[i]) for i in order) for r in relation.fetchall()), key=key)
    assert len(rows) == len(want)
    wrong = [(a, b) for a, b in zip(rows, want) if a != b]
    assert not wrong, wrong[:3]


def test_entry(spark):
    assert contract.entry(spark).count() == 500 * 10
