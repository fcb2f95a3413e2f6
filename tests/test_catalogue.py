"""Every query against its SQL in another engine, over the smallest tables."""

import math
import os

import duckdb
import pytest

from lexforge.plans import catalogue

FOLDER = os.environ.get("LEXFORGE_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def other():
    made = duckdb.connect()
    for name in os.listdir(FOLDER):
        made.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return made


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return "null" if value is None else str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, other, name):
    made = catalogue.queries()[name](spark, FOLDER)
    found = rows(made.columns, made.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert found[1]
    else:
        result = other.execute(sql)
        assert found == rows([c[0] for c in result.description], result.fetchall())


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
