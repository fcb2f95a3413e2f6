"""Every query of the folder over the smallest tables, against its SQL where it has one."""

import os

import duckdb
import pytest

from lexforge.llm import queries, sql

FOLDER = os.environ.get("LEXFORGE_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plain(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    made = queries.queries()[name](spark, FOLDER)
    found = rows(made.columns, made.collect())
    statement = sql.oracle_sql().get(name)
    if statement is None:
        assert found[1]
    else:
        other = duckdb.connect()
        for table in os.listdir(FOLDER):
            other.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{table}'")
        result = other.execute(statement)
        assert found == rows([c[0] for c in result.description], result.fetchall())


COLUMNS = {
    "p1_found": ["paper_id_1", "paper_id_2"], "p3_found": ["paper_id_1", "paper_id_2"], "p4_found": ["name_1", "name_2"], "p5_found": ["kind", "key_id", "mark"],
    "p6_found": ["paper_id", "kind"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert queries.queries()[name](spark, FOLDER).columns == COLUMNS[name]
