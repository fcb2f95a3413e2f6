"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import skew
from ..sources.tables import table
from . import files, learning, search

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return skew.dominant_keys(table(spark, folder, "tf"))


def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    return skew.key_totals(table(spark, folder, "tf")).withColumn("lnc_sum", F.round("lnc_sum", 6))


_BY_FIELD = "SELECT 'gram_id' AS field, gram_id AS key_id, lnc FROM tf UNION ALL SELECT 'doc_id', doc_id, lnc FROM tf"

SKEW_SQL = {
    "p2_found": f"""SELECT field, key_id FROM ({_BY_FIELD}) WHERE key_id IS NOT NULL GROUP BY field, key_id
        HAVING count(*) >= 0.005 * (SELECT count(*) FROM tf)""",
    "p2_totals": f"""SELECT field, key_id, count(*) AS n_rows, count(lnc) AS n_weights, round(sum(lnc), 6) AS lnc_sum
        FROM ({_BY_FIELD}) GROUP BY field, key_id""",
}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return search.field_weighted_batch(spark, folder)


def queries() -> dict[str, Query]:
    return {"p2_found": p2_found, "p2_totals": p2_totals} | search.QUERIES | learning.QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    return SKEW_SQL | search.SQL | learning.SQL | files.SQL
