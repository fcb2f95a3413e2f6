"""Per-key results when a few keys own most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many heavy keys of a field are kept; their list is all that reaches the driver.
MAX_HEAVY = 512


def heavy_keys(rows: DataFrame, keys: list[str], share: float = 0.002) -> dict[str, list]:
    """Keys that may own ``share`` of the rows or more, of each field in ``keys``.

    One pass with a bounded frequent-items sketch per field (``approx_top_k``): its counters are
    never more than ``8 * MAX_HEAVY``, at any size of the input. A key above the share can't be
    missed as long as the sketch holds more than ``1 / share`` counters. Null is never heavy.
    """
    if share < 1 / (4 * MAX_HEAVY):
        raise ValueError(f"share is below what the sketch can tell: {1 / (4 * MAX_HEAVY)}")
    sketches = [F.expr(f"approx_top_k(`{k}`, {MAX_HEAVY}, {8 * MAX_HEAVY})").alias(k) for k in keys]
    found = rows.agg(F.count(F.lit(1)).alias("n_rows_in_all"), *sketches).first()
    least = max(1, share * found["n_rows_in_all"])
    return {k: [x["item"] for x in (found[k] or []) if x["count"] >= least and x["item"] is not None] for k in keys}


def salted_aggregate(
    rows: DataFrame, keys: list[str], partial: dict[str, Column], merge: dict[str, Column], heavy: Column, salts: int = 32, seed: int = 7
) -> DataFrame:
    """Two-stage aggregation: partial results per (keys, salt), merged by the original keys.

    ``partial`` names the aggregates of the first stage, ``merge`` those of the second, written on
    the first stage's names. Rows for which ``heavy`` holds get a random salt below ``salts``, all
    others salt 0, so an ordinary key still meets in one place after the first shuffle. Keys may be
    null: null is a group, as in GROUP BY. An empty input gives no rows.
    """
    salt = F.when(F.coalesce(heavy, F.lit(False)), F.floor(F.rand(seed) * salts)).otherwise(0).cast("int")
    first = rows.withColumn("_salt", salt).groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


def key_totals(tf: DataFrame, share: float = 0.002) -> DataFrame:
    """Rows, rows with a weight, and weight sums for every ``gram_id`` and every ``doc_id`` of ``tf``.

    Columns: field ('gram_id' or 'doc_id'), key_id, n_rows, n_weights, lnc_sum. Repeated rows count
    as stored. A null key is a group of its own with key_id null; null weights add nothing, and a key
    with none but null weights has lnc_sum null. Further columns of ``tf`` are not read.
    """
    fields = ["gram_id", "doc_id"]
    rows = tf.select(*fields, F.col("lnc").cast("double").alias("lnc"))
    large = heavy_keys(rows, fields, share)
    by_field = rows.select(F.expr("stack(2, 'gram_id', gram_id, 'doc_id', doc_id) as (field, key_id)"), "lnc")
    heavy = F.lit(False)
    for field in fields:
        if large[field]:
            heavy = heavy | ((F.col("field") == field) & F.col("key_id").isin(large[field]))
    return salted_aggregate(
        by_field,
        ["field", "key_id"],
        {"n": F.count(F.lit(1)), "w": F.count("lnc"), "s": F.sum("lnc")},
        {"n_rows": F.sum("n"), "n_weights": F.sum("w"), "lnc_sum": F.sum("s")},
        heavy,
    )


def dominant_keys(tf: DataFrame, share: float = 0.005) -> DataFrame:
    """(field, key_id) of the keys of ``tf`` that own at least ``share`` of all its rows as stored.

    Exact: the counts are those of :func:`key_totals`; the number of rows is one number, counted
    from the file footers. Null is no key and never a case.
    """
    least = share * tf.count()
    kept = key_totals(tf).where((F.col("n_rows") >= least) & F.col("key_id").isNotNull())
    return kept.select("field", "key_id")
