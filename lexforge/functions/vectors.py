"""Dense and sparse vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if the lengths differ."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector divided by its length; one of length 0 stays as it is."""
    n = norm(v)
    return F.transform(as_double(v), lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def to_sparse(v: Column) -> Column:
    """Structs (i, x) of the elements other than 0."""
    return F.filter(F.transform(as_double(v), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != 0)


def to_dense(sparse: Column, size: int) -> Column:
    """The array of ``size`` elements that the structs (i, x) stand for; the last of repeated places counts."""
    places = F.map_from_entries(F.transform(sparse, lambda s: F.struct(s["i"], s["x"])))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(places, i), F.lit(0.0)))


def repeated_to(v: Column, size: int) -> Column:
    """The vector repeated or cut to ``size`` elements."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(v, i % F.size(v)))


def inverse_square(d2: Column, scale: float = 15.0) -> Column:
    """Similarity from a squared distance: scale / d2, null at distance 0."""
    return F.when(d2 > 0, scale / d2)


def vector_sums(rows: DataFrame, key: str) -> DataFrame:
    """(key, v): the sums of the arrays ``v`` of each key, element by element, added up before the shuffle and after it."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    summed = rows.groupBy(key).agg(Summarizer.sum(array_to_vector(F.col("v").cast("array<double>"))).alias("v"))
    return summed.select(key, vector_to_array("v").alias("v"))
