"""Nearest neighbours among dense vectors, exact in tiles and approximate by hashing; two components for plots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, vector_sums

#: Rows of a tile's side: a task compares two such blocks.
TILE = 4096


def _blocks(n: int) -> int:
    return max(1, math.ceil(n / TILE))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _best_in_tile(k: int, measure: str):
    """The k best of the right block for each row of the left one; ties to the smaller id."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = {"src_id": pa.int64(), "dst_id": pa.int64(), "value": pa.float64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        a, b = _matrix(left["a"]), _matrix(right["b"])
        ia, ib = left["ia"].to_numpy(), right["ib"].to_numpy()
        order = np.argsort(ib, kind="stable")
        b, ib = b[order], ib[order]
        out = []
        for start in range(0, len(a), 256):
            some = a[start : start + 256]
            if measure == "dot":
                value = -(some @ b.T)
            else:
                value = ((some * some).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (some @ b.T)).clip(0)
            best = np.argsort(np.round(value, 9), axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(some)), best.shape[1])
            exact = value[rows, best.ravel()]
            if measure != "dot":  # without the cancellation of the expanded square
                d = some[rows] - b[best.ravel()]
                exact = (d * d).sum(1)
            out.append((ia[start : start + 256][rows], ib[best.ravel()], exact))
        s, d, v = (np.concatenate(x) for x in zip(*out))
        return pa.table({"src_id": s, "dst_id": d, "value": -v if measure == "dot" else v})

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, measure: str = "euclid") -> DataFrame:
    """(src_id, rank, dst_id, value): for each of ``queries`` (id, v) the k nearest of ``vectors`` (id, v), exact.

    ``value`` is the squared distance ('euclid', smallest first) or the product ('dot', largest first);
    ties go to the smaller id, and a vector among its own neighbours stays. Both sides are cut into
    blocks and every pair of blocks is one tile, so no task holds more than two blocks. Null vectors
    are left out; all others must have one length.
    """
    q, v = queries.where("v is not null"), vectors.where("v is not null")
    nq, nv = _blocks(q.count()), _blocks(v.count())
    left = q.select(F.col("id").alias("ia"), F.col("v").alias("a"), F.pmod(F.xxhash64("id"), F.lit(nq)).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))).alias("y"))
    right = v.select(F.col("id").alias("ib"), F.col("v").alias("b"), F.pmod(F.xxhash64("id"), F.lit(nv)).alias("y2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("x2"))
    tiles = left.groupBy("x", "y").cogroup(right.groupBy("x2", "y2")).applyInArrow(_best_in_tile(k, measure), "src_id long, dst_id long, value double")
    rounded = F.round("value", 9)
    order = Window.partitionBy("src_id").orderBy(F.desc(rounded) if measure == "dot" else rounded, "dst_id")
    return tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src_id", "rank", "dst_id", "value")


def nearest_by_hashing(queries: DataFrame, vectors: DataFrame, k: int, length: float = 0.8, tables: int = 8, seed: int = 1) -> DataFrame:
    """As :func:`nearest` by distance, approximate: only vectors that share a random-projection bucket are compared."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    a, b = (x.where("v is not null").select("id", array_to_vector(F.col("v").cast("array<double>")).alias("f")) for x in (queries, vectors))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=length, numHashTables=tables, seed=seed).fit(b)
    joined = model.approxSimilarityJoin(a, b, float("inf"), "d").select(F.col("datasetA.id").alias("src_id"), F.col("datasetB.id").alias("dst_id"), (F.col("d") * F.col("d")).alias("value"))
    order = Window.partitionBy("src_id").orderBy(F.round("value", 9), "dst_id")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src_id", "rank", "dst_id", "value")


def vector_sum(chosen: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, v): for each group ``id`` of rows (id, vec_id) the sum of its vectors, element by element."""
    parts = chosen.join(vectors.select(F.col("id").alias("vec_id"), F.col("v").cast("array<double>").alias("v")), "vec_id")
    return vector_sums(parts, "id")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["one", "v"])


def two_components(vectors: DataFrame) -> DataFrame:
    """(id, x, y): the vectors on their first two singular directions, not centred; a direction points to where its largest element is positive.

    The directions are those of the sum of the vectors' products with themselves, which batches add
    up before it is shuffled.
    """
    rows = vectors.where("v is not null").select(F.col("v").cast("array<double>").alias("v"))
    products = rows.mapInArrow(_products, "one int, v array<double>")
    summed = vector_sums(products, "one").first()  # one square matrix
    if summed is None:
        return vectors.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    width = math.isqrt(len(summed["v"]))
    _, directions = np.linalg.eigh(np.array(summed["v"]).reshape(width, width))  # the largest last
    right = [directions[:, -j] * (1 if directions[np.argmax(np.abs(directions[:, -j])), -j] > 0 else -1) if width >= j else np.zeros(width) for j in (1, 2)]
    first, second = (F.array(*[F.lit(float(x)) for x in d]) for d in right)
    return vectors.where("v is not null").select("id", dot(F.col("v"), first).alias("x"), dot(F.col("v"), second).alias("y"))
