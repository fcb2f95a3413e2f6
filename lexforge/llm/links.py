"""Groups from links: connected components with the links spread over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_shuffle, cut


def _stars(edges: DataFrame, smaller: bool) -> DataFrame:
    """One round: every neighbour of ``a`` is linked to the least node about ``a`` instead of to ``a``.

    ``smaller``: only neighbours below ``a``, and ``a`` itself; otherwise only those above it.
    """
    if smaller:
        about = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        about = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = about.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = about.join(by_shuffle(least), "a")
    if smaller:
        moved = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def pairs_within(rows: DataFrame, where: Column) -> DataFrame:
    """(a, b), a < b: the ids of ``rows`` (block, id, tiles, v) that share a block and whose structs ``x.v`` and ``y.v`` fit ``where``, each pair once.

    A block is spread over ``tiles`` tiles, which tell how many rows it holds, so no task gets a
    whole crowd and no pair is left out.
    """
    left = rows.select("block", F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("v").alias("x"))
    right = rows.select("block", F.col("id").alias("b"), F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("tile"), F.col("v").alias("y"))
    return left.join(by_shuffle(right), ["block", "tile"]).where("a < b").where(where).select("a", "b").distinct()


def tiles(n: Column, size: int = 1024) -> Column:
    """Tiles of about ``size`` rows for a block of ``n``."""
    return F.ceil(n / size).cast("int")


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b) for every node of ``links`` (a, b) but the least of its component, which is b.

    Star contraction: a node's neighbours are re-linked to the least of them, so paths shorten
    by a factor each round and no neighbourhood is ever gathered in one place. The links of each
    round are written to the checkpoint folder. Links of a node to itself and null ends are
    ignored; an empty table gives no rows.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        edges = cut(_stars(_stars(edges, False), True))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges
        seen = now
    raise RuntimeError(f"the components weren't settled in {rounds} rounds")
