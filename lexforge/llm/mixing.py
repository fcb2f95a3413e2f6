"""A selection of documents in which every source has its share of all tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, by_shuffle, cut
from .tokens import token_counts

#: Documents of a source are ordered by hash through so many buckets; only the bucket where the selection ends is ordered by row.
BUCKETS = 4096
#: A table of targets is small; one above this number of sources isn't taken for one.
MAX_SOURCES = 10_000


def cleaned(source: Column) -> Column:
    """Lower-cased source name without outer spaces, runs of other signs than letters and digits as one '_'."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", " ")), " ", "_")


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Amounts in proportion to the weights that sum to ``total`` or, if the caps don't allow it, to all caps.

    Sources whose proportional amount exceeds their cap are clamped there and what they can't take
    is spread over the others by weight, until nothing exceeds. Weights of zero, or below 1e-12 of the
    largest, get nothing.
    """
    most = max(weights.values(), default=0.0)
    weights = {s: w / most if most > 0 and w / most >= 1e-12 else 0.0 for s, w in weights.items()}
    amounts = {s: 0.0 for s in weights}
    free = {s for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0}
    left = min(float(total), float(sum(caps[s] for s in free)))
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level >= caps[s]}
        if not over:
            amounts |= {s: weights[s] * level for s in free}
            break
        for s in over:
            amounts[s] = float(caps[s])
            left -= caps[s]
        free -= over
        left = max(0.0, left)
    return amounts


def plan(targets: DataFrame, sizes: dict[str, int], total: int | None = None) -> list[dict]:
    """A row per cleaned source of ``targets``: weight, max_repeat, available and planned tokens, epochs.

    Targets of the same cleaned name add their weights and keep the largest max_repeat; null and
    negative weights and repeats count 0, null names are left out. ``total`` is by default the number of
    tokens of all targeted sources together.
    """
    own = targets.select(cleaned(F.col("source")).alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0)).alias("max_repeat"))
    rows = own.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    weights = {r["source"]: r["weight"] for r in rows}
    caps = {r["source"]: r["max_repeat"] * sizes.get(r["source"], 0) for r in rows}
    wanted = sum(sizes.get(s, 0) for s in weights) if total is None else total
    amounts = water_fill(weights, caps, wanted)
    out = []
    for r in sorted(rows):
        s, size = r["source"], sizes.get(r["source"], 0)
        out.append({"source": s, "weight": r["weight"], "max_repeat": r["max_repeat"], "available": size, "planned": amounts[s], "epochs": min(r["max_repeat"], amounts[s] / size) if size else 0.0})
    return out


def _sized(documents: DataFrame, targets: DataFrame, tokenizer: str) -> tuple[DataFrame, dict[str, int]]:
    named = documents.select("doc_id", cleaned(F.col("source")).alias("source"), "text")
    wanted = targets.select(cleaned(F.col("source")).alias("source")).where(F.col("source").isNotNull()).distinct().limit(MAX_SOURCES + 1)
    sized = cut(token_counts(named.join(F.broadcast(wanted), "source", "left_semi"), name=tokenizer))
    return sized, dict(sized.groupBy("source").agg(F.sum("n_tokens")).collect())  # a row per target


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = "byte_bpe_50k", seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The selection, and the shares it reaches.

    selection: (doc_id, source, n_tokens, repeats), a row per chosen document; ``repeats`` never
    exceeds the source's max_repeat. Every document of a source gets the whole part of its epochs;
    the fraction goes to documents in the order of a seeded hash until their tokens reach it, so it
    is met to within half a document. Documents without tokens (null and empty texts) or without a
    targeted source are never chosen.
    shares: (source, weight, max_repeat, available_tokens, epochs, target_share, actual_tokens,
    actual_share), a row per target, those without documents included. target_share is the weight
    after the redistribution. Empty tables give no rows.
    """
    spark = documents.sparkSession
    sized, sizes = _sized(documents, targets, tokenizer)
    rows = plan(targets, sizes, total)
    whole = sum(r["planned"] for r in rows)
    steps = [(r["source"], int(r["epochs"]), float((r["epochs"] - int(r["epochs"])) * r["available"])) for r in rows]
    layout = F.broadcast(spark.createDataFrame(steps, "source string, times int, rest double"))  # a row per target
    placed = sized.where("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS)))
    # BUCKETS rows a source at most
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket")).withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    buckets = buckets.join(layout, "source")
    left = F.col("rest") - F.col("before")
    buckets = buckets.select("source", "bucket", "times", F.when(left >= F.col("in_bucket"), "all").when(left > 0, "some").otherwise("none").alias("takes"), left.alias("left"))
    known = placed.join(broadcast_if_small(buckets), ["source", "bucket"])
    inside = Window.partitionBy("source").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = known.where("takes = 'some'").withColumn("upto", F.sum("n_tokens").over(inside))
    edge = edge.withColumn("repeats", F.col("times") + (F.col("upto") - F.col("n_tokens") / 2 <= F.col("left")).cast("int"))
    plain = known.where("takes <> 'some'").withColumn("repeats", F.col("times") + (F.col("takes") == "all").cast("int"))
    columns = ["doc_id", "source", "n_tokens", "repeats"]
    selection = plain.select(columns).unionByName(edge.select(columns)).where("repeats > 0")

    reached = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"))
    wanted = [(r["source"], float(r["weight"]), int(r["max_repeat"]), int(r["available"]), float(r["epochs"]), r["planned"] / whole if whole else 0.0) for r in rows]
    report = spark.createDataFrame(wanted, "source string, weight double, max_repeat int, available_tokens long, epochs double, target_share double")
    shares = report.join(by_shuffle(reached), "source", "left").na.fill(0, ["actual_tokens"])
    of_all = F.sum("actual_tokens").over(Window.partitionBy(F.lit(1)))  # over a row per target
    return selection, shares.withColumn("actual_share", F.when(of_all > 0, F.col("actual_tokens") / of_all).otherwise(0.0))
