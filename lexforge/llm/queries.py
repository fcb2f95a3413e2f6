"""The queries of this folder: each takes (spark, folder) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import by_shuffle, cut
from ..sources.tables import table
from . import encodings, frequency, mixing, names, neardup, nearest, scans, tokens

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_pairs(table(spark, folder, "papers"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(table(spark, folder, "papers"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.neighbour_pairs(table(spark, folder, "papers"))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.neighbours(table(spark, folder, "papers")).withColumn("similarity", F.round("similarity", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.linked_names(table(spark, folder, "papers"), table(spark, folder, "given_names"))


def p4_entities(spark: SparkSession, folder: str) -> DataFrame:
    return names.entities(table(spark, folder, "papers"), table(spark, folder, "given_names"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.useless(*(table(spark, folder, t) for t in ("papers", "term", "gram", "idf", "index_document")))


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, folder, "papers"), table(spark, folder, "term"))


def p5_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.vocabulary(table(spark, folder, "papers"), table(spark, folder, "term"))


def p5_grams(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.gram_frequencies(*(table(spark, folder, t) for t in ("gram", "idf", "index_document")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.noise(table(spark, folder, "papers"))


def p6_text(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repaired(table(spark, folder, "papers"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.decoded(tokens.token_ids(table(spark, folder, "documents")))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    shares = mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]
    return shares.select("source", "weight", "max_repeat", "available_tokens", *[F.round(c, 6).alias(c) for c in ("epochs", "target_share", "actual_share")], "actual_tokens")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return encodings.repaired(table(spark, folder, "documents")).where("garbled").select("doc_id")


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    done = encodings.repaired(table(spark, folder, "documents")).where("garbled")
    return done.select("doc_id", "reason", F.array_join("chain", ", then ").alias("chain"), "restored")


def p4_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of :func:`p4_found` that break its form: out of order, of a name that nobody typed, or repeated. There should be none."""
    pairs, typed = p4_found(spark, folder), names.typed_names(table(spark, folder, "papers")).select("name")
    pairs = cut(pairs)
    strangers = pairs.select(F.explode(F.array("name_1", "name_2")).alias("name")).join(by_shuffle(typed), "name", "left_anti").count()
    return pairs.agg(F.count_if(F.col("name_1") >= F.col("name_2")).alias("unordered"), (F.count(F.lit(1)) - F.count_distinct("name_1", "name_2")).alias("repeated")).withColumn("strangers", F.lit(strangers).cast("long"))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, one, kept) of every paper: it has one repaired text, and a missing or empty body stays as it is."""
    made = p6_text(spark, folder).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("size"))
    bodies = table(spark, folder, "papers").where(F.col("paper_id").isNotNull()).groupBy("paper_id").agg(F.max(F.length("body")).alias("before"))
    joined = bodies.join(by_shuffle(made), "paper_id", "left")
    return joined.select("paper_id", (F.col("n") == 1).alias("one"), ((F.coalesce("before", F.lit(0)) > 0) | F.col("size").eqNullSafe(F.col("before"))).alias("kept"))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """(source, capped, reached): no source is repeated above its cap, and its share of the tokens is its target share to a hundredth."""
    shares = p8_shares(spark, folder)
    return shares.select("source", (F.coalesce("epochs", F.lit(0.0)) <= F.col("max_repeat") + 1e-6).alias("capped"), (F.abs(F.coalesce("actual_share", F.lit(0.0)) - F.coalesce("target_share", F.lit(0.0))) <= 0.01).alias("reached"))


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, kept) of every document: one that isn't garbled has its text as it was, and a null or ASCII text is never garbled."""
    made = encodings.repaired(table(spark, folder, "documents")).select("doc_id", "garbled", "restored")
    texts = table(spark, folder, "documents").select("doc_id", "text")
    plain = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x00-\x7f]")
    kept = F.when(F.col("garbled"), ~plain).otherwise(F.col("restored").eqNullSafe(F.col("text")))
    return texts.join(by_shuffle(made), "doc_id").select("doc_id", kept.alias("kept"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
