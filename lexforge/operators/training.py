"""Vocabularies and samples for training word and paragraph vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, by_shuffle, spread
from .index import numbered


def positions(texts: DataFrame, key: str, tokens) -> DataFrame:
    """(key, pos, term)."""
    return texts.select(key, F.posexplode(tokens).alias("pos", "term"))


def _early(least: int):
    """Batches (key, tokens) to (term, key, pos, n): each term's first ``least`` places by key in the batch, the first with its count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            lists = batch.column(1)
            tokens = lists.flatten().dictionary_encode()
            sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            codes = tokens.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(codes, kind="stable")  # tokens are in the order of key and place
            order = order[np.searchsorted(codes[order], 0) :]
            n = np.bincount(codes[order], minlength=len(tokens.dictionary))
            nth = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
            order, nth = order[nth < least], nth[nth < least]
            count = np.where(nth == 0, n[codes[order]], 0)
            yield pa.RecordBatch.from_arrays([tokens.dictionary.take(pa.array(codes[order])), batch.column(0).take(pa.array(rows[order])), pa.array(pos[order].astype(np.int32)), pa.array(count.astype(np.int64))], ["term", batch.schema.names[0], "pos", "n"])

    return run


def text_vocabulary(texts: DataFrame, key: str, tokens: Column, least: int = 2) -> DataFrame:
    """What :func:`vocabulary` gives, of whole texts with unique keys, in one pass and without moving their words.

    A term's least-th occurrence is among the first ``least`` of one of the batches, so a batch puts
    out no more of a term than these, and how often it has it.
    """
    own = texts.select(key, tokens.alias("t")).where(F.col("t").isNotNull())
    kind = own.schema[key].dataType.simpleString()
    early = spread(own, key).mapInArrow(_early(least), f"term string, `{key}` {kind}, pos int, n long")
    whole = Window.partitionBy("term")
    at = early.withColumn("r", F.row_number().over(whole.orderBy(key, "pos"))).withColumn("freq", F.sum("n").over(whole)).where(F.col("r") == least)
    return numbered(at.select("term", "freq", key, "pos"), [key, "pos"], "token_id").select("term", "freq", "token_id")


def vocabulary(tokens: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(term, freq, token_id): ids in the order in which terms reach ``least`` occurrences over the texts by key.

    A term's least-th occurrence lies within its first ``least`` texts by key, so no more texts of a
    term are kept, before the shuffle as well as after it; a running sum over these finds the text in
    which the count is reached, and only that text's positions are numbered. Joins are by shuffle, as
    estimates don't know how many words come out of a text.
    """
    per_text = tokens.groupBy("term", key).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("term").orderBy(key)
    early = per_text.withColumn("r", F.row_number().over(running)).where(F.col("r") <= least).withColumn("upto", F.sum("n").over(running))
    at = early.where((F.col("upto") >= least) & (F.col("upto") - F.col("n") < least)).select("term", key, (F.lit(least) - F.col("upto") + F.col("n")).alias("nth"))
    freq = per_text.groupBy("term").agg(F.sum("n").alias("freq"))
    own = tokens.join(by_shuffle(at.join(by_shuffle(freq), "term")), ["term", key]).withColumn("r", F.row_number().over(Window.partitionBy("term", key).orderBy("pos"))).where("r = nth")
    return numbered(own.select("term", "freq", key, "pos"), [key, "pos"], "token_id").select("term", "freq", "token_id")


def purged(tokens: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, pos, token_id): sequences without the terms outside the vocabulary, places closed up."""
    kept = tokens.join(broadcast_if_small(vocab.select("term", "token_id")), "term")
    return kept.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).alias("pos"), "token_id")


def drop_probability(vocab: DataFrame, t: float = 4e-5) -> DataFrame:
    """(term, freq, p): the probability 1 - sqrt(t / share) that an occurrence is left out, at least 0."""
    total = vocab.agg(F.sum("freq")).first()[0] or 1
    return vocab.select("term", "freq", F.greatest(F.lit(0.0), 1 - F.sqrt(t / (F.col("freq") / F.lit(float(total))))).alias("p"))


def noise_share(vocab: DataFrame, alpha: float = 0.75, keep: tuple[str, ...] = ("term",)) -> DataFrame:
    """(term, q), or other columns of the vocabulary and q: shares of freq ** alpha, for drawing negatives."""
    total = vocab.agg(F.sum(F.pow("freq", F.lit(alpha)))).first()[0] or 1.0
    return vocab.select(*keep, (F.pow("freq", F.lit(alpha)) / F.lit(total)).alias("q"))


def subsampled(tokens: DataFrame, probability: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """The occurrences that stay; which ones is fixed by a hash of key and place, so reruns agree."""
    u = F.pmod(F.xxhash64(key, "pos", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return tokens.join(broadcast_if_small(probability.select("term", "p")), "term").where(u >= F.col("p")).select(*tokens.columns)


def skip_grams(sequences: DataFrame, key: str, most: int = 2) -> DataFrame:
    """(key, pos, feature, label): pairs of a word and one in its window, the word itself included.

    The half width of place i is i modulo ``most`` in place of a random draw. A window begins at
    max(i - r, 0), has 2r + 1 places and isn't shifted at the left end.
    """
    order = Window.partitionBy(key).orderBy("pos")
    wide = F.collect_list("token_id").over(order.rowsBetween(-(most - 1), 2 * (most - 1)))  # at most 3 * most places
    start = F.least(F.col("pos"), F.lit(most - 1))  # place of the word in its list
    rows = sequences.withColumn("w", wide).withColumn("r", F.pmod("pos", F.lit(most))).withColumn("from", start - F.least("pos", "r") + 1)
    inside = F.slice(F.col("w"), F.col("from"), 2 * F.col("r") + 1)
    return rows.select(key, "pos", F.explode(inside).alias("feature"), F.col("token_id").alias("label"))


def paragraph_contexts(sequences: DataFrame, key: str) -> DataFrame:
    """(key, pos, c1, c2, label): two words and the one that follows, for texts of four words or more; the last word is never a label."""
    order = Window.partitionBy(key).orderBy("pos")
    rows = sequences.withColumn("c2", F.lead("token_id", 1).over(order)).withColumn("label", F.lead("token_id", 2).over(order)).withColumn("beyond", F.lead("token_id", 3).over(order))
    return rows.where("beyond is not null").select(key, "pos", F.col("token_id").alias("c1"), "c2", "label")


#: Rows that one partition trains on where their number isn't given; more partitions are faster and average their models.
ROWS_A_MODEL = 50_000


def word_vectors(sentences: DataFrame, size: int = 64, window: int = 2, least: int = 5, iterations: int = 1, seed: int = 1, partitions: int | None = None):
    """A skip-gram model on rows (tokens array<string>), trained in ``partitions`` parts, by default one for every ``ROWS_A_MODEL`` rows."""
    from pyspark.ml.feature import Word2Vec

    parts = partitions or max(1, -(-sentences.count() // ROWS_A_MODEL))
    return Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=iterations, seed=seed, inputCol="tokens", outputCol="v", numPartitions=parts).fit(sentences)


def text_vectors(tokens: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, v): unit length sums of the vectors (term, v) of each text's words, repeats included."""
    from ..functions.vectors import unit, vector_sums

    counts = tokens.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.join(vectors.select("term", F.col("v").cast("array<double>").alias("v")), "term")
    summed = parts.select(key, F.transform("v", lambda x: x * F.col("n")).alias("v"))
    return vector_sums(summed, key).select(key, unit(F.col("v")).alias("v"))


def label_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``tokens`` with the token_id of each term, the vocabulary's last id for a term it lacks."""
    last = vocab.agg(F.coalesce(F.max("token_id"), F.lit(0))).first()[0]
    return tokens.join(broadcast_if_small(vocab.select("term", "token_id")), "term", "left").withColumn("token_id", F.coalesce("token_id", F.lit(last)))


def text_spans(texts: DataFrame, key: str, least: int = 100, most: int = 100_000, seed: int = 1) -> DataFrame:
    """(key, span): a piece of each text of ``least`` characters or more, between the marks <s> and </s>.

    Begin and length, up to ``most``, are taken from a hash of the key, so reruns agree. Shorter and
    null texts have none.
    """
    u = [F.pmod(F.xxhash64(key, F.lit(seed + i)), F.lit(1 << 30)) / float(1 << 30) for i in range(2)]
    rows = texts.where(F.length("text") >= least).withColumn("_n", F.length("text"))
    size = (least + F.floor(u[0] * (F.least("_n", F.lit(most)) - least + 1))).cast("int")
    begin = F.floor(u[1] * (F.col("_n") - F.col("_size") + 1)).cast("int") + 1
    return rows.withColumn("_size", size).select(key, F.concat(F.lit("<s>"), F.substring(F.col("text"), begin, F.col("_size")), F.lit("</s>")).alias("span"))
