"""Term counts, weights, dictionaries and postings, built from whole texts and merged by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import spread


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tokens) to (key, term, n, lnc): the tokens of a batch get numbers, and equal numbers of a row are counted in arrays."""
    for batch in batches:
        lists = batch.column(1)
        tokens = lists.flatten().dictionary_encode()
        # as large as the batch, an empty dictionary included
        codes, width = tokens.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(tokens.dictionary))
        rows = np.repeat(np.arange(len(lists)), np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))
        cells, n = np.unique(rows[codes >= 0] * width + codes[codes >= 0], return_counts=True)
        row, weight = cells // width, 1 + np.log(n)
        length = np.sqrt(np.bincount(row, weight * weight, len(lists)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), tokens.dictionary.take(pa.array(cells % width)), pa.array(n.astype(np.int64)), pa.array(weight / length[row])], [batch.schema.names[0], "term", "n", "lnc"])


def weighted_terms(texts: DataFrame, key: str, text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(key, term, n, lnc) of texts whose keys are unique: what :func:`term_counts` and :func:`log_weights` give, without a shuffle.

    A row is a whole text, so its words are counted and its vector's length is taken where it lies.
    Null texts have no rows.
    """
    own = texts.select(key, (tokens if tokens is not None else words(F.col(text))).alias("t")).where(F.col("t").isNotNull())
    kind = own.schema[key].dataType.simpleString()
    return spread(own, key).mapInArrow(_counted, f"`{key}` {kind}, term string, n long, lnc double")


def word_lists(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, t) of texts that aren't null, ``t`` being the words in order: what :func:`text_postings` and :func:`impact_postings` read."""
    return spread(texts.select(key, words(F.col(text)).alias("t")).where(F.col("t").isNotNull()), key)


def text_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, words) to postings (key, term, x), x being lnc."""
    for batch in _counted(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3)], [batch.schema.names[0], "term", "x"])


def impact_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, words) to postings (key, term, x): ln(1 + n), divided by the square of the text's length, as `impact.tfidf_vectors` has it."""
    for batch in _counted(batches):
        raw = np.log1p(batch.column(2).to_numpy(zero_copy_only=False))
        rows = batch.column(0).dictionary_encode()
        row = rows.indices.to_numpy(zero_copy_only=False)
        square = np.bincount(row, raw * raw, len(rows.dictionary))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw / square[row])], [batch.schema.names[0], "term", "x"])


def unit_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, weight, words) of units to postings (doc, term, x), x being a unit's lnc times its weight."""
    for batch in batches:
        rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(2)], ["row", "t"])
        weight = batch.column(1).to_numpy(zero_copy_only=False)
        for own in _counted(iter([rows])):
            row = own.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own.column(0)), own.column(1), pa.array(own.column(3).to_numpy() * weight[row])], ["doc", "term", "x"])


def parted_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, words) of texts to postings (key, term, x, part), x being lnc."""
    for batch in batches:
        rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(2)], ["row", "t"])
        for own in _counted(iter([rows])):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own.column(0)), own.column(1), own.column(3), batch.column(1).take(own.column(0))], [batch.schema.names[0], "term", "x", "part"])


def term_counts(texts: DataFrame, key: str, text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(key, term, n): how often each text has each word.

    Texts are spread by key before they are taken apart, which moves less than the words would, and
    all that follows per text (counts, norms) needs no other shuffle. Null texts have no rows.
    """
    rows = texts.select(key, (tokens if tokens is not None else words(F.col(text))).alias("t")).repartition(key)
    return rows.select(key, F.explode("t").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def log_weights(counts: DataFrame, key: str) -> DataFrame:
    """(key, term, n, lnc): 1 + ln n, divided by the length of the text's vector."""
    weighted = counts.withColumn("w", 1 + F.log("n"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.withColumn("lnc", F.col("w") / length).drop("w")


def vector_lengths(counts: DataFrame, key: str) -> DataFrame:
    """(key, length) of the vectors of 1 + ln n."""
    return counts.groupBy(key).agg(F.sqrt(F.sum((1 + F.log("n")) * (1 + F.log("n")))).alias("length"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df)."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_stats(postings: DataFrame, value: str) -> DataFrame:
    """(term, df, max_val, min_val) of postings."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(value).alias("max_val"), F.min(value).alias("min_val"))


def posting_chunks(postings: DataFrame, key: str, value: str, size: int = 6000) -> DataFrame:
    """(term, chunk, size, max_val, min_val): a term's postings by falling value, in chunks of ``size``.

    A term that half of all texts have would be one task's sort; so postings of one value are counted
    first, before the shuffle as well, and chunk borders follow from these counts: a bounded histogram
    of each term's values tells how many are larger than those of a bucket, and only the different
    values of a bucket are ordered. However many postings share a value, they are one row here, as
    their order by ``key`` makes no difference to what comes out.
    """
    counts = postings.groupBy("term", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("b", F.floor(F.col("v") * 4096))
    hist = counts.groupBy("term", "b").agg(F.sum("c").alias("c"))
    earlier = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = hist.withColumn("above", earlier(Window.partitionBy("term").orderBy(F.desc("b")))).select("term", "b", "above")
    placed = counts.withColumn("before", earlier(Window.partitionBy("term", "b").orderBy(F.desc("v")))).join(above, ["term", "b"])
    first = F.col("above") + F.col("before")
    runs_in = placed.select("term", "v", first.alias("first"), (first + F.col("c")).alias("end"))
    each = runs_in.select("*", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("end") - 1) / size))).alias("chunk"))
    inside = F.least("end", (F.col("chunk") + 1) * size) - F.greatest("first", F.col("chunk") * size)
    return each.groupBy("term", "chunk").agg(F.sum(inside).alias("size"), F.max("v").alias("max_val"), F.min("v").alias("min_val"))


def posting_ranks(postings: DataFrame, key: str, value: str) -> DataFrame:
    """Postings with their ``rank`` within the term: by falling value, then by key.

    All are numbered in one order over range partitions, so a term with very many postings is spread
    over several; a term's ranks are its numbers less its first one.
    """
    from ..session import by_shuffle, cut

    placed = cut(numbered(postings.withColumn("_v", -F.col(value)), ["term", "_v", key], "_n").drop("_v"))
    first = placed.groupBy("term").agg(F.min("_n").alias("_first"))
    return placed.join(by_shuffle(first), "term").withColumn("rank", F.col("_n") - F.col("_first") + 1).drop("_n", "_first")


def gram_counts(texts: DataFrame, key: str, text: str = "text", pairs: bool = True) -> DataFrame:
    """(key, term1, term2, n): counts of words and, if wanted, of neighbouring pairs of words."""
    from ..functions.text import grams

    rows = texts.select(key, grams(words(F.col(text))).alias("g")).repartition(key).select(key, F.explode("g").alias("g"))
    kept = rows if pairs else rows.where("g.term2 = ''")
    return kept.groupBy(key, F.col("g.term1").alias("term1"), F.col("g.term2").alias("term2")).agg(F.count(F.lit(1)).alias("n"))


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Rows with dense numbers in the order of ``order`` without putting all into one task.

    Rows are range-partitioned and sorted; the partitions' sizes, one number each, give the offsets.
    """
    from ..session import cut

    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("low")).orderBy("_p").collect()
    offsets, before = [], start
    for row in sizes:
        offsets.append((row["_p"], before - row["low"]))
        before += row["n"]
    shift = placed.sparkSession.createDataFrame(offsets, "_p int, _shift long")
    return placed.join(F.broadcast(shift), "_p").withColumn(name, F.col("_i") + F.col("_shift")).drop("_p", "_i", "_shift")  # a row per partition


def insert_absent(old: DataFrame, new: DataFrame, key: str | list[str], number: str) -> DataFrame:
    """``old`` (number, key) with the keys of ``new`` it lacks, numbered on from its largest number in the order of the keys."""
    keys = [key] if isinstance(key, str) else key
    last = old.agg(F.coalesce(F.max(number), F.lit(-1))).first()[0]
    fresh = new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti")
    return old.select(number, *keys).unionByName(numbered(fresh, keys, number, last + 1).select(F.col(number).cast("long").alias(number), *keys))


def add_grams(grams: DataFrame, df: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary (gram_id, term1, term2) and its (gram_id, df) with the counts (term1, term2, df) of new texts.

    Grams the dictionary lacks get the next numbers; those it has keep theirs and their df grows.
    """
    known = insert_absent(grams, delta, ["term1", "term2"], "gram_id")
    return known, merge_counts(df, delta.join(known, ["term1", "term2"]).select("gram_id", "df"), ["gram_id"], "df")


def merge_counts(old: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of both tables added by key; a key of either is kept."""
    joined = old.groupBy(*keys).agg(F.sum(value).alias("_a")).join(delta.groupBy(*keys).agg(F.sum(value).alias("_b")), keys, "full")
    return joined.select(*keys, (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias(value))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """``old`` with ``new`` merged by key: present keys get the new values of ``updated`` and keep the rest."""
    fresh = new.dropDuplicates(keys)
    joined = old.join(fresh.select(*keys, *[F.col(c).alias(f"_{c}") for c in updated], F.lit(True).alias("_hit")), keys, "left")
    kept = joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in updated else F.col(c) for c in old.columns])
    return kept.unionByName(fresh.join(old.select(*keys), keys, "left_anti").select(*old.columns))
