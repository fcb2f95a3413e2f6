"""How often every word occurs, in how many papers, and which words and grams are of no use.

A global integer dictionary comes first; terms are encoded by it; every block accumulates arrays of
counts, one per range of identifiers, and the arrays are summed by range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_shuffle, cut
from .papers import one_per_paper, words_of

#: Distinct words a block may hold; a fuller block is written out and a new one begun.
BLOCK_WORDS = 300_000
#: Identifiers of one range: two arrays of so many counts are all that a task holds while it sums.
RANGE = 65_536
#: Ranges a block may hold arrays of before it writes them out.
BLOCK_RANGES = 64


def _blocks(most: int):
    """(word, n, p): occurrences and texts of each distinct word of a block.

    A block has a small dictionary of its own. Its texts are encoded by it and counted in arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        sums = np.zeros((2, 1024), np.int64)

        def out() -> pa.RecordBatch:
            n = len(codes)
            return pa.RecordBatch.from_arrays([pa.array(list(codes), pa.string()), pa.array(sums[0, :n]), pa.array(sums[1, :n])], ["word", "n", "p"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    own = np.array([codes.setdefault(w, len(codes)) for w in words_of(text)], np.int64)
                    while sums.shape[1] < len(codes):
                        sums = np.concatenate([sums, np.zeros_like(sums)], axis=1)
                    code, times = np.unique(own, return_counts=True)
                    sums[0, code] += times
                    sums[1, code] += 1
                    if len(codes) >= most:
                        yield out()
                        codes, sums = {}, np.zeros((2, 1024), np.int64)
        if codes:
            yield out()

    return run


def dictionary(words: DataFrame) -> DataFrame:
    """(word, word_id): a dense number for every distinct word of the one column of ``words``.

    Words are spread by hash and numbered where they lie; one number per partition, its size,
    reaches the driver. No task holds more than a batch of them.
    """
    spark, word = words.sparkSession, words.columns[0]
    placed = cut(words.select(F.col(word).alias("word")).distinct().select("word", F.monotonically_increasing_id().alias("at")))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size")).collect())
    before, offsets = 0, []
    for number, size in sizes:
        offsets.append((number, before))
        before += size
    offset = spark.createDataFrame(offsets, "part long, before long")
    return placed.withColumn("part", part).join(F.broadcast(offset), "part").select("word", (F.col("before") + place).alias("word_id"))  # a row per partition


def _accumulated(width: int, most: int):
    """(range, place, n, p): count arrays of a block of encoded rows (id, n, p), one per range of identifiers; zeros are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for number, sums in held.items():
                place = np.flatnonzero(sums[2])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(place)], pa.int32()), pa.array(x, kind)) for x, kind in ((place, pa.int32()), (sums[0, place], pa.int64()), (sums[1, place], pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], ["range", "place", "n", "p"])
            held.clear()

        for batch in batches:
            ids, n, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for number in np.unique(ids // width):
                own = ids // width == number
                if number not in held:
                    if len(held) >= most:
                        yield from out()
                    held[number] = np.zeros((3, width), np.int64)
                for row, value in enumerate((n, p, np.ones_like(n))):
                    np.add.at(held[number][row], ids[own] % width, value[own])
        yield from out()

    return run


def _summed(width: int):
    """(id, n, p) from the count arrays of all blocks, which come range by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = -1, np.zeros((3, width), np.int64)

        def out() -> pa.RecordBatch:
            place = np.flatnonzero(sums[2])
            return pa.RecordBatch.from_arrays([pa.array(now * width + place), pa.array(sums[0, place]), pa.array(sums[1, place])], ["id", "n", "p"])

        for batch in batches:
            for i, number in enumerate(batch.column(0).to_pylist()):
                if number != now:
                    if now >= 0:
                        yield out()
                    now, sums = number, np.zeros((3, width), np.int64)
                place = batch.column(1)[i].values.to_numpy()
                sums[0, place] += batch.column(2)[i].values.to_numpy()
                sums[1, place] += batch.column(3)[i].values.to_numpy()
                sums[2, place] += 1
        if now >= 0:
            yield out()

    return run


def sums_by_range(encoded: DataFrame) -> DataFrame:
    """(id, n, p): the sums of ``n`` and ``p`` of every identifier of ``encoded`` (id, n, p), neither null.

    Blocks add up in arrays first, so a frequent identifier costs one number per block; the arrays
    are shuffled by range and summed, one range at a time.
    """
    arrays = encoded.select("id", "n", "p").mapInArrow(_accumulated(RANGE, BLOCK_RANGES), "range long, place array<int>, n array<long>, p array<long>")
    return arrays.repartition("range").sortWithinPartitions("range").mapInArrow(_summed(RANGE), "id long, n long, p long")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word_id, word, n_occurrences, n_texts) of every distinct word of the one column of ``texts``.

    Identifiers are dense. Null, empty and wordless texts add nothing; an empty table gives no rows.
    """
    blocks = cut(texts.mapInArrow(_blocks(BLOCK_WORDS), "word string, n long, p long"))
    words = cut(dictionary(blocks.select("word")))
    encoded = blocks.join(by_shuffle(words), "word").select(F.col("word_id").alias("id"), "n", "p")
    counted = sums_by_range(encoded).select(F.col("id").alias("word_id"), F.col("n").alias("n_occurrences"), F.col("p").alias("n_texts"))
    return words.join(by_shuffle(counted), "word_id").select("word_id", "word", "n_occurrences", "n_texts")


def mark(n: Column, rare_below: int, common_above: Column) -> Column:
    """'rare', 'common' or null for neither; a count can't be both unless the table is tiny, then 'rare'."""
    return F.when(n < rare_below, "rare").when(n > common_above, "common")


def typed_word(term: Column) -> Column:
    """A typed term without outer white space, lower-cased."""
    return F.lower(F.regexp_replace(term, r"^[\s ]+|[\s ]+$", ""))


def body_words(papers: DataFrame) -> tuple[DataFrame, int]:
    """The words of the bodies of all papers, and the number of papers with a body, null ones left out."""
    bodies = one_per_paper(papers, F.col("body"))
    counted = word_counts(bodies.select("v0"))
    return counted, papers.where(F.col("body").isNotNull()).agg(F.count_distinct("paper_id")).first()[0]


def term_frequencies(papers: DataFrame, terms: DataFrame, rare_below: int = 3, common_share: float = 0.3) -> DataFrame:
    """(term_id, word, n_occurrences, n_papers, mark) of every row of ``terms``.

    The word is the term without outer spaces, lower-cased. A term that no body has, the empty and
    the null term count 0; the null term keeps a null word. Bodies count once per ``paper_id``.
    """
    counted, bodies = body_words(papers)
    named = terms.select("term_id", typed_word(F.col("term")).alias("word"))
    joined = named.join(by_shuffle(counted.select("word", "n_occurrences", F.col("n_texts").alias("n_papers"))), "word", "left").na.fill(0, ["n_occurrences", "n_papers"])
    return joined.select("term_id", "word", "n_occurrences", "n_papers", mark(F.col("n_papers"), rare_below, F.lit(common_share * bodies)).alias("mark"))


def vocabulary(papers: DataFrame, terms: DataFrame, rare_below: int = 3, common_share: float = 0.3) -> DataFrame:
    """(word, n_occurrences, n_papers, in_terms, mark) of every word of a body or of ``terms``."""
    counted, bodies = body_words(papers)
    typed = terms.select(typed_word(F.col("term")).alias("word")).where(F.length("word") > 0).distinct().withColumn("in_terms", F.lit(True))
    both = counted.select("word", "n_occurrences", F.col("n_texts").alias("n_papers")).join(by_shuffle(typed), "word", "full").na.fill(0, ["n_occurrences", "n_papers"]).na.fill(False, ["in_terms"])
    return both.select("word", "n_occurrences", "n_papers", "in_terms", mark(F.col("n_papers"), rare_below, F.lit(common_share * bodies)).alias("mark"))


def gram_frequencies(grams: DataFrame, idf: DataFrame, units: DataFrame, rare_below: int = 2, common_share: float = 0.3) -> DataFrame:
    """(gram_id, n, mark) of every gram: its df over all ``gram_id``s of the same two terms.

    A gram's df is the sum over its distinct (gram_id, run_id); rows repeated with another df give
    the larger. Grams without such a row count 0. Null term ids equal each other.
    """
    one, two = (F.coalesce(F.col(f"term_id_{i}").cast("string"), F.lit("")) for i in (1, 2))
    pair = grams.select("gram_id", F.concat_ws(" ", one, two).alias("word"))
    numbers = cut(dictionary(pair.select("word")))
    coded = cut(pair.join(by_shuffle(numbers), "word").select("gram_id", F.col("word_id").alias("id")))
    runs = idf.where(F.col("df").isNotNull()).groupBy("gram_id", "run_id").agg(F.max("df").alias("n"))
    gram_ids = coded.distinct()  # a gram_id may stand in several rows
    encoded = runs.join(by_shuffle(gram_ids), "gram_id").select("id", F.col("n").cast("long").alias("n"), F.lit(1).cast("long").alias("p"))
    summed = coded.join(by_shuffle(sums_by_range(encoded)), "id", "left").na.fill(0, ["n"])
    return summed.select("gram_id", "n", mark(F.col("n"), rare_below, F.lit(common_share * units.count())).alias("mark"))


def useless(papers: DataFrame, terms: DataFrame, grams: DataFrame, idf: DataFrame, units: DataFrame) -> DataFrame:
    """(kind, key_id, mark) of the terms and grams that are too rare or too common."""
    by_term = term_frequencies(papers, terms).where((F.length("word") > 0) & F.col("mark").isNotNull()).select(F.lit("term").alias("kind"), F.col("term_id").alias("key_id"), "mark")
    by_gram = gram_frequencies(grams, idf, units).where(F.col("mark").isNotNull()).select(F.lit("gram").alias("kind"), F.col("gram_id").alias("key_id"), "mark")
    return by_term.unionByName(by_gram)
