"""TF-IDF vectors, smoothing over word neighbours, and search by impact."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, by_shuffle, cut
from .best import best, frequencies, gathered
from .lexical import top


def tfidf_vectors(counts: DataFrame, key: str, norm: str = "l2") -> DataFrame:
    """(key, term, val): ln(1 + n), divided by the vector's length ('l2'), by its square ('l2sq'), or not ('none')."""
    raw = counts.withColumn("x", F.log1p("n"))
    if norm == "none":
        return raw.select(key, "term", F.col("x").alias("val"))
    square = F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key))
    by = F.sqrt(square) if norm == "l2" else square
    return raw.select(key, "term", (F.col("x") / F.when(by == 0, 1.0).otherwise(by)).alias("val"))


def token_positions(tokens: DataFrame, key: str) -> DataFrame:
    """(key, pos, term) of rows (key, tokens)."""
    return tokens.select(key, F.posexplode("tokens").alias("pos", "term"))


def smoothed_counts(positions: DataFrame, neighbours: DataFrame, key: str) -> DataFrame:
    """(key, term, val): ln(1 + v), v being a count smoothed over word neighbours in the order of the text.

    A word adds 1 to itself; its neighbours (term, near, dist) are then set to 1 / dist, whatever
    they had. So a value is that of the last setting plus the occurrences after it. Neighbours at
    distance 0, the word itself among them, are passed over. Where ``positions`` come from texts spread
    by key and the neighbours are few, nothing but the texts is shuffled.
    """
    own = broadcast_if_small(neighbours.where((F.col("term") != F.col("near")) & (F.col("dist") > 0)))
    settings = positions.join(own, "term").select(key, F.col("near").alias("term"), "pos", "dist")
    events = positions.select(key, "term", "pos", F.lit(None).cast("double").alias("dist")).unionByName(settings)
    last = F.when(F.col("dist").isNotNull(), F.struct("pos", -F.col("dist")))
    seen = F.collect_list(F.when(F.col("dist").isNull(), F.col("pos")))  # the places of one term in one text
    both = events.groupBy(key, "term").agg(F.max(last).alias("last"), seen.alias("seen"))
    later = F.size(F.filter("seen", lambda p: F.col("last").isNull() | (p > F.col("last.pos"))))
    value = F.coalesce(-1 / F.col("last.col2"), F.lit(0.0)) + later
    return both.select(key, "term", F.log1p(value).alias("val"))


def smoothed_postings(neighbours: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes rows (key, words) of whole texts to postings (key, term, x), as :func:`impact_search` takes it for its source.

    x is what :func:`smoothed_counts` gives for the words that are a ``term`` of the neighbours, divided by
    the square of the text's length. The neighbours (term, near, dist) are sent to all tasks, so they have to be few.
    """
    rows = neighbours.groupBy("term", "near").agg(F.min("dist").alias("dist")).toArrow()
    term, near = (rows.column(c).combine_chunks().cast(pa.string()) for c in ("term", "near"))
    names = pc.unique(pa.concat_arrays([term, near]))
    source, target = (pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (term, near))
    dist = rows.column("dist").to_numpy()
    known = np.zeros(max(1, len(names)), bool)
    known[source] = True
    used = (source != target) & (dist > 0)
    order = np.flatnonzero(used)[np.argsort(source[used], kind="stable")]
    target, dist = target[order], dist[order]
    begin = np.append(0, np.cumsum(np.bincount(source[order], minlength=len(known))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(known)
        for batch in batches:
            lists = batch.column(1)
            words = lists.flatten().dictionary_encode()
            code = np.append(pc.index_in(words.dictionary.cast(pa.string()), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), -1)
            code = code[words.indices.fill_null(len(words.dictionary)).to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(lists)), np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))
            place = np.flatnonzero((code >= 0) & known[code])  # rising with row and position
            row, code = row[place], code[place]
            n = begin[code + 1] - begin[code]
            entry = np.repeat(begin[code] - np.cumsum(n) + n, n) + np.arange(n.sum())  # the neighbours of each place
            set_in, set_at = np.repeat(row, n) * width + target[entry], np.repeat(place, n)
            by = np.argsort(set_in, kind="stable")
            last = by[np.flatnonzero(np.append(set_in[by][1:] != set_in[by][:-1], True))] if len(by) else by  # each cell's last setting
            own = row * width + code
            cells = np.unique(np.concatenate([own, set_in[last]]))
            value, after = np.zeros(len(cells)), np.full(len(cells), -1)
            at = np.searchsorted(cells, set_in[last])
            value[at], after[at] = 1 / dist[entry[last]], set_at[last]
            mine = np.searchsorted(cells, own)
            val = np.log1p(value + np.bincount(mine, place > after[mine], len(cells)))
            rows = cells // width
            square = np.bincount(rows, val * val, len(lists))[rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), names.take(pa.array(cells % width)), pa.array(val / np.where(square == 0, 1.0, square))], [batch.schema.names[0], "term", "x"])

    return run


def impact_search(queries: DataFrame, vectors: DataFrame, key: str, n: int = 10, offset: int = 0, share: float = 1.0, source: tuple | None = None) -> DataFrame:
    """(query_id, rank, doc, score) of the documents that score best for query vectors (query_id, term, val).

    A term weighs ln(N / (df + 1)) * val; every posting of every term is scored, so the result is
    exact. ``share`` below 1 keeps only the weightiest terms of a query that together have that
    share of its weight, which is faster and approximate. Terms without postings add nothing.
    Only the best of each block of documents are moved. ``source`` (rows, function) is what the vectors are
    made of, as :func:`best` takes it; without it the vectors are put together by document.
    """
    if source:
        asked = queries.select("term").distinct().withColumn("asked", F.lit(True))
        counted = cut(frequencies(source[0], key, source[1]).join(by_shuffle(asked), "term", "left").where("asked or docs > 0"))
        total, df = counted.agg(F.sum("docs")).first()[0], counted.where("asked").select("term", "df")
    else:
        total = vectors.select(key).distinct().count()
        df = vectors.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = queries.join(df, "term").withColumn("w", F.log(F.lit(float(total)) / (F.col("df") + 1)) * F.col("val"))
    if share < 1:
        size = F.abs("w")
        before = F.sum(size).over(Window.partitionBy("query_id").orderBy(F.desc(size), "term").rowsBetween(Window.unboundedPreceding, -1))
        weighed = weighed.withColumn("before", F.coalesce(before, F.lit(0.0))).withColumn("whole", F.sum(size).over(Window.partitionBy("query_id"))).where(F.col("before") < share * F.col("whole"))
    rows, before = source or (gathered(vectors.select(key, "term", F.col("val").alias("x")), key), None)
    scored = best(weighed.select("query_id", "term", "w"), rows, n + offset, key, vectors.schema[key].dataType.simpleString(), before)
    return top(scored, n, offset).select("query_id", "rank", "doc", "score")
