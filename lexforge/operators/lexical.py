"""Ranked lexical search: weighted query grams against weighted postings, many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grams, valid_query, words
from ..session import broadcast_if_small, by_shuffle, cut
from .best import best, gathered

#: Weights of the unit types; a wiki text counts as a full text.
WEIGHTS = {1: 0.4, 2: 0.2, 3: 0.2, 4: 0.2, 5: 0.4}


def query_grams(queries: DataFrame) -> DataFrame:
    """(query_id, pos, term1, term2) of the valid queries (query_id, text): words, then pairs, repeats kept."""
    valid = queries.where(valid_query(F.col("text")))
    return valid.select("query_id", F.explode(grams(words(F.col("text")))).alias("g")).select("query_id", "g.pos", "g.term1", "g.term2")


def idf_log(n: Column, df: Column) -> Column:
    """ln(N / df), an unknown gram's df being 1."""
    return F.log(n / F.greatest(F.coalesce(df, F.lit(1)), F.lit(1)))


def idf_smooth(n: Column, df: Column) -> Column:
    return F.log(1 + n / (F.coalesce(df, F.lit(0)) + 1))


def idf_index(n: Column, df: Column) -> Column:
    """ln(N / (df + 1)), negative for a gram that nearly all units have."""
    return F.log(n / (F.coalesce(df, F.lit(0)) + 1))


def query_vectors(found: DataFrame, n: int, idf=idf_log) -> DataFrame:
    """Query grams with their df as unit vectors: adds ltc, 0 where the query has no weight at all.

    Grams that no text has count in the length, so a query with unknown words scores lower overall.
    """
    weighed = found.withColumn("idf", idf(F.lit(float(n)), F.col("df")))
    length = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("query_id")))
    return weighed.withColumn("ltc", F.when(length > 0, F.col("idf") / length).otherwise(0.0))


def type_weight(doc_type: Column, weights: dict[int, float]) -> Column:
    out = F.lit(0.0)
    for code, weight in weights.items():
        out = F.when(doc_type == code, float(round(weight, 4))).otherwise(out)
    return out


def scores(vectors: DataFrame, postings: DataFrame, on: list[str], owner: Column, weight: Column | None = None) -> DataFrame:
    """(query_id, doc, score): products of query and text weights summed by owner.

    Equal grams of one query are added up before the join, and products are pre-aggregated before
    they are shuffled by owner. A batch of queries whose size allows it goes to the postings, which
    then aren't shuffled by gram.
    """
    grouped = broadcast_if_small(vectors.groupBy("query_id", *on).agg(F.sum("ltc").alias("ltc")))
    part = F.col("lnc") * F.col("ltc") * (weight if weight is not None else F.lit(1.0))
    return grouped.join(postings, on).groupBy("query_id", owner.alias("doc")).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("score"))


def top(scored: DataFrame, n: int = 20, offset: int = 0, key: str = "doc", by: str = "query_id") -> DataFrame:
    """The rows ranked offset + 1 to offset + n of each query: by score to six places, then by id. n = 0 means 10."""
    n = n or 10
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 6)), key)
    ranked = scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= offset + n) & (F.col("rank") > offset))
    return ranked.withColumn("score", F.round("score", 6))


def zero_filled(scored: DataFrame, queries: DataFrame, universe: DataFrame, n: int = 20) -> DataFrame:
    """The top n of each query with unmatched documents at score 0 where fewer than n match.

    Only the 2n smallest ids can be needed for that, so those alone are set against the queries.
    """
    best = top(scored.where(F.round("score", 6) > 0), n)
    spare = universe.select(F.col("doc")).orderBy("doc").limit(2 * n)
    few = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"))
    short = queries.select("query_id").distinct().join(few, "query_id", "left").where(F.coalesce("c", F.lit(0)) < n).select("query_id", F.lit(1).alias("_k"))
    filled = short.join(F.broadcast(spare.withColumn("_k", F.lit(1))), "_k").drop("_k")  # 2n rows
    zero = filled.join(best.select("query_id", "doc"), ["query_id", "doc"], "left_anti").withColumn("score", F.lit(0.0))
    return top(best.select("query_id", "doc", "score").unionByName(zero), n)


def stored_grams(terms: DataFrame, gram: DataFrame, idf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words of a stored index by name: (gram_id, term1, term2), and (term1, term2, df).

    Terms that differ in case or outer spaces are one word, and all gram_ids of the same two words
    are one gram, whose df is the sum over its distinct (gram_id, run_id).
    """
    named = terms.select("term_id", F.lower(F.trim("term")).alias("word"))
    a, b = named.toDF("term_id_1", "term1"), named.toDF("term_id_2", "term2")
    grams_named = gram.select("gram_id", "term_id_1", "term_id_2").join(a, "term_id_1").join(b, "term_id_2").select("gram_id", "term1", "term2")
    runs = idf.groupBy("gram_id", "run_id").agg(F.max("df").alias("df"))
    df = grams_named.join(runs, "gram_id").groupBy("term1", "term2").agg(F.sum("df").alias("df"))
    return grams_named, df


def search_stored(queries: DataFrame, terms: DataFrame, gram: DataFrame, idf: DataFrame, tf: DataFrame, units: DataFrame, weights: dict[int, float] | None = None, n: int = 20) -> DataFrame:
    """(query_id, rank, doc, score) from a stored index; units count for their parent.

    Repeated postings count once, with the largest weight; postings with a null weight add nothing.
    ``doc`` is the internal number of the document; :func:`with_text_id` names it.
    """
    named, df = stored_grams(terms, gram, idf)
    vectors = query_vectors(query_grams(queries).join(df, ["term1", "term2"], "left"), units.count())
    wanted = named.join(vectors.select("query_id", "term1", "term2", "ltc"), ["term1", "term2"]).groupBy("query_id", "gram_id").agg(F.sum("ltc").alias("ltc"))
    wanted = cut(wanted)
    known = broadcast_if_small(wanted.select("gram_id").distinct())
    postings = tf.join(known, "gram_id", "left_semi").select("gram_id", "doc_id", "lnc").repartition("doc_id").groupBy("gram_id", "doc_id").agg(F.max("lnc").alias("lnc"))
    typed = postings.join(by_shuffle(units.select("doc_id", "parent_doc", "doc_type")), "doc_id")
    rows = typed.select(F.coalesce("parent_doc", "doc_id").alias("doc"), F.col("gram_id").alias("term"), (F.col("lnc") * type_weight(F.col("doc_type"), weights or WEIGHTS)).alias("x"))
    scored = best(wanted.select("query_id", F.col("gram_id").alias("term"), F.col("ltc").alias("w")), gathered(rows), n or 10, "doc", rows.schema["doc"].dataType.simpleString())
    return top(scored, n).select("query_id", "rank", "doc", "score")


def with_text_id(ranked: DataFrame, units: DataFrame, key: str = "doc") -> DataFrame:
    """Ranked rows with the ``text_id`` of their documents, null for a number that ``units`` (doc_id, text_id) lacks."""
    names = units.select(F.col("doc_id").alias(key), "text_id").join(broadcast_if_small(ranked.select(key).distinct()), key, "left_semi")
    return ranked.join(by_shuffle(names), key, "left").select(*ranked.columns, "text_id")


def doc_ids_of(texts: DataFrame, units: DataFrame) -> DataFrame:
    """(text_id, doc_id, parent_doc) of the rows of ``texts`` (text_id); numbers are null where ``units`` doesn't have the text.

    A text_id that repeats in ``texts`` comes out once.
    """
    asked = texts.select("text_id").distinct()
    known = units.select("text_id", "doc_id", "parent_doc").join(broadcast_if_small(asked), "text_id", "left_semi")
    return asked.join(by_shuffle(known), "text_id", "left").select("text_id", "doc_id", "parent_doc")


class UnitIndex:
    """An index of units (text_id, doc_type, text, parent), built once and asked as often as wanted.

    Postings, document frequencies and what is known of each unit are written to the checkpoint
    folder; texts are read once, and a query meets none.
    """

    def __init__(self, units: DataFrame):
        from .index import document_frequency, weighted_terms

        self.about = cut(units.select("text_id", "doc_type", "parent"))
        self.postings = cut(weighted_terms(units, "text_id"))
        self.df = cut(document_frequency(self.postings))
        self.size = self.about.count()


def _search_texts(queries: DataFrame, units: DataFrame, weights: dict[int, float], n: int, idf) -> DataFrame:
    """What :func:`search_units` gives, without an index."""
    from .index import document_frequency, unit_postings, weighted_terms

    df = document_frequency(weighted_terms(units, "text_id")).select(F.col("term").alias("term1"), F.lit("").alias("term2"), "df")
    vectors = query_vectors(query_grams(queries).join(by_shuffle(df), ["term1", "term2"], "left"), units.count(), idf).where("term2 = ''")
    owned = units.where("text is not null").select(F.coalesce("parent", "text_id").alias("doc"), type_weight(F.col("doc_type"), weights).alias("weight"), "text")
    lists = gathered(owned).select("doc", "weight", words(F.col("text")).alias("t"))
    scored = best(vectors.select("query_id", F.col("term1").alias("term"), F.col("ltc").alias("w")), lists, n, "doc", lists.schema["doc"].dataType.simpleString(), unit_postings)
    return top(scored, n).select("query_id", "rank", "doc", "score")


def search_units(queries: DataFrame, units: DataFrame | UnitIndex, weights: dict[int, float] | None = None, n: int = 10, idf=idf_log) -> DataFrame:
    """(query_id, rank, doc, score) over units (text_id, doc_type, text, parent) or an index of them.

    In an index units are scored first and meet their type and parent only then, as few of them match.
    Otherwise the units of a parent are put together, texts and all, and only each block's best are moved.
    """
    if not isinstance(units, UnitIndex):
        return _search_texts(queries, units, weights or WEIGHTS, n or 10, idf)
    index = units
    df = index.df.select(F.col("term").alias("term1"), F.lit("").alias("term2"), "df")
    vectors = query_vectors(query_grams(queries).join(df, ["term1", "term2"], "left"), index.size, idf).where("term2 = ''")
    matched = scores(vectors, index.postings.select(F.col("term").alias("term1"), "text_id", "lnc"), ["term1"], F.col("text_id"))
    typed = matched.withColumnRenamed("doc", "text_id").join(index.about, "text_id")
    weighed = F.col("score") * type_weight(F.col("doc_type"), weights or WEIGHTS)
    scored = typed.groupBy("query_id", F.coalesce("parent", "text_id").alias("doc")).agg(F.sum(weighed).alias("score"))
    return top(scored, n).select("query_id", "rank", "doc", "score")
