"""Queries on words, indexes and ranked search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import best, corpus, impact, index, lexical
from ..session import cut
from ..sources.sinks import envelope, result_line, with_titles
from ..sources.tables import table

#: Queries besides those taken from the documents: an unknown word, a repeated one, no word, marks, a blank start.
WRITTEN = [(-1, "zzunknown reward error"), (-2, "reward reward"), (-3, "!!"), (-4, "énergie système"), (-5, "  policy")]
EVERY = 50


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "parent_key")


def query_set(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, text): the first four words of every document whose id is divisible by 50, and the written ones."""
    head = F.array_join(F.slice(T.words(F.col("text")), 1, 4), " ")
    own = documents(spark, folder).where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), head.alias("text")).where("text is not null")
    return own.unionByName(spark.createDataFrame(WRITTEN, "query_id long, text string"))


def _counts(spark, folder):
    return _weighted(spark, folder).drop("lnc")


def _weighted(spark, folder):
    return index.weighted_terms(documents(spark, folder), "doc_id")  # doc_id is unique


def term_counts(spark, folder):
    return _counts(spark, folder)


def doc_freq(spark, folder):
    return index.document_frequency(_counts(spark, folder))


def lnc_weights(spark, folder):
    return _weighted(spark, folder).withColumn("lnc", F.round("lnc", 6))


def doc_norms(spark, folder):
    return index.vector_lengths(_counts(spark, folder), "doc_id").withColumn("length", F.round("length", 6))


def punct_stripped_tokens(spark, folder):
    own = documents(spark, folder).select("doc_id", F.posexplode(T.words(T.strip_punctuation(F.col("text")))).alias("pos", "token"))
    return own


def clean_text_sed(spark, folder):
    return documents(spark, folder).select("doc_id", T.wordlike(F.col("text")).alias("text"))


def collapse_ws(spark, folder):
    return documents(spark, folder).select("doc_id", T.collapsed(T.folded_case(F.col("text"))).alias("text"))


def ascii_fold(spark, folder):
    return documents(spark, folder).select("doc_id", T.plain_ascii(F.col("text")).alias("text"))


def sentence_tokens(spark, folder):
    return documents(spark, folder).select("doc_id", F.posexplode(T.sentence_words(F.col("text"))).alias("pos", "token"))


def query_ngrams(spark, folder):
    return lexical.query_grams(query_set(spark, folder))


def query_validity(spark, folder):
    rows = documents(spark, folder).select("doc_id", "text").unionByName(spark.createDataFrame(WRITTEN, "doc_id long, text string"))
    return rows.select("doc_id", T.valid_query(F.col("text")).alias("valid"))


def _idf(variant):
    def query(spark, folder):
        n = documents(spark, folder).count()
        df = index.document_frequency(_counts(spark, folder))
        return df.select("term", F.round(variant(F.lit(float(n)), F.col("df")), 6).alias("idf"))

    return query


def _scored(spark, folder):
    own = documents(spark, folder)
    postings = cut(index.weighted_terms(own, "doc_id"))
    df = index.document_frequency(postings).select(F.col("term").alias("term1"), F.lit("").alias("term2"), "df")
    vectors = lexical.query_vectors(lexical.query_grams(query_set(spark, folder)).join(df, ["term1", "term2"], "left"), own.count()).where("term2 = ''")
    return lexical.scores(vectors, postings.withColumnRenamed("term", "term1"), ["term1"], F.col("doc_id"))


def _best(spark, folder, n):
    """At least the ``n`` best of what :func:`_scored` has of each query, found in the texts; postings are neither kept nor moved."""
    return best.best(_asked_terms(spark, folder), index.word_lists(documents(spark, folder), "doc_id"), n, "doc_id", "long", index.text_postings)


def _asked_terms(spark, folder):
    """(query_id, term, w): what :func:`_scored` weighs the words of the queries with."""
    return query_weights(spark, folder, exact=True).where("term2 = ''").select("query_id", F.col("term1").alias("term"), F.col("ltc").alias("w"))


def query_weights(spark, folder, exact=False):
    own = documents(spark, folder)
    df = index.document_frequency(_counts(spark, folder)).select(F.col("term").alias("term1"), F.lit("").alias("term2"), "df")
    vectors = lexical.query_vectors(lexical.query_grams(query_set(spark, folder)).join(df, ["term1", "term2"], "left"), own.count())
    return vectors.select("query_id", "pos", "term1", "term2", (F.col("ltc") if exact else F.round("ltc", 6)).alias("ltc"))


def lexical_topk(spark, folder):
    return lexical.top(_best(spark, folder, 20), 20).select("query_id", "rank", F.col("doc").alias("doc_id"), "score")


def lexical_topk_zero_fill(spark, folder):
    universe = documents(spark, folder).select(F.col("doc_id").alias("doc"))
    valid = query_set(spark, folder).where(T.valid_query(F.col("text")))
    found = cut(lexical.top(_best(spark, folder, 20), 20).select("query_id", "doc", "score"))
    return lexical.zero_filled(found, valid, universe, 20).select("query_id", "rank", F.col("doc").alias("doc_id"), "score")


def lexical_paging(spark, folder):
    return lexical.top(_best(spark, folder, 10), 5, 5).select("query_id", "rank", F.col("doc").alias("doc_id"), "score")


def _units(spark, folder):
    return corpus.with_indexed_parent(corpus.sub_documents(table(spark, folder, "papers")))


def sub_documents(spark, folder):
    return _units(spark, folder)[0].select("text_id", F.col("doc_type").cast("int").alias("doc_type"), F.length("text").cast("long").alias("n_chars"), "parent")


def orphan_subdocs(spark, folder):
    return _units(spark, folder)[1].select("text_id", F.col("doc_type").cast("int").alias("doc_type"), "parent")


def subdocument_ids(spark, folder):
    code, parent = corpus.parse_text_id(F.col("text_id"))
    return table(spark, folder, "index_document").select("text_id", code.alias("doc_type"), parent.alias("parent"))


def field_weighted_batch(spark, folder):
    return lexical.search_units(query_set(spark, folder), _units(spark, folder)[0], n=10)


def field_weighted_topk(spark, folder):
    query = spark.createDataFrame([(0, "nonlinear reward of the zzunknown policy")], "query_id long, text string")
    return lexical.search_units(query, _units(spark, folder)[0], n=20)


def smooth_weighted_topk(spark, folder):
    query = spark.createDataFrame([(0, "nonlinear reward of the zzunknown policy")], "query_id long, text string")
    return lexical.search_units(query, _units(spark, folder)[0], n=20, idf=lexical.idf_smooth)


def index_search(spark, folder):
    tables = (table(spark, folder, t) for t in ("term", "gram", "idf", "tf", "index_document"))
    return lexical.search_stored(query_set(spark, folder), *tables, n=20)


def index_gram_df(spark, folder):
    named, df = lexical.stored_grams(*(table(spark, folder, t) for t in ("term", "gram", "idf")))
    return df


def search_envelope(spark, folder):
    return envelope(lexical.top(_best(spark, folder, 10), 10))


def result_lines(spark, folder):
    found = lexical.search_units(query_set(spark, folder), _units(spark, folder)[0], n=5)
    titles = corpus.one_row_per_paper(table(spark, folder, "papers"), "title").select(F.col("paper_id").alias("text_id"), "title")
    named = with_titles(found, titles)
    return named.select("query_id", "rank", result_line(F.col("rank"), F.col("score"), F.col("title")).alias("line"))


def _titles(spark, folder):
    return corpus.one_row_per_paper(table(spark, folder, "papers"), "title")


def bigram_index(spark, folder):
    return index.gram_counts(_titles(spark, folder), "paper_id", "title")


def gram_dictionary(spark, folder):
    df = bigram_index(spark, folder).groupBy("term1", "term2").agg(F.count(F.lit(1)).alias("df"))
    return index.numbered(df, ["term1", "term2"], "gram_id").select(F.col("gram_id").cast("long").alias("gram_id"), "term1", "term2", "df")


def term_insert(spark, folder):
    terms = table(spark, folder, "term")
    return index.insert_absent(terms.where("term_id < 500"), terms, "term", "term_id")


def merge_df(spark, folder):
    runs = table(spark, folder, "idf").groupBy("gram_id", "run_id").agg(F.max("df").alias("df"))
    return index.merge_counts(runs.where("run_id = 0"), runs.where("run_id > 0"), ["gram_id"], "df")


def document_upsert(spark, folder):
    """Rows whose number three divides are new, other even ones are in both tables; together the two hold every row."""
    units = table(spark, folder, "index_document")
    new = units.where("doc_id % 2 = 0 or doc_id % 3 = 0").withColumn("vec_length", F.col("vec_length") * 2).withColumn("doc_type", F.lit(9).cast("short"))
    merged = index.upsert(units.where("doc_id % 3 <> 0"), new, ["text_id"], ["vec_length"])
    return merged.select("doc_id", "text_id", F.round("vec_length", 6).alias("vec_length"), "parent_doc", F.col("doc_type").cast("int").alias("doc_type"))


def postings_upsert(spark, folder):
    tf = table(spark, folder, "tf").groupBy("gram_id", "doc_id").agg(F.max("lnc").alias("lnc"))
    new = tf.where("doc_id % 2 = 0 or doc_id % 3 = 0").withColumn("lnc", F.col("lnc") / 2)
    merged = index.upsert(tf.where("doc_id % 3 <> 0"), new, ["gram_id", "doc_id"], ["lnc"])
    return merged.select("gram_id", "doc_id", F.round("lnc", 6).alias("lnc"))


def postings_sorted(spark, folder):
    rows = _weighted(spark, folder).withColumn("lnc", F.round("lnc", 6))
    return index.posting_ranks(rows, "doc_id", "lnc").select("term", "rank", "doc_id", "lnc")


def posting_chunks(spark, folder):
    rows = _weighted(spark, folder).withColumn("lnc", F.round("lnc", 6))
    return index.posting_chunks(rows, "doc_id", "lnc", 50)


def term_stats(spark, folder):
    rows = _weighted(spark, folder).withColumn("lnc", F.round("lnc", 6))
    return index.term_stats(rows, "lnc")


def indexed_documents(spark, folder):
    return _counts(spark, folder).select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n"))


def _vectors(norm):
    def query(spark, folder):
        return impact.tfidf_vectors(_counts(spark, folder), "doc_id", norm).withColumn("val", F.round("val", 6))

    return query


def _query_counts(spark, folder):
    own = query_set(spark, folder).where(T.valid_query(F.col("text")))
    return own.select("query_id", F.explode(T.words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))


def _impact_source(spark, folder):
    """Vectors (doc_id, term, val) of the documents, and the source they are made of where they lie."""
    lists = index.word_lists(documents(spark, folder), "doc_id")
    vectors = lists.mapInArrow(index.impact_postings, "doc_id long, term string, x double").withColumnRenamed("x", "val")
    return vectors, (lists, index.impact_postings)


def impact_search(spark, folder):
    vectors, source = _impact_source(spark, folder)
    queries = _query_counts(spark, folder).select("query_id", "term", F.log1p("n").alias("val"))
    return impact.impact_search(queries, vectors, "doc_id", 10, source=source).withColumnRenamed("doc", "doc_id")


def impact_search_pruned(spark, folder):
    vectors, source = _impact_source(spark, folder)
    queries = _query_counts(spark, folder).select("query_id", "term", F.log1p("n").alias("val"))
    return impact.impact_search(queries, vectors, "doc_id", 10, share=0.7, source=source).withColumnRenamed("doc", "doc_id")


def porter_terms(spark, folder):
    from ..functions.stem import stems_of

    return stems_of(table(spark, folder, "term").select(F.lower(F.trim("term")).alias("term")))


def stemmed_counts(spark, folder):
    from ..functions.stem import stems_of

    counts = _counts(spark, folder)
    return counts.join(stems_of(counts), "term").groupBy("doc_id", "stem").agg(F.sum("n").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        term_counts, doc_freq, lnc_weights, doc_norms, punct_stripped_tokens, clean_text_sed, collapse_ws, ascii_fold, sentence_tokens, query_ngrams, query_validity, query_weights,
        lexical_topk, lexical_topk_zero_fill, lexical_paging, sub_documents, orphan_subdocs, subdocument_ids, field_weighted_batch, field_weighted_topk, smooth_weighted_topk,
        index_search, index_gram_df, search_envelope, result_lines, bigram_index, gram_dictionary, term_insert, merge_df, document_upsert, postings_upsert, postings_sorted,
        posting_chunks, term_stats, indexed_documents, impact_search, impact_search_pruned, porter_terms, stemmed_counts,
    )
} | {
    "idf_log": _idf(lexical.idf_log), "idf_smooth": _idf(lexical.idf_smooth), "idf_index": _idf(lexical.idf_index),
    "tfidf_unit_vectors": _vectors("l2"), "tfidf_l2sq_vectors": _vectors("l2sq"),
}

W = r"regexp_extract_all(translate(lower({}), 'ς', 'σ'), '[\p{{L}}\p{{N}}_]+')"
_PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
_WRITTEN = ", ".join(f"({i}, '{t}')" for i, t in WRITTEN)
Q = f"""qs AS (SELECT doc_id AS query_id, array_to_string(list_slice({W.format('text')}, 1, 4), ' ') AS text FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL
    UNION ALL SELECT * FROM (VALUES {_WRITTEN}) v(query_id, text)),
    valid AS (SELECT * FROM qs WHERE regexp_matches(text, '^ *[\\p{{L}}\\p{{N}}_]')),
    toks AS (SELECT query_id, {W.format('text')} AS t FROM valid),
    uni AS (SELECT query_id, unnest(range(len(t))) AS pos, t, len(t) AS n FROM toks),
    grams AS (SELECT query_id, CAST(pos AS INTEGER) AS pos, t[pos + 1] AS term1, '' AS term2 FROM uni
        UNION ALL SELECT query_id, CAST(n + pos AS INTEGER), t[pos + 1], t[pos + 2] FROM uni WHERE pos + 1 < n)"""
C = f"""words AS (SELECT doc_id, unnest({W.format('text')}) AS term FROM documents WHERE text IS NOT NULL),
    tc AS (SELECT doc_id, term, count(*) AS n FROM words GROUP BY ALL),
    dl AS (SELECT doc_id, sqrt(sum((1 + ln(n)) * (1 + ln(n)))) AS length FROM tc GROUP BY doc_id),
    lw AS (SELECT tc.doc_id, term, n, (1 + ln(n)) / length AS lnc FROM tc JOIN dl ON tc.doc_id = dl.doc_id),
    dfs AS (SELECT term, count(*) AS df FROM tc GROUP BY term)"""
V = """idfs AS (SELECT grams.*, ln((SELECT count(*) FROM documents) / CAST(greatest(coalesce(CASE WHEN term2 = '' THEN df END, 1), 1) AS DOUBLE)) AS idf FROM grams LEFT JOIN dfs ON term1 = dfs.term),
    lens AS (SELECT query_id, sqrt(sum(idf * idf)) AS len FROM idfs GROUP BY query_id),
    vecs AS (SELECT idfs.query_id, pos, term1, term2, CASE WHEN len > 0 THEN idf / len ELSE 0 END AS ltc FROM idfs JOIN lens ON idfs.query_id = lens.query_id)"""
S = """scored AS (SELECT query_id, doc_id, round(sum(lnc * ltc), 6) AS score FROM vecs JOIN lw ON term1 = lw.term AND term2 = '' GROUP BY ALL),
    ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored)"""
ONE = "one AS (SELECT paper_id, any_value(title) AS title, any_value(abstract) AS abstract, any_value(authors) AS authors, any_value(body) AS body FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id)"
U = f"""{ONE}, alls AS (
    SELECT paper_id AS text_id, 1 AS doc_type, body AS text, CAST(NULL AS VARCHAR) AS parent FROM one WHERE length(body) >= 1
    UNION ALL SELECT 'title_' || paper_id, 2, title, paper_id FROM one WHERE length(title) >= 3
    UNION ALL SELECT 'abstract_' || paper_id, 3, abstract, paper_id FROM one WHERE length(abstract) >= 3
    UNION ALL SELECT * FROM (SELECT 'authors_' || paper_id, 4, array_to_string(list_transform(authors, lambda a: concat_ws(' ', a.firstname, a.lastname)), '  ') AS text, paper_id FROM one) WHERE length(text) >= 1),
    units AS (SELECT * FROM alls WHERE parent IS NULL OR parent IN (SELECT text_id FROM alls WHERE doc_type = 1)),
    uw AS (SELECT text_id, unnest({W.format('text')}) AS term FROM units),
    utc AS (SELECT text_id, term, count(*) AS n FROM uw GROUP BY ALL),
    ul AS (SELECT text_id, sqrt(sum((1 + ln(n)) * (1 + ln(n)))) AS length FROM utc GROUP BY text_id),
    dfs AS (SELECT term, count(*) AS df FROM utc GROUP BY term)"""


def _fielded(queries: str, n: int, idf: str) -> str:
    return f"""WITH {queries}, {U},
        idfs AS (SELECT grams.*, {idf} AS idf FROM (SELECT grams.*, CASE WHEN term2 = '' THEN df END AS df, CAST((SELECT count(*) FROM units) AS DOUBLE) AS total FROM grams LEFT JOIN dfs ON term1 = dfs.term) grams),
        lens AS (SELECT query_id, sqrt(sum(idf * idf)) AS len FROM idfs GROUP BY query_id),
        vecs AS (SELECT idfs.query_id, term1, term2, CASE WHEN len > 0 THEN idf / len ELSE 0 END AS ltc FROM idfs JOIN lens ON idfs.query_id = lens.query_id),
        scored AS (SELECT query_id, coalesce(parent, units.text_id) AS doc, round(sum((1 + ln(n)) / length * ltc * CASE doc_type WHEN 1 THEN 0.4 ELSE 0.2 END), 6) AS score
            FROM vecs JOIN utc ON term1 = utc.term AND term2 = '' JOIN ul ON utc.text_id = ul.text_id JOIN units ON utc.text_id = units.text_id GROUP BY ALL)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM scored) WHERE rank <= {n}"""


_LOG = "ln(total / greatest(coalesce(df, 1), 1))"
_ONE_QUERY = Q.replace("qs AS (", "qs AS (SELECT 0 AS query_id, 'nonlinear reward of the zzunknown policy' AS text), unused AS (")
_TITLES = f"""{ONE}, tt AS (SELECT paper_id, {W.format('title')} AS t FROM one WHERE title IS NOT NULL), tu AS (SELECT paper_id, unnest(range(len(t))) AS pos, t, len(t) AS n FROM tt),
    tg AS (SELECT paper_id, t[pos + 1] AS term1, '' AS term2 FROM tu UNION ALL SELECT paper_id, t[pos + 1], t[pos + 2] FROM tu WHERE pos + 1 < n),
    gc AS (SELECT paper_id, term1, term2, count(*) AS n FROM tg GROUP BY ALL)"""
_IMPACT = f"""WITH {Q}, {C}, raw AS (SELECT doc_id, term, ln(1 + n) AS x FROM tc), vl AS (SELECT doc_id, sum(x * x) AS s FROM raw GROUP BY doc_id),
    vec AS (SELECT raw.doc_id, term, x / CASE WHEN s = 0 THEN 1 ELSE s END AS val FROM raw JOIN vl ON raw.doc_id = vl.doc_id),
    qc AS (SELECT query_id, term, ln(1 + count(*)) AS val FROM (SELECT query_id, unnest(t) AS term FROM toks) GROUP BY ALL),
    wq AS (SELECT query_id, qc.term, ln((SELECT count(DISTINCT doc_id) FROM tc) / CAST(df + 1 AS DOUBLE)) * val AS w FROM qc JOIN dfs ON qc.term = dfs.term)"""
_IMPACT_TAIL = """sc AS (SELECT query_id, doc_id, round(sum(w * val), 6) AS score FROM {} JOIN vec ON vec.term = {}.term GROUP BY ALL)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10"""
_STORED = """named AS (SELECT term_id, lower(trim(term)) AS word FROM term),
    gn AS (SELECT gram_id, a.word AS term1, b.word AS term2 FROM gram JOIN named a ON term_id_1 = a.term_id JOIN named b ON term_id_2 = b.term_id),
    runs AS (SELECT gram_id, run_id, max(df) AS df FROM idf GROUP BY ALL),
    gdf AS (SELECT term1, term2, CAST(sum(df) AS BIGINT) AS df FROM gn JOIN runs ON gn.gram_id = runs.gram_id GROUP BY ALL)"""
_LWR = "lwr AS (SELECT doc_id, term, round(lnc, 6) AS lnc FROM lw)"


def _marked(column: str) -> str:
    return f"translate({column}, '{T.MARKED}', '{T.PLAIN}')"


SQL = {
    "term_counts": f"WITH {C} SELECT * FROM tc",
    "doc_freq": f"WITH {C} SELECT * FROM dfs",
    "lnc_weights": f"WITH {C} SELECT doc_id, term, n, round(lnc, 6) AS lnc FROM lw",
    "doc_norms": f"WITH {C} SELECT doc_id, round(length, 6) AS length FROM dl",
    "punct_stripped_tokens": f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, t[pos + 1] AS token FROM (SELECT doc_id, t, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {W.format(f'translate(text, {_PUNCT}, $$$$)').replace('$$$$', chr(39) * 2)} AS t FROM documents WHERE text IS NOT NULL))",
    "clean_text_sed": "SELECT doc_id, " + "".join("regexp_replace(" for _ in T.WORDLIKE) + "text" + "".join(f", '{p}', '{to}', 'g')" for p, to in T.WORDLIKE) + " AS text FROM documents",
    "collapse_ws": r"SELECT doc_id, regexp_replace(lower(translate(lower(text), 'ς', 'σ')), '[\s\x0b]+', ' ', 'g') AS text FROM documents",
    "ascii_fold": rf"SELECT doc_id, lower(regexp_replace({_marked('text')}, '[^\x00-\x7f]', '', 'g')) AS text FROM documents",
    "sentence_tokens": r"""WITH c AS (SELECT doc_id, string_split(regexp_replace(text, '(\r\n|[\n\r\x{85}\x{2028}\x{2029}])$', ''), ' ') AS c FROM documents WHERE text IS NOT NULL),
        t AS (SELECT doc_id, list_filter(list_transform(c, lambda x: regexp_extract(x, '([\p{L}\p{N}_]+|\.)$', 1)), lambda x: x <> '') AS t FROM c)
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, t[pos + 1] AS token FROM (SELECT doc_id, t, unnest(range(len(t))) AS pos FROM t)""",
    "search_envelope": f"""WITH {Q}, {C}, {V}, {S}, page AS (SELECT * FROM ranked WHERE rank <= 10)
        SELECT query_id, '{{"errno":0,"errstr":"","numResults":' || count(*) || ',"results":[' || string_agg('{{"_id":"' || doc_id || '","score":' || score || '}}', ',' ORDER BY rank) || ']}}' AS json FROM page GROUP BY query_id""",
    "result_lines": f"""WITH found AS ({_fielded(Q, 5, _LOG)}), titles AS (SELECT paper_id, any_value(title) AS title FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id)
        SELECT query_id, rank, lpad(CAST(rank AS VARCHAR), 3, ' ') || '  ' || CAST(CAST(round(CAST(score AS DECIMAL(18, 6)), 5) AS DECIMAL(18, 5)) AS VARCHAR) || '  ' || regexp_replace(coalesce(CASE WHEN length(doc) = 24 THEN title END, ''), '[ ]*\n[ ]*', ' ', 'g') AS line
        FROM found LEFT JOIN titles ON doc = paper_id""",
    "query_ngrams": f"WITH {Q} SELECT * FROM grams",
    "query_validity": rf"SELECT doc_id, coalesce(regexp_matches(text, '^ *[\p{{L}}\p{{N}}_]'), false) AS valid FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_WRITTEN}) v(doc_id, text))",
    "query_weights": f"WITH {Q}, {C}, {V} SELECT query_id, pos, term1, term2, round(ltc, 6) AS ltc FROM vecs",
    "idf_log": f"WITH {C} SELECT term, round(ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE)), 6) AS idf FROM dfs",
    "idf_smooth": f"WITH {C} SELECT term, round(ln(1 + (SELECT count(*) FROM documents) / CAST(df + 1 AS DOUBLE)), 6) AS idf FROM dfs",
    "idf_index": f"WITH {C} SELECT term, round(ln((SELECT count(*) FROM documents) / CAST(df + 1 AS DOUBLE)), 6) AS idf FROM dfs",
    "lexical_topk": f"WITH {Q}, {C}, {V}, {S} SELECT * FROM ranked WHERE rank <= 20",
    "lexical_paging": f"WITH {Q}, {C}, {V}, {S} SELECT * FROM ranked WHERE rank BETWEEN 6 AND 10",
    "lexical_topk_zero_fill": f"""WITH {Q}, {C}, {V}, {S}, every AS (SELECT query_id, documents.doc_id, coalesce(scored.score, 0) AS score FROM valid CROSS JOIN documents LEFT JOIN scored USING (query_id, doc_id))
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM every) WHERE rank <= 20""",
    "sub_documents": f"WITH {U} SELECT text_id, doc_type, length(text) AS n_chars, parent FROM units",
    "orphan_subdocs": f"WITH {U} SELECT text_id, doc_type, parent FROM alls WHERE parent IS NOT NULL AND parent NOT IN (SELECT text_id FROM alls WHERE doc_type = 1)",
    "subdocument_ids": "SELECT text_id, CASE split_part(text_id, '_', 1) WHEN 'fulltext' THEN 1 WHEN 'title' THEN 2 WHEN 'abstract' THEN 3 WHEN 'authors' THEN 4 WHEN 'wiki' THEN 5 END AS doc_type, split_part(text_id, '_', -1) AS parent FROM index_document",
    "field_weighted_batch": _fielded(Q, 10, _LOG),
    "field_weighted_topk": _fielded(_ONE_QUERY, 20, _LOG),
    "smooth_weighted_topk": _fielded(_ONE_QUERY, 20, "ln(1 + total / (coalesce(df, 0) + 1))"),
    "index_gram_df": f"WITH {_STORED} SELECT * FROM gdf",
    "index_search": f"""WITH {Q}, {_STORED},
        idfs AS (SELECT query_id, grams.term1, grams.term2, ln((SELECT count(*) FROM index_document) / CAST(greatest(coalesce(df, 1), 1) AS DOUBLE)) AS idf FROM grams LEFT JOIN gdf ON grams.term1 = gdf.term1 AND grams.term2 = gdf.term2),
        lens AS (SELECT query_id, sqrt(sum(idf * idf)) AS len FROM idfs GROUP BY query_id),
        vecs AS (SELECT idfs.query_id, term1, term2, CASE WHEN len > 0 THEN idf / len ELSE 0 END AS ltc FROM idfs JOIN lens ON idfs.query_id = lens.query_id),
        post AS (SELECT gram_id, doc_id, max(lnc) AS lnc FROM tf GROUP BY ALL),
        scored AS (SELECT query_id, coalesce(parent_doc, post.doc_id) AS doc, round(coalesce(sum(lnc * ltc * CASE doc_type WHEN 1 THEN 0.4 WHEN 5 THEN 0.4 WHEN 2 THEN 0.2 WHEN 3 THEN 0.2 WHEN 4 THEN 0.2 ELSE 0 END), 0), 6) AS score
            FROM vecs JOIN gn ON vecs.term1 = gn.term1 AND vecs.term2 = gn.term2 JOIN post ON gn.gram_id = post.gram_id JOIN index_document ON post.doc_id = index_document.doc_id GROUP BY ALL)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM scored) WHERE rank <= 20""",
    "bigram_index": f"WITH {_TITLES} SELECT * FROM gc",
    "gram_dictionary": f"WITH {_TITLES} SELECT row_number() OVER (ORDER BY term1, term2) - 1 AS gram_id, term1, term2, count(*) AS df FROM gc GROUP BY term1, term2",
    "term_insert": """WITH old AS (SELECT term_id, term FROM term WHERE term_id < 500), fresh AS (SELECT DISTINCT term FROM term WHERE term IS NOT NULL AND term NOT IN (SELECT term FROM old))
        SELECT * FROM old UNION ALL SELECT (SELECT max(term_id) FROM old) + row_number() OVER (ORDER BY term), term FROM fresh""",
    "merge_df": "SELECT gram_id, CAST(sum(df) AS BIGINT) AS df FROM (SELECT gram_id, run_id, max(df) AS df FROM idf GROUP BY ALL) GROUP BY gram_id",
    "document_upsert": """SELECT doc_id, text_id, round(CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN vec_length * 2 ELSE vec_length END, 6) AS vec_length, parent_doc,
        CAST(CASE WHEN doc_id % 3 = 0 THEN 9 ELSE doc_type END AS INTEGER) AS doc_type FROM index_document""",
    "postings_upsert": "SELECT gram_id, doc_id, round(CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN max(lnc) / 2 ELSE max(lnc) END, 6) AS lnc FROM tf GROUP BY gram_id, doc_id",
    "postings_sorted": f"WITH {C}, {_LWR} SELECT term, row_number() OVER (PARTITION BY term ORDER BY lnc DESC, doc_id) AS rank, doc_id, lnc FROM lwr",
    "posting_chunks": f"""WITH {C}, {_LWR} SELECT term, chunk, count(*) AS size, max(lnc) AS max_val, min(lnc) AS min_val
        FROM (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY lnc DESC, doc_id) - 1) // 50 AS chunk FROM lwr) GROUP BY term, chunk""",
    "term_stats": f"WITH {C}, {_LWR} SELECT term, count(*) AS df, max(lnc) AS max_val, min(lnc) AS min_val FROM lwr GROUP BY term",
    "indexed_documents": f"WITH {C} SELECT count(DISTINCT doc_id) AS n FROM tc",
    "tfidf_unit_vectors": f"WITH {C}, raw AS (SELECT doc_id, term, ln(1 + n) AS x FROM tc) SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS val FROM raw",
    "tfidf_l2sq_vectors": f"WITH {C}, raw AS (SELECT doc_id, term, ln(1 + n) AS x FROM tc) SELECT doc_id, term, round(x / sum(x * x) OVER (PARTITION BY doc_id), 6) AS val FROM raw",
    "impact_search": f"{_IMPACT}, {_IMPACT_TAIL.format('wq', 'wq')}",
    "impact_search_pruned": f"""{_IMPACT}, running AS (SELECT *, coalesce(sum(abs(w)) OVER (PARTITION BY query_id ORDER BY abs(w) DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar,
        sum(abs(w)) OVER (PARTITION BY query_id) AS entire FROM wq), kept AS (SELECT query_id, term, w FROM running WHERE sofar < 0.7 * entire), {_IMPACT_TAIL.format('kept', 'kept')}""",
}
