"""Queries on vectors, recommendations, learning to rank, training samples, accounts and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import accounts, best, impact, index, lexical, neighbours, paragraphs, ranking, recommend, training
from ..session import broadcast_if_small, cut, spread
from ..sources.tables import table
from .scratch import scratch
from .search import EVERY, C, Q, W, _IMPACT, _asked_terms, _best, _impact_source, _query_counts, _scored, documents, query_set

#: Documents stand for the items of the events, whose ids are taken modulo the number of documents.
_ITEMS = "(SELECT count(*) FROM documents)"


def _embeddings(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _asked(spark, folder):
    return _embeddings(spark, folder).where(F.col("id") % EVERY == 0)


def neighbor_table(spark, folder):
    own = _embeddings(spark, folder)
    return neighbours.nearest(own, own, 3).withColumn("value", F.round("value", 6)).withColumnRenamed("value", "d2")


def nearest_by_euclid(spark, folder):
    return neighbours.nearest(_asked(spark, folder), _embeddings(spark, folder), 10).select("src_id", "rank", "dst_id", F.round(-F.sqrt("value"), 5).alias("score"))


def nearest_by_dot(spark, folder):
    return neighbours.nearest(_asked(spark, folder), _embeddings(spark, folder), 10, "dot").select("src_id", "rank", "dst_id", F.round("value", 6).alias("score"))


def inv_sq_similarity(spark, folder):
    own = neighbours.nearest(_asked(spark, folder), _embeddings(spark, folder), 5)
    return own.where("src_id <> dst_id").select("src_id", "dst_id", F.round(V.inverse_square(F.col("value")), 4).alias("similarity"))


def vector_sum_query(spark, folder):
    chosen = table(spark, folder, "embeddings").where(F.col("vec_id") % EVERY < 2).select(F.floor(F.col("vec_id") / EVERY).alias("id"), "vec_id")
    sums = neighbours.vector_sum(chosen, _embeddings(spark, folder))
    return neighbours.nearest(sums, _embeddings(spark, folder), 5).select("src_id", "rank", "dst_id", F.round("value", 6).alias("d2"))


def unit_vectors(spark, folder):
    return _embeddings(spark, folder).select("id", F.posexplode(V.unit(F.col("v"))).alias("i", "x")).withColumn("x", F.round("x", 6))


def sparse_to_dense(spark, folder):
    thinned = F.transform("v", lambda x: F.when(F.abs(x) < 0.1, 0.0).otherwise(x.cast("double")))
    sparse = _embeddings(spark, folder).select("id", V.to_sparse(thinned).alias("s"))
    return sparse.select("id", F.posexplode(V.to_dense(F.col("s"), 64)).alias("i", "x")).withColumn("x", F.round("x", 6))


def dense_to_sparse(spark, folder):
    thinned = F.transform("v", lambda x: F.when(F.abs(x) < 0.1, 0.0).otherwise(x.cast("double")))
    return _embeddings(spark, folder).select("id", F.explode(V.to_sparse(thinned)).alias("s")).select("id", "s.i", F.round("s.x", 6).alias("x"))


def repeated_vectors(spark, folder):
    return _embeddings(spark, folder).select("id", F.posexplode(V.repeated_to(F.slice("v", 1, 10), 64)).alias("i", "x")).select("id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


def char_windows(spark, folder):
    own = table(spark, folder, "part").select("p_partkey", F.posexplode(T.character_windows(F.col("p_name"))).alias("i", "w"))
    return own.select("p_partkey", "i", *[F.get("w", F.lit(k)).alias(f"c{k}") for k in range(3)])


def ann_lsh(spark, folder):
    return neighbours.nearest_by_hashing(_asked(spark, folder), _embeddings(spark, folder), 10).withColumn("value", F.round("value", 6))


def svd_2d(spark, folder):
    return neighbours.two_components(_embeddings(spark, folder))


def _word_neighbours(spark, folder):
    """(term, near, dist): the most frequent words stand for the embeddings in order, three neighbours each, itself among them."""
    counts = index.weighted_terms(documents(spark, folder), "doc_id").groupBy("term").agg(F.sum("n").alias("n"))
    size = table(spark, folder, "embeddings").count()
    named = index.numbered(counts.orderBy(F.desc("n"), "term").limit(size).withColumn("o", -F.col("n")), ["o", "term"], "id").select("id", "term")
    own = _embeddings(spark, folder)
    near = neighbours.nearest(own, own, 3).select("src_id", "dst_id", F.sqrt("value").alias("dist"))
    return near.join(named.select(F.col("id").alias("src_id"), "term"), "src_id").join(named.select(F.col("id").alias("dst_id"), F.col("term").alias("near")), "dst_id").select("term", "near", "dist")


def _smoothed(spark, folder):
    near = cut(_word_neighbours(spark, folder))
    tokens = documents(spark, folder).where("text is not null").select("doc_id", T.words(F.col("text")).alias("tokens")).repartition("doc_id")
    known = broadcast_if_small(near.select("term").distinct())
    return impact.smoothed_counts(impact.token_positions(tokens, "doc_id").join(known, "term", "left_semi"), near, "doc_id"), near


def smoothed_tfidf(spark, folder):
    return _smoothed(spark, folder)[0].withColumn("val", F.round("val", 6))


#: Rows of word neighbours that are sent to all tasks; with more of them smoothed vectors are kept and moved.
SENT_NEIGHBOURS = 200_000


def _smoothed_source(spark, folder):
    """Smoothed vectors (doc_id, term, val) divided by the square of their length, the source they are made of where the texts lie, and the neighbours."""
    near = cut(_word_neighbours(spark, folder))
    if near.count() <= SENT_NEIGHBOURS:
        lists, made = index.word_lists(documents(spark, folder), "doc_id"), impact.smoothed_postings(near)
        return lists.mapInArrow(made, "doc_id long, term string, x double").withColumnRenamed("x", "val"), (lists, made), near
    from pyspark.sql import Window

    raw = cut(_smoothed(spark, folder)[0])
    square = F.sum(F.col("val") * F.col("val")).over(Window.partitionBy("doc_id"))
    return raw.withColumn("s", square).select("doc_id", "term", (F.col("val") / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("val")), None, near


def smoothed_search(spark, folder):
    vectors, source, near = _smoothed_source(spark, folder)
    tokens = query_set(spark, folder).where(T.valid_query(F.col("text"))).select("query_id", T.words(F.col("text")).alias("tokens"))
    asked = impact.token_positions(tokens, "query_id").join(near.select("term").distinct(), "term", "left_semi")
    return impact.impact_search(impact.smoothed_counts(asked, near, "query_id"), vectors, "doc_id", 10, source=source).withColumnRenamed("doc", "doc_id")


def _doc_vectors(spark, folder):
    return cut(impact.tfidf_vectors(index.weighted_terms(documents(spark, folder), "doc_id"), "doc_id", "l2sq"))


def _paragraphs(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def related_docs(spark, folder):
    seeds = documents(spark, folder).where(F.col("doc_id") % EVERY == 0)
    vectors, source = _impact_source(spark, folder)
    return recommend.related(seeds, vectors, _paragraphs(spark, folder), "doc_id", 10, source=source).withColumnRenamed("doc", "doc_id")


def _events(spark, folder):
    items = documents(spark, folder).count()
    return table(spark, folder, "events").select("user_id", "event_id", "ts", (F.col("event_id") % items).alias("doc_id"), ((F.col("event_id") * 7) % items).alias("other"))


def user_history_recent(spark, folder):
    return recommend.recent_history(_events(spark, folder), 20)


def _candidates(spark, folder):
    return _events(spark, folder).select("user_id", F.col("other").alias("doc_id")).distinct()


def unseen_candidates(spark, folder):
    return recommend.unseen(_candidates(spark, folder), _events(spark, folder))


def _user_rows(spark, folder):
    history = _events(spark, folder).select("user_id", "doc_id").distinct()
    items = spark.range(documents(spark, folder).count()).withColumnRenamed("id", "doc_id")
    return recommend.training_set(history, _candidates(spark, folder), items, history.select("user_id").distinct(), 100)


def recommend_training_set(spark, folder):
    return _user_rows(spark, folder)


def recommend_users(spark, folder):
    """What to show every user: related documents of the history against others, in one batch. Events stand for reads of the documents."""
    history = recommend.recent_history(_events(spark, folder), 20)
    return recommend.recommend_users(history, _doc_vectors(spark, folder), _paragraphs(spark, folder), 10).withColumn("score", F.round("score", 6))


def _contexts(spark, folder):
    own = training.paragraph_contexts(_sequences(spark, folder), "doc_id")
    return own.select(F.col("doc_id").alias("key"), "c1", "c2", "label")


def paragraph_vectors(spark, folder):
    """Lengths of trained paragraph vectors of all documents with four words of the vocabulary or more."""
    vocab = cut(_vocab(spark, folder))
    shares = training.noise_share(vocab, keep=("term", "token_id"))
    contexts = cut(_contexts(spark, folder))
    net, q, _ = paragraphs.trained_net(contexts, shares, 16)
    made = paragraphs.paragraph_vectors(contexts, net, q, 5)
    return made.select(F.col("key").alias("doc_id"), F.size("v").alias("elements"), (V.norm(F.col("v")) > 0).alias("learnt"))


def recommend_svm(spark, folder):
    """For every user whose id is divisible by EVERY, with all documents of the embeddings as items."""
    events = table(spark, folder, "events").where(F.col("user_id") % EVERY == 0)
    items = _paragraphs(spark, folder).select("doc_id").distinct()
    size = items.count()
    history = events.select("user_id", (F.col("event_id") % size).alias("doc_id")).distinct()
    candidates = events.select("user_id", ((F.col("event_id") * 7) % size).alias("doc_id")).distinct()
    users = history.select("user_id").distinct()
    rows = cut(recommend.training_set(history, candidates, items, users, 100))
    return recommend.recommend_all(rows, _paragraphs(spark, folder), 20).withColumn("score", F.round("score", 6))


#: Rows a list is meant to hold; a label with more is split into lists by the remainder of the id, so that pairs grow with the rows.
LIST = 100


def _whole_lists(spark, folder):
    """Every embedding in one list of its label, better the smaller the id; qid is the label where it is not split."""
    from pyspark.sql import Window

    own = table(spark, folder, "embeddings").select("vec_id", "label")
    sizes = own.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("lists"))
    span = (own.agg(F.max("label")).first()[0] or 0) + 1
    split = own.join(sizes, "label").withColumn("qid", F.col("label") + span * F.pmod(F.col("vec_id"), F.col("lists")))
    return split.select("qid", F.col("vec_id").alias("doc"), F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("vec_id"))).alias("target"))


def _features(spark, folder):
    return _embeddings(spark, folder).select(F.col("id").alias("doc"), "v")


def svm_rank_pairs(spark, folder):
    pairs = ranking.rank_pairs(_whole_lists(spark, folder), _features(spark, folder))
    return pairs.select("qid", "a", "b", "label", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def svm_rank_scores(spark, folder):
    model = ranking.rank_machine(ranking.rank_pairs(_whole_lists(spark, folder), _features(spark, folder)))
    rows = _whole_lists(spark, folder).join(_features(spark, folder), "doc")
    return rows.select("qid", "doc", F.round(recommend.margin(F.col("v"), model), 6).alias("score"))


def svm_rank_lines(spark, folder):
    rows = _whole_lists(spark, folder).join(_features(spark, folder), "doc")
    return rows.select("qid", "doc", ranking.svm_rank_line(F.col("target"), F.col("qid"), F.col("v")).alias("line"))


def _relevant(spark, folder):
    """Documents filed under the same key as the one a query was taken from."""
    own = documents(spark, folder).where("parent_key is not null and parent_key <> '_'")
    asked = own.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), "parent_key")
    return asked.join(own, "parent_key").select("query_id", F.col("doc_id").alias("doc"), F.lit(1).alias("relevance"))


def eval_dump(spark, folder):
    """Every matching pair is scored and judged where the texts lie."""
    lists = index.word_lists(documents(spark, folder), "doc_id")
    found = best.every(_asked_terms(spark, folder), lists, "doc_id", "long", index.text_postings, _relevant(spark, folder))
    return found.select("query_id", F.col("doc").alias("doc_id"), F.coalesce("relevance", F.lit(ranking.UNJUDGED)).alias("relevance"), F.round("score", 6).alias("score"))


def rank_fitness(spark, folder):
    return ranking.rank_fitness(lexical.top(_best(spark, folder, 50), 50), _relevant(spark, folder)).withColumn("fitness", F.round("fitness", 6))


def _partial(spark, folder):
    types = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_type").cast("int").alias("doc_type"))
    return _scored(spark, folder).join(types, "doc")


#: Weightings that are compared: (w_id, doc_type, weight).
GRID = [(w, t, round(0.1 + 0.2 * ((w * t) % 4), 1)) for w in range(6) for t in range(1, 6)]


def weight_grid_fitness(spark, folder):
    grid = spark.createDataFrame(GRID, "w_id int, doc_type int, weight double")
    texts = table(spark, folder, "documents").select("doc_id", F.col("doc_type").cast("int").alias("part"), T.words(F.col("text")).alias("t")).where("t is not null and part is not null")
    found = best.graded(_asked_terms(spark, folder), spread(texts, "doc_id"), grid.withColumnRenamed("doc_type", "part"), 50, "doc_id", index.parted_postings)
    return ranking.weights_fitness(found.withColumnRenamed("part", "doc_type"), _relevant(spark, folder), grid, 50).withColumn("fitness", F.round("fitness", 5))


def weight_evolution(spark, folder):
    best = ranking.evolve_weights(_partial(spark, folder).withColumn("score", F.round("score", 9)), _relevant(spark, folder), {t: 0.2 for t in range(1, 6)})
    rows = [(i, t, round(w, 6), round(f, 6)) for i, (f, own) in enumerate(best) for t, w in own.items()]
    return spark.createDataFrame(rows, "place int, doc_type int, weight double, fitness double")


def _tokens(spark, folder):
    return training.positions(documents(spark, folder).where("text is not null"), "doc_id", T.words(F.col("text")))


def _vocab(spark, folder):
    return training.text_vocabulary(documents(spark, folder), "doc_id", T.words(F.col("text")), 5)  # doc_id is unique


def vocab_ids(spark, folder):
    return _vocab(spark, folder).select("term", "freq", F.col("token_id").cast("long").alias("token_id"))


def _sequences(spark, folder):
    """Texts are spread by key before they are taken apart, which moves less than their words would."""
    own = documents(spark, folder).where("text is not null").repartition("doc_id")
    return training.purged(training.positions(own, "doc_id", T.words(F.col("text"))), _vocab(spark, folder), "doc_id")


def purged_sequences(spark, folder):
    return _sequences(spark, folder)


def subsample_probs(spark, folder):
    return training.drop_probability(_vocab(spark, folder)).withColumn("p", F.round("p", 6))


def noise_shares(spark, folder):
    return training.noise_share(_vocab(spark, folder)).withColumn("q", F.round("q", 9))


def subsampled_tokens(spark, folder):
    return training.subsampled(_tokens(spark, folder), training.drop_probability(_vocab(spark, folder)), "doc_id")


def skipgram_pairs(spark, folder):
    return training.skip_grams(_sequences(spark, folder), "doc_id", 3)


def pvdm_contexts(spark, folder):
    return training.paragraph_contexts(_sequences(spark, folder), "doc_id")


def _word_model(spark, folder):
    return training.word_vectors(documents(spark, folder).where("text is not null").select(T.words(F.col("text")).alias("tokens")), 32)


def word2vec_train(spark, folder):
    from pyspark.ml.functions import vector_to_array

    model = _word_model(spark, folder)
    return model.getVectors().select(F.col("word").alias("term"), V.norm(vector_to_array("vector")).alias("length"))


def word2vec_documents(spark, folder):
    from pyspark.ml.functions import vector_to_array

    vectors = _word_model(spark, folder).getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("v"))
    return training.text_vectors(_tokens(spark, folder), vectors, "doc_id")


def _accounts(spark, folder):
    own = table(spark, folder, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("institution"))
    emails = own.select("account_id", F.concat("username", F.lit("@example.org")).alias("email"), (F.col("account_id") % 2 == 0).alias("is_primary"))
    return own, emails


def user_email_lookup(spark, folder):
    own, emails = _accounts(spark, folder)
    asked = own.where(F.col("account_id") % EVERY == 0).select(F.upper("username").alias("username"))
    return accounts.email_addresses(own, emails, asked)


def user_email_changes(spark, folder):
    own, emails = _accounts(spark, folder)
    added = accounts.put_email(emails, own, "CUSTOMER#000000007", "second@example.org")
    return accounts.delete_email(added, own, "customer#000000008", "CUSTOMER#000000008@EXAMPLE.ORG")


def user_public_info(spark, folder):
    return accounts.public_info(_accounts(spark, folder)[0], "CUSTOMER#000000007")


def stream_index(spark, folder):
    """The index that a stream of the documents, in four files, builds batch by batch."""
    from ..streaming import index_stream

    where = scratch(spark)
    documents(spark, folder).where("text is not null").select("doc_id", "text").repartition(4, "doc_id").write.parquet(f"{where}/in")
    stream = index_stream.stream_folder(spark, f"{where}/in", "doc_id long, text string")
    index_stream.index_stream(stream, f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.parquet(f"{where}/out/postings").select("doc_id", "term", "n", F.round("lnc", 6).alias("lnc"))


def stream_df(spark, folder):
    """Document frequencies counted by a stream in update mode; the last state of each term."""
    from ..streaming import index_stream

    where = scratch(spark)
    documents(spark, folder).where("text is not null").select("doc_id", "text").repartition(3, "doc_id").write.parquet(f"{where}/in")
    counts = index_stream.running_df(index_stream.stream_folder(spark, f"{where}/in", "doc_id long, text string"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/out/{number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{where}/out")
    return rows.groupBy("term").agg(F.max_by("df", "batch").alias("df"))


def stream_user_days(spark, folder):
    """Events of each user and day, counted by a stream with a watermark; days still open at the end are not out."""
    from ..streaming import index_stream

    where = scratch(spark)
    table(spark, folder, "events").select("user_id", "event_id", "ts").repartitionByRange("ts").write.option("maxRecordsPerFile", 5000).parquet(f"{where}/in")
    stream = index_stream.stream_folder(spark, f"{where}/in", "user_id long, event_id long, ts timestamp", 1000)
    days = index_stream.recent_documents(stream)
    days.select("user_id", F.col("window.start").alias("day"), "n").writeStream.outputMode("append").format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, day timestamp, n long").parquet(f"{where}/out")


QUERIES = {
    f.__name__: f
    for f in (
        neighbor_table, nearest_by_euclid, nearest_by_dot, inv_sq_similarity, vector_sum_query, unit_vectors, sparse_to_dense, dense_to_sparse, repeated_vectors, char_windows, ann_lsh, svd_2d,
        smoothed_tfidf, smoothed_search, related_docs, user_history_recent, unseen_candidates, recommend_training_set, recommend_svm, recommend_users, paragraph_vectors, svm_rank_pairs, svm_rank_scores, svm_rank_lines,
        eval_dump, rank_fitness, weight_grid_fitness, weight_evolution, vocab_ids, purged_sequences, subsample_probs, noise_shares, subsampled_tokens, skipgram_pairs, pvdm_contexts,
        word2vec_train, word2vec_documents, user_email_lookup, user_email_changes, user_public_info, stream_index, stream_df, stream_user_days,
    )
}

_E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_D2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))"


def _nearest(k: int, measure: str, where: str) -> str:
    value, order = (_D2, "ASC") if measure == "d2" else (_DOT, "DESC")
    return f"""near AS (SELECT src_id, CAST(rank AS INTEGER) AS rank, dst_id, value FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY round(value, 9) {order}, dst_id) AS rank
        FROM (SELECT a.id AS src_id, b.id AS dst_id, {value} AS value FROM {where} a CROSS JOIN e b)) WHERE rank <= {k})"""


_EVERY = f"(SELECT * FROM e WHERE id % {EVERY} = 0)"
_THIN = "thin AS (SELECT id, unnest(range(64)) AS i, v FROM e), cells AS (SELECT id, CAST(i AS INTEGER) AS i, CASE WHEN abs(v[i + 1]) < 0.1 THEN 0 ELSE v[i + 1] END AS x FROM thin)"
_SMOOTH = f"""{_E}, {_nearest(3, 'd2', 'e')}, {C},
    tops AS (SELECT term, row_number() OVER (ORDER BY sum(n) DESC, term) - 1 AS id FROM tc GROUP BY term QUALIFY id < (SELECT count(*) FROM embeddings)),
    wn AS (SELECT a.term, b.term AS near, sqrt(value) AS dist FROM near JOIN tops a ON src_id = a.id JOIN tops b ON dst_id = b.id)"""


def _smooth(name: str, key: str, source: str) -> str:
    return f"""{name}_t AS (SELECT {key} AS id, unnest(range(len(t))) AS pos, t FROM {source}),
    {name}_p AS (SELECT id, pos, t[pos + 1] AS term FROM {name}_t WHERE t[pos + 1] IN (SELECT term FROM wn)),
    {name}_set AS (SELECT id, near AS term, arg_max(dist, (pos, -dist)) AS dist, max(pos) AS set_at FROM {name}_p JOIN wn ON {name}_p.term = wn.term WHERE wn.term <> near AND dist > 0 GROUP BY ALL),
    {name}_aft AS (SELECT p.id, p.term, count(*) FILTER (WHERE set_at IS NULL OR pos > set_at) AS later FROM {name}_p p LEFT JOIN {name}_set s ON p.id = s.id AND p.term = s.term GROUP BY ALL),
    {name} AS (SELECT coalesce(s.id, a.id) AS id, coalesce(s.term, a.term) AS term, ln(1 + coalesce(1 / dist, 0) + coalesce(later, 0)) AS val FROM {name}_set s FULL JOIN {name}_aft a ON s.id = a.id AND s.term = a.term)"""


_DOCS_T = f"(SELECT doc_id, {W.format('text')} AS t FROM documents WHERE text IS NOT NULL)"
_LISTS = """sized AS (SELECT label, CAST(ceil(count(*) / 100.0) AS BIGINT) AS n FROM embeddings GROUP BY label),
    split AS (SELECT e.label + (SELECT max(label) + 1 FROM embeddings) * (vec_id % n) AS qid, vec_id AS doc, CAST(embedding AS DOUBLE[]) AS v FROM embeddings e JOIN sized ON e.label = sized.label),
    lists AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY doc DESC) AS target, v FROM split)"""
_HIST = f"hist AS (SELECT DISTINCT user_id, event_id % {_ITEMS} AS doc_id FROM events), cand AS (SELECT DISTINCT user_id, (event_id * 7) % {_ITEMS} AS doc_id FROM events)"
_VOCAB = f"""toks0 AS (SELECT doc_id, unnest(range(len(t))) AS pos, t FROM {_DOCS_T}), toks1 AS (SELECT doc_id, pos, t[pos + 1] AS term FROM toks0),
    nth AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id, pos) AS k, count(*) OVER (PARTITION BY term) AS freq FROM toks1),
    vocab AS (SELECT term, freq, row_number() OVER (ORDER BY doc_id, pos) - 1 AS token_id FROM nth WHERE k = 5),
    seqs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, token_id FROM toks1 JOIN vocab ON toks1.term = vocab.term)"""
_SCORED = "sc AS (SELECT query_id, doc_id, round(sum(lnc * ltc), 6) AS score FROM vecs JOIN lw ON term1 = lw.term AND term2 = '' GROUP BY ALL)"
_REL = f"""rel AS (SELECT a.doc_id AS query_id, b.doc_id FROM documents a JOIN documents b ON a.parent_key = b.parent_key WHERE a.doc_id % {EVERY} = 0 AND a.parent_key <> '_')"""
_FIT = f"""WITH {Q}, {C}, idfs AS (SELECT grams.*, ln((SELECT count(*) FROM documents) / CAST(greatest(coalesce(CASE WHEN term2 = '' THEN df END, 1), 1) AS DOUBLE)) AS idf FROM grams LEFT JOIN dfs ON term1 = dfs.term),
    lens AS (SELECT query_id, sqrt(sum(idf * idf)) AS len FROM idfs GROUP BY query_id),
    vecs AS (SELECT idfs.query_id, term1, term2, CASE WHEN len > 0 THEN idf / len ELSE 0 END AS ltc FROM idfs JOIN lens ON idfs.query_id = lens.query_id), {_REL}"""
_ACC = "acc AS (SELECT c_custkey AS account_id, c_name AS username, c_name || '@example.org' AS email, c_custkey % 2 = 0 AS is_primary FROM customer)"
_GRID = ", ".join(str(x) for x in GRID)

SQL = {
    "neighbor_table": f"WITH {_E}, {_nearest(3, 'd2', 'e')} SELECT src_id, rank, dst_id, round(value, 6) AS d2 FROM near",
    "nearest_by_euclid": f"WITH {_E}, {_nearest(10, 'd2', _EVERY)} SELECT src_id, rank, dst_id, round(-sqrt(value), 5) AS score FROM near",
    "nearest_by_dot": f"WITH {_E}, {_nearest(10, 'dot', _EVERY)} SELECT src_id, rank, dst_id, round(value, 6) AS score FROM near",
    "inv_sq_similarity": f"WITH {_E}, {_nearest(5, 'd2', _EVERY)} SELECT src_id, dst_id, round(15 / value, 4) AS similarity FROM near WHERE src_id <> dst_id",
    "vector_sum_query": f"""WITH {_E}, cell AS (SELECT id // {EVERY} AS id, i, sum(v[i + 1]) AS x FROM (SELECT id, v, unnest(range(64)) AS i FROM e WHERE id % {EVERY} < 2) GROUP BY ALL),
        sums AS (SELECT id, list(x ORDER BY i) AS v FROM cell GROUP BY id), {_nearest(5, 'd2', 'sums')} SELECT src_id, rank, dst_id, round(value, 6) AS d2 FROM near""",
    "unit_vectors": f"WITH {_E} SELECT id, CAST(i AS INTEGER) AS i, round(v[i + 1] / sqrt(s), 6) AS x FROM (SELECT id, v, list_sum(list_transform(v, lambda x: x * x)) AS s, unnest(range(64)) AS i FROM e)",
    "sparse_to_dense": f"WITH {_E}, {_THIN} SELECT id, i, round(x, 6) AS x FROM cells",
    "dense_to_sparse": f"WITH {_E}, {_THIN} SELECT id, i, round(x, 6) AS x FROM cells WHERE x <> 0",
    "repeated_vectors": f"WITH {_E} SELECT id, CAST(i AS INTEGER) AS i, round(v[i % 10 + 1], 6) AS x FROM (SELECT id, v, unnest(range(64)) AS i FROM e)",
    "char_windows": "SELECT p_partkey, CAST(i AS INTEGER) AS i, ascii(p_name[i + 1]) AS c0, ascii(p_name[i + 2]) AS c1, ascii(p_name[i + 3]) AS c2 FROM (SELECT p_partkey, p_name, unnest(range(length(p_name) - 2)) AS i FROM part)",
    "smoothed_tfidf": f"WITH {_SMOOTH}, {_smooth('sm', 'doc_id', _DOCS_T)} SELECT id AS doc_id, term, round(val, 6) AS val FROM sm",
    "smoothed_search": f"""WITH {Q}, {_SMOOTH}, {_smooth('sm', 'doc_id', _DOCS_T)}, {_smooth('sq', 'query_id', 'toks')},
        len2 AS (SELECT id, sum(val * val) AS s FROM sm GROUP BY id), vec AS (SELECT sm.id, term, val / CASE WHEN s = 0 THEN 1 ELSE s END AS val FROM sm JOIN len2 ON sm.id = len2.id),
        vdf AS (SELECT term, count(*) AS df FROM vec GROUP BY term), wq AS (SELECT sq.id AS query_id, sq.term, ln((SELECT count(DISTINCT id) FROM vec) / CAST(df + 1 AS DOUBLE)) * val AS w FROM sq JOIN vdf ON sq.term = vdf.term),
        sc AS (SELECT query_id, vec.id AS doc_id, round(sum(w * val), 6) AS score FROM wq JOIN vec ON wq.term = vec.term GROUP BY ALL)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10""",
    "related_docs": f"""{_IMPACT.replace('wq AS (', 'unused AS (')}, wq AS (SELECT vec.doc_id AS query_id, vec.term, ln((SELECT count(DISTINCT doc_id) FROM vec) / CAST(df + 1 AS DOUBLE)) * val AS w FROM vec JOIN dfs ON vec.term = dfs.term WHERE doc_id % {EVERY} = 0),
        sc AS (SELECT query_id, vec.doc_id, round(sum(w * val), 6) AS score FROM wq JOIN vec ON vec.term = wq.term GROUP BY ALL),
        found AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20), {_E},
        again AS (SELECT query_id, doc_id, CASE WHEN a.id IS NULL THEN score ELSE round(-{_D2}, 6) END AS score FROM found LEFT JOIN e a ON query_id = a.id LEFT JOIN e b ON doc_id = b.id WHERE a.id IS NULL OR b.id IS NOT NULL)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM again) WHERE rank <= 10""",
    "user_history_recent": f"SELECT user_id, event_id % {_ITEMS} AS doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 20",
    "unseen_candidates": f"WITH {_HIST} SELECT * FROM cand EXCEPT SELECT * FROM hist",
    "recommend_training_set": f"""WITH {_HIST}, taken AS (SELECT * FROM hist UNION SELECT * FROM cand), users AS (SELECT DISTINCT user_id FROM events),
        items AS (SELECT unnest(range({_ITEMS})) AS doc_id), pool AS (SELECT user_id, doc_id FROM users CROSS JOIN items), rest AS (SELECT user_id, doc_id FROM pool ANTI JOIN taken USING (user_id, doc_id)
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5('n-' || CAST(doc_id AS VARCHAR)), doc_id) <= 100)
        SELECT u.user_id, u.doc_id, CASE WHEN hist.doc_id IS NULL THEN 0 ELSE 1 END AS label FROM (SELECT * FROM taken UNION SELECT * FROM rest) u LEFT JOIN hist ON u.user_id = hist.user_id AND u.doc_id = hist.doc_id""",
    "svm_rank_pairs": f"""WITH {_LISTS}, p AS (SELECT a.qid, a.doc AS a, b.doc AS b, CASE WHEN a.target > b.target THEN 1 ELSE -1 END AS label, list_transform(list_zip(a.v, b.v), lambda x: x[1] - x[2]) AS v FROM lists a JOIN lists b ON a.qid = b.qid AND a.target <> b.target)
        SELECT qid, a, b, label, round(v[1], 6) AS first, round(list_sum(v), 5) AS total FROM p""",
    "eval_dump": f"{_FIT}, {_SCORED} SELECT sc.query_id, sc.doc_id, CASE WHEN rel.doc_id IS NULL THEN 5 ELSE 1 END AS relevance, score FROM sc LEFT JOIN rel ON sc.query_id = rel.query_id AND sc.doc_id = rel.doc_id",
    "rank_fitness": f"""{_FIT}, {_SCORED}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc), hit AS (SELECT rk.query_id, sum(1 / sqrt(rank)) AS f FROM rk JOIN rel ON rk.query_id = rel.query_id AND rk.doc_id = rel.doc_id WHERE rank <= 50 GROUP BY ALL)
        SELECT q.query_id, round(coalesce(f, 0), 6) AS fitness FROM (SELECT DISTINCT query_id FROM rel) q LEFT JOIN hit ON q.query_id = hit.query_id""",
    "weight_grid_fitness": f"""{_FIT}, raw AS (SELECT query_id, lw.doc_id, sum(lnc * ltc) AS score FROM vecs JOIN lw ON term1 = lw.term AND term2 = '' GROUP BY ALL), grid AS (SELECT * FROM (VALUES {_GRID}) g(w_id, doc_type, weight)),
        ws AS (SELECT w_id, query_id, raw.doc_id, round(score * weight, 6) AS score FROM raw JOIN documents ON raw.doc_id = documents.doc_id JOIN grid ON grid.doc_type = documents.doc_type),
        rk AS (SELECT *, row_number() OVER (PARTITION BY w_id, query_id ORDER BY score DESC, doc_id) AS rank FROM ws), hit AS (SELECT w_id, sum(1 / sqrt(rank)) AS f FROM rk JOIN rel ON rk.query_id = rel.query_id AND rk.doc_id = rel.doc_id WHERE rank <= 50 GROUP BY ALL)
        SELECT CAST(w.w_id AS INTEGER) AS w_id, round(coalesce(f, 0), 5) AS fitness FROM (SELECT DISTINCT w_id FROM grid) w LEFT JOIN hit ON w.w_id = hit.w_id""",
    "vocab_ids": f"WITH {_VOCAB} SELECT * FROM vocab",
    "purged_sequences": f"WITH {_VOCAB} SELECT doc_id, CAST(pos AS INTEGER) AS pos, token_id FROM seqs",
    "subsample_probs": f"WITH {_VOCAB} SELECT term, freq, round(greatest(0, 1 - sqrt(4e-5 / (freq / CAST((SELECT sum(freq) FROM vocab) AS DOUBLE)))), 6) AS p FROM vocab",
    "noise_shares": f"WITH {_VOCAB} SELECT term, round(pow(freq, 0.75) / (SELECT sum(pow(freq, 0.75)) FROM vocab), 9) AS q FROM vocab",
    "skipgram_pairs": f"""WITH {_VOCAB} SELECT a.doc_id, CAST(a.pos AS INTEGER) AS pos, b.token_id AS feature, a.token_id AS label FROM seqs a JOIN seqs b ON a.doc_id = b.doc_id
        AND b.pos BETWEEN greatest(a.pos - a.pos % 3, 0) AND greatest(a.pos - a.pos % 3, 0) + 2 * (a.pos % 3)""",
    "pvdm_contexts": f"""WITH {_VOCAB} SELECT doc_id, CAST(pos AS INTEGER) AS pos, c1, c2, label FROM (SELECT doc_id, pos, token_id AS c1, lead(token_id, 1) OVER w AS c2, lead(token_id, 2) OVER w AS label, lead(token_id, 3) OVER w AS beyond FROM seqs WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE beyond IS NOT NULL""",
    "user_email_lookup": f"WITH {_ACC} SELECT username, email, is_primary FROM acc WHERE account_id % {EVERY} = 0",
    "user_email_changes": f"""WITH {_ACC} SELECT account_id, email, is_primary FROM acc WHERE lower(username) <> 'customer#000000008'
        UNION ALL SELECT account_id, 'second@example.org', false FROM acc WHERE lower(username) = 'customer#000000007'""",
    "user_public_info": f"SELECT c_name AS username, c_mktsegment AS institution FROM customer WHERE lower(c_name) = 'customer#000000007'",
    "paragraph_vectors": f"WITH {_VOCAB} SELECT doc_id, 16 AS elements, true AS learnt FROM seqs GROUP BY doc_id HAVING count(*) >= 4",
    "stream_user_days": """WITH days AS (SELECT user_id, date_trunc('day', ts) AS day FROM events)
        SELECT user_id, day, count(*) AS n FROM days WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY user_id, day""",
    "stream_index": f"WITH {C} SELECT doc_id, term, n, round(lnc, 6) AS lnc FROM lw",
    "stream_df": f"WITH {C} SELECT * FROM dfs",
}
