import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexforge.operators import impact, index, lexical, training


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("alpha beta gamma delta eps zeta eta".split(), k=rng.randint(1, 25)))) for i in range(60)] + [(100, None), (101, ""), (102, "!!")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def plain(docs):
    return {r["doc_id"]: (r["text"] or "").replace("!", "").split() for r in docs.collect()}


def test_vectors_have_length_one(docs):
    weights = index.log_weights(index.term_counts(docs, "doc_id"), "doc_id")
    for r in weights.groupBy("doc_id").agg(F.sum(F.col("lnc") * F.col("lnc")).alias("s")).collect():
        assert r["s"] == pytest.approx(1)
    unit = impact.tfidf_vectors(index.term_counts(docs, "doc_id"), "doc_id")
    assert all(r["s"] == pytest.approx(1) for r in unit.groupBy("doc_id").agg(F.sum(F.col("val") * F.col("val")).alias("s")).collect())


def test_counts_do_not_depend_on_partitions(docs):
    a, b = (sorted(map(tuple, index.term_counts(docs.repartition(n), "doc_id").collect())) for n in (1, 7))
    assert a == b == sorted((d, t, n) for d, words in plain(docs).items() for t, n in Counter(words).items())


@pytest.mark.parametrize("size", [1, 4, 7, 1000])
def test_chunks(docs, size):
    weights = index.log_weights(index.term_counts(docs, "doc_id"), "doc_id")
    rows = [tuple(r) for r in weights.select("term", "doc_id", "lnc").collect()]
    expected = set()
    for term in {r[0] for r in rows}:
        own = sorted((-v, d) for t, d, v in rows if t == term)
        for c in range(0, len(own), size):
            part = own[c : c + size]
            expected.add((term, c // size, len(part), -part[0][0], -part[-1][0]))
    assert {tuple(r) for r in index.posting_chunks(weights, "doc_id", "lnc", size).collect()} == expected


def test_numbers_are_dense_and_ordered(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "x long").repartition(5)
    assert sorted((r["x"], r["n"]) for r in index.numbered(rows, ["x"], "n", 10).collect()) == [(i, i + 10) for i in range(1000)]
    assert index.numbered(rows.limit(0), ["x"], "n").count() == 0


def test_merges(spark):
    old = spark.createDataFrame([(0, "a"), (4, "b")], "term_id long, term string")
    new = spark.createDataFrame([("c",), ("a",), ("c",), ("b2",)], "term string")
    assert sorted(map(tuple, index.insert_absent(old, new, "term", "term_id").collect())) == [(0, "a"), (4, "b"), (5, "b2"), (6, "c")]
    df = spark.createDataFrame([("a", 2), ("b", 1)], "term string, df long")
    delta = spark.createDataFrame([("a", 3), ("z", 1), ("a", 1)], "term string, df long")
    assert sorted(map(tuple, index.merge_counts(df, delta, ["term"], "df").collect())) == [("a", 6), ("b", 1), ("z", 1)]
    a = spark.createDataFrame([("p", 1.0, "keep"), ("q", None, "keep")], "k string, v double, o string")
    b = spark.createDataFrame([("p", None, "new"), ("r", 5.0, "new"), ("r", 5.0, "new")], "k string, v double, o string")
    assert sorted(map(tuple, index.upsert(a, b, ["k"], ["v"]).collect()), key=str) == sorted([("p", None, "keep"), ("q", None, "keep"), ("r", 5.0, "new")], key=str)


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def units(docs):
    return docs.select(F.concat(F.lit("d"), "doc_id").alias("text_id"), F.lit(1).cast("short").alias("doc_type"), "text", F.lit(None).cast("string").alias("parent"))


def test_search_equals_a_plain_one(spark, docs):
    asked = ["alpha beta unknown", "gamma gamma", "!!", "zeta"]
    found = {(r["query_id"], r["rank"]): (r["doc"], r["score"]) for r in lexical.search_units(queries(spark, *asked), units(docs), n=7).collect()}
    words = plain(docs)
    n = len(words)
    df = Counter(t for own in words.values() for t in set(own))
    weights = {}
    for d, own in words.items():
        w = {t: 1 + math.log(c) for t, c in Counter(own).items()}
        length = math.sqrt(sum(x * x for x in w.values())) or 1
        weights[d] = {t: x / length for t, x in w.items()}
    for q, text in enumerate(asked):
        tokens = text.replace("!", "").split()
        bag = tokens + list(zip(tokens, tokens[1:]))
        idf = [math.log(n / max(df.get(g, 0) if isinstance(g, str) else 0, 1)) for g in bag]
        length = math.sqrt(sum(x * x for x in idf)) or 1
        scores = Counter()
        for g, x in zip(bag, idf):
            for d, w in weights.items():
                if g in w:
                    scores[f"d{d}"] += 0.4 * w[g] * x / length
        best = sorted(((-round(s, 6), d) for d, s in scores.items()))[:7]
        assert [found[q, i + 1][0] for i in range(len(best))] == [d for _, d in best]
        assert [found[q, i + 1][1] for i in range(len(best))] == [pytest.approx(-s, abs=2e-6) for s, _ in best]


def test_pages_join_up_and_zero_rows_fill(spark, docs):
    scored = spark.createDataFrame([(0, d, (d * 37 % 11) / 10) for d in range(30)], "query_id long, doc long, score double")
    whole = [(r["rank"], r["doc"]) for r in lexical.top(scored, 20).orderBy("rank").collect()]
    parts = [(r["rank"], r["doc"]) for o in (0, 5, 10, 15) for r in lexical.top(scored, 5, o).orderBy("rank").collect()]
    assert whole == parts and len(lexical.top(scored, 0).collect()) == 10
    universe = docs.select(F.col("doc_id").alias("doc"))
    few = spark.createDataFrame([(0, 3, 0.5), (0, 59, 0.7)], "query_id long, doc long, score double")
    filled = lexical.zero_filled(few, queries(spark, "x", "y"), universe, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc"]) for r in filled] == [(0, 59), (0, 3), (0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (1, 3), (1, 4)]


def test_query_without_weight_scores_zero(spark):
    one = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    assert [r["score"] for r in lexical.search_units(queries(spark, "alpha"), units(one)).collect()] == [0.0]


def sequential(tokens, near):
    value = {}
    for t in tokens:
        value[t] = value.get(t, 0) + 1
        for other, dist in near.get(t, []):
            if other != t and dist > 0:
                value[other] = 1 / dist
    return {t: math.log(1 + v) for t, v in value.items()}


def test_smoothing_equals_the_loop(spark):
    rng = random.Random(3)
    stock = [f"t{i}" for i in range(12)]
    near = {t: [(t, 0.0)] + [(o, rng.choice([0.0, 0.5, 1.5, 2.0])) for o in rng.sample(stock, 2) if o != t] for t in stock}
    texts = {i: rng.choices(stock, k=rng.randint(1, 30)) for i in range(80)}
    positions = spark.createDataFrame([(i, p, t) for i, own in texts.items() for p, t in enumerate(own)], "doc_id long, pos int, term string")
    table = spark.createDataFrame([(t, o, d) for t, own in near.items() for o, d in own], "term string, near string, dist double")
    found = {(r["doc_id"], r["term"]): r["val"] for r in impact.smoothed_counts(positions, table, "doc_id").collect()}
    expected = {(i, t): v for i, own in texts.items() for t, v in sequential(own, near).items()}
    assert set(found) == set(expected)
    assert all(found[k] == pytest.approx(v) for k, v in expected.items())


def test_pruned_search_keeps_the_weightiest_terms(spark, docs):
    vectors = impact.tfidf_vectors(index.term_counts(docs, "doc_id"), "doc_id", "l2sq")
    asked = spark.createDataFrame([(0, "alpha", 1.0), (0, "beta", 0.01)], "query_id long, term string, val double")
    alone = impact.impact_search(asked.where("term = 'alpha'"), vectors, "doc_id", 5)
    assert sorted(map(tuple, impact.impact_search(asked, vectors, "doc_id", 5, share=0.5).collect())) == sorted(map(tuple, alone.collect()))


def test_training_samples_equal_loops(spark):
    rng = random.Random(4)
    texts = {i: rng.choices([f"t{k}" for k in range(15)], k=rng.randint(0, 20)) for i in range(30)}
    tokens = spark.createDataFrame([(i, p, t) for i, own in texts.items() for p, t in enumerate(own)], "doc_id long, pos int, term string").repartition(4)
    count, ids = Counter(), {}
    for i in sorted(texts):
        for t in texts[i]:
            count[t] += 1
            if count[t] == 3:
                ids[t] = len(ids)
    vocab = training.vocabulary(tokens, "doc_id", 3)
    assert {r["term"]: (r["token_id"], r["freq"]) for r in vocab.collect()} == {t: (k, count[t]) for t, k in ids.items()}
    sequences = {i: [ids[t] for t in own if t in ids] for i, own in texts.items()}
    purged = training.purged(tokens, vocab, "doc_id")
    assert sorted(map(tuple, purged.collect())) == sorted((i, p, t) for i, own in sequences.items() for p, t in enumerate(own))
    for most in (1, 2, 4):
        expected = sorted((i, p, f, own[p]) for i, own in sequences.items() for p in range(len(own)) for f in own[max(p - p % most, 0) : max(p - p % most, 0) + 2 * (p % most) + 1])
        assert sorted(map(tuple, training.skip_grams(purged, "doc_id", most).collect())) == expected
    contexts = sorted((i, p, own[p], own[p + 1], own[p + 2]) for i, own in sequences.items() for p in range(len(own) - 3))
    assert sorted(map(tuple, training.paragraph_contexts(purged, "doc_id").collect())) == contexts
    kept = training.subsampled(tokens, training.drop_probability(vocab, 0.05), "doc_id")
    assert 0 < kept.count() < tokens.count()
    assert sum(r["q"] for r in training.noise_share(vocab).collect()) == pytest.approx(1)


def test_labels_and_spans(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "term string, token_id long")
    tokens = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "pos int, term string")
    assert sorted((r["pos"], r["token_id"]) for r in training.label_ids(tokens, vocab).collect()) == [(1, 0), (2, 2), (3, 2)]
    text = "".join(chr(97 + i % 26) for i in range(500))
    rows = spark.createDataFrame([(i, text) for i in range(40)] + [(90, "short"), (91, None), (92, "x" * 100)], "doc_id long, text string")
    spans = {r["doc_id"]: r["span"] for r in training.text_spans(rows, "doc_id").collect()}
    assert set(spans) == {*range(40), 92} and spans[92] == f"<s>{'x' * 100}</s>"
    assert all(100 <= len(spans[i]) - 7 <= 500 and spans[i][3:-4] in text for i in range(40)) and len(set(spans.values())) > 30


def test_gram_dictionary_grows(spark):
    grams = spark.createDataFrame([(0, "a", ""), (1, "a", "b")], "gram_id long, term1 string, term2 string")
    df = spark.createDataFrame([(0, 3), (1, 1)], "gram_id long, df long")
    delta = spark.createDataFrame([("a", "", 2), ("b", "", 1), ("a", "c", 1)], "term1 string, term2 string, df long")
    known, now = index.add_grams(grams, df, delta)
    assert sorted(map(tuple, known.collect())) == [(0, "a", ""), (1, "a", "b"), (2, "a", "c"), (3, "b", "")]
    assert sorted(map(tuple, now.collect())) == [(0, 5), (1, 1), (2, 1), (3, 1)]
