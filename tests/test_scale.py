"""Operators under skew and repeated work: one term in all texts, one user with most events, equal weights, many batches."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.operators import impact, index, lexical, paragraphs, recommend, training
from lexforge.session import by_shuffle, first_rows, hashed_sample
from lexforge.streaming import index_stream


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_counted_in_the_row_equal_those_of_a_grouping(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "a", "reward", "Error", "x_1", "ß"], k=rng.randint(0, 40)))) for i in range(80)] + [(100, None), (101, ""), (102, "  ! "), (103, "same " * 3000)]
    docs = texts(spark, rows)
    found = {(r["doc_id"], r["term"]): (r["n"], round(r["lnc"], 9)) for r in index.weighted_terms(docs, "doc_id").collect()}
    plain = index.log_weights(index.term_counts(docs, "doc_id"), "doc_id")
    assert found == {(r["doc_id"], r["term"]): (r["n"], round(r["lnc"], 9)) for r in plain.collect()} and found[103, "same"] == (3000, 1.0)
    plan = index.weighted_terms(spark.range(10_000).repartition(8).select(F.col("id").alias("doc_id"), F.lit("a b a").alias("text")), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the one of the test's own repartition


def test_a_term_of_all_texts_with_equal_weights(spark):
    """One-word texts all weigh 1: thousands of equal postings of one term, in chunks and in order."""
    rows = [(i, "the") for i in range(3000)] + [(5000 + i, "the cat") for i in range(500)] + [(9000, "cat")]
    weights = index.weighted_terms(texts(spark, rows), "doc_id").withColumn("lnc", F.round("lnc", 6))
    values = defaultdict(list)
    for r in weights.collect():
        values[r["term"]].append((-r["lnc"], r["doc_id"]))
    chunks, ranks = set(), set()
    for term, own in values.items():
        own.sort()
        ranks |= {(term, i + 1, d) for i, (_, d) in enumerate(own)}
        for k in range(0, len(own), 70):
            part = [-v for v, _ in own[k : k + 70]]
            chunks.add((term, k // 70, len(part), max(part), min(part)))
    assert {tuple(r) for r in index.posting_chunks(weights, "doc_id", "lnc", 70).select("term", "chunk", "size", "max_val", "min_val").collect()} == chunks
    assert {(r["term"], r["rank"], r["doc_id"]) for r in index.posting_ranks(weights, "doc_id", "lnc").collect()} == ranks
    assert index.posting_ranks(weights.limit(0), "doc_id", "lnc").count() == index.posting_chunks(weights.limit(0), "doc_id", "lnc").count() == 0


def test_a_vocabulary_looks_at_the_first_texts_of_a_term_only(spark):
    rng = random.Random(2)
    rows = [(i, pos, w) for i in range(200) for pos, w in enumerate(["the", *rng.choices([f"w{k}" for k in range(90)], k=6), "the"])]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, term string")
    seen, order, freq = Counter(), [], Counter(w for *_, w in rows)
    for i, pos, w in sorted(rows):
        seen[w] += 1
        if seen[w] == 5:
            order.append(w)
    found = {r["term"]: (r["freq"], r["token_id"]) for r in training.vocabulary(tokens, "doc_id", 5).collect()}
    assert found == {w: (freq[w], k) for k, w in enumerate(order)}


def test_a_user_with_most_events_costs_others_nothing(spark):
    """One user has taken nearly all of the first documents in the order of negatives; everyone gets a hundred, or all that are left."""
    n = 1500
    ordered = [r["doc_id"] for r in spark.range(n).select(F.col("id").alias("doc_id"), recommend.hashed_order("id", F.lit("n")).alias("h")).orderBy("h").collect()]
    history = [(1, d) for d in ordered[:1000]] + [(2, ordered[3]), (2, ordered[7])] + [(3, d) for d in ordered[:1450]]
    events = spark.createDataFrame(history, "user_id long, doc_id long")
    made = recommend.training_set(events, events.limit(0), spark.range(n).withColumnRenamed("id", "doc_id"), events.select("user_id").distinct(), 100)
    found = defaultdict(lambda: ([], []))
    for r in made.collect():
        found[r["user_id"]][r["label"]].append(r["doc_id"])
    for user in (1, 2, 3):
        taken = {d for u, d in history if u == user}
        assert sorted(found[user][1]) == sorted(taken)
        assert sorted(found[user][0]) == sorted([d for d in ordered if d not in taken][:100])


def test_machines_of_large_users_are_those_of_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=8) + (1 if i < 60 else -1)]) for i in range(160)]
    rows = [(u, d, int(d < 60)) for u in (1, 2) for d in range(u, 150, u)]
    table, paragraph = spark.createDataFrame(rows, "user_id long, doc_id long, label int"), spark.createDataFrame(vectors, "doc_id long, v array<double>")
    small = sorted((r["user_id"], r["doc_id"], round(r["score"], 4)) for r in recommend.recommend_all(table, paragraph).collect())
    monkeypatch.setattr(recommend, "ROWS_A_USER", 100)
    large = sorted((r["user_id"], r["doc_id"], round(r["score"], 4)) for r in recommend.recommend_all(table, paragraph).collect())
    assert len(small) == 40 and small == large
    x, y = np.array([vectors[d][1] for _, d, _ in rows if _ in (0, 1)]), np.array([label for *_, label in rows])
    own = x[: len(range(1, 150))], y[: len(range(1, 150))]
    cost = [c for c in recommend._costs(int(own[1].sum()), int((1 - own[1]).sum()), 0.1)]
    sign, costs, ones = np.where(own[1] > 0, 1.0, -1.0), np.where(own[1] > 0, *cost), recommend._with_one(own[0])
    w = recommend.svm_by_newton(lambda w: recommend._squared_hinge(ones, sign, costs, w), 9)
    value = lambda w: recommend._squared_hinge(ones, sign, costs, w)[0] + w @ w / 2
    assert all(value(w) <= value(w + 0.01 * rng.normal(size=9)) for _ in range(50))


def test_a_stream_reads_keys_and_no_postings(spark, tmp_path):
    docs = texts(spark, [(i, f"w{i % 3} common") for i in range(12)] + [(20, "!!")])
    write = index_stream.add_batch(str(tmp_path))
    for number in range(4):  # each batch repeats the documents of the one before
        write(docs.where((F.col("doc_id") >= 3 * number - 3) & (F.col("doc_id") < 3 * number + 3) | (F.col("doc_id") == 20)), number)
    made = spark.read.parquet(f"{tmp_path}/postings")
    assert made.count() == 24 and made.select("doc_id", "term").distinct().count() == 24
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/keys").collect()) == [*range(12), 20]


def test_smoothing_against_a_plain_loop(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(8)]
    near = [(w, rng.choice(words), rng.choice([0.0, 0.5, 1.5, 2.0])) for w in words for _ in range(2)]
    rows = [(i, rng.choices(words, k=rng.randint(1, 30))) for i in range(30)]
    expected = {}
    for i, own in rows:
        value: dict[str, float] = defaultdict(float)
        for w in own:
            value[w] += 1
            for d, x in sorted((d, x) for t, x, d in near if t == w and x != w and d > 0)[::-1]:
                value[x] = 1 / d
        expected |= {(i, w): round(math.log1p(v), 9) for w, v in value.items()}
    tokens = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    made = impact.smoothed_counts(impact.token_positions(tokens, "doc_id"), spark.createDataFrame(near, "term string, near string, dist double"), "doc_id")
    assert {(r["doc_id"], r["term"]): round(r["val"], 9) for r in made.collect()} == expected


def test_negatives_follow_the_shares(spark):
    shares = spark.createDataFrame([(0, 0.6), (1, 0.3), (2, 0.1)], "token_id long, q double")
    drawn = paragraphs.negatives(spark.range(2000).withColumnRenamed("id", "label"), shares, ["label"], 5)
    counts = {r["token_id"]: r["count"] for r in drawn.groupBy("token_id").count().collect()}
    assert sum(counts.values()) == 10_000 and drawn.select("label", "i").distinct().count() == 10_000
    assert all(abs(counts[t] - 10_000 * q) < 300 for t, q in ((0, 0.6), (1, 0.3), (2, 0.1)))


def test_sampled_softmax_has_the_derivatives_it_gives():
    rng = np.random.default_rng(5)
    hidden, weights, bias, q = rng.normal(size=(4, 6)), rng.normal(size=(9, 6)), rng.normal(size=9), np.full(9, 1 / 9)
    labels, drawn = np.array([1, 2, 3, 4]), np.array([5, 6, 2, 8])
    loss, own, other = paragraphs.sampled_softmax(hidden, weights, bias, labels, drawn, q)
    for j in (2, 5, 1):
        moved = bias.copy()
        moved[j] += 1e-6
        slope = (paragraphs.sampled_softmax(hidden, weights, moved, labels, drawn, q)[0] - loss) / 1e-6
        assert slope == pytest.approx(own[labels == j].sum() + other[:, drawn == j].sum(), abs=1e-4)


def test_paragraph_vectors_of_like_texts_are_alike(spark):
    rng = np.random.default_rng(6)
    rows = []
    for key in range(40):
        low = 0 if key % 2 else 10
        seq = low + rng.integers(0, 10, 60)
        rows += [(key, int(a), int(b), int(c)) for a, b, c in zip(seq, seq[1:], seq[2:])]
    contexts = spark.createDataFrame(rows, "key long, c1 long, c2 long, label long")
    shares = spark.createDataFrame([(t, 0.05) for t in range(20)], "token_id long, q double")
    net, q, losses = paragraphs.trained_net(contexts, shares, 8, rounds=6, parts=2)
    assert losses[-1] < losses[0]
    made = {r["key"]: np.array(r["v"]) for r in paragraphs.paragraph_vectors(contexts, net, q, 20).collect()}
    unit = {k: v / np.linalg.norm(v) for k, v in made.items()}
    same = np.mean([unit[a] @ unit[b] for a in unit for b in unit if a < b and a % 2 == b % 2])
    other = np.mean([unit[a] @ unit[b] for a in unit for b in unit if a < b and a % 2 != b % 2])
    assert len(made) == 40 and same > other + 0.2
    with pytest.raises(ValueError):
        paragraphs.trained_net(contexts, shares, 10**6)


def test_results_and_texts_by_their_other_id(spark):
    units = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "doc_id long, text_id string, parent_doc long")
    ranked = spark.createDataFrame([(0, 1, 2), (0, 2, 9), (1, 1, 2)], "query_id int, rank int, doc long")
    assert {tuple(r) for r in lexical.with_text_id(ranked, units).collect()} == {(0, 1, 2, "b"), (0, 2, 9, None), (1, 1, 2, "b")}
    asked = spark.createDataFrame([("b",), ("b",), ("c",)], "text_id string")
    assert {tuple(r) for r in lexical.doc_ids_of(asked, units).collect()} == {("b", 2, 1), ("c", None, None)}


def test_samples_and_joins_by_shuffle(spark):
    rows = spark.range(50_000).repartition(16)
    one, two = hashed_sample(rows, 50_000, 300, "id"), hashed_sample(rows.repartition(3), 50_000, 300, "id")
    assert len(one) == 300 and one == two and len(hashed_sample(rows, 50_000, 60_000, "id")) == 50_000
    assert len(hashed_sample(spark.range(21), 21, 10, "id")) == 10
    assert [r["id"] for r in first_rows(rows.orderBy("id"), 3)] == [0, 1, 2]
    plan = rows.join(by_shuffle(spark.range(3)), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_orphans_are_the_same_by_either_way(spark, monkeypatch):
    from lexforge.operators import corpus

    units = spark.createDataFrame([("a", 1, "x", None), ("title_a", 2, "y", "a"), ("title_b", 2, "z", "b"), ("c", 1, "w", None), ("abstract_n", 3, "v", None)], "text_id string, doc_type int, text string, parent string")
    seen = []
    for most in (10, 0):
        monkeypatch.setattr(corpus, "SENT_PARENTS", most)
        kept, orphans = corpus.with_indexed_parent(units)
        seen.append((sorted(r["text_id"] for r in kept.collect()), sorted(r["text_id"] for r in orphans.collect())))
    assert seen == [(["a", "c", "title_a"], ["abstract_n", "title_b"])] * 2


def test_first_harvests_with_ties_and_nulls(spark):
    import datetime as dt

    from lexforge.operators import corpus

    day = lambda n: dt.datetime(2020, 1, n)
    rows = [("a", "one", day(1)), ("a", "two", day(2)), ("b", "x", day(3)), ("b", "y", day(3)), ("c", None, None), ("c", "late", None), ("d", "only", None), (None, "lost", day(1)), ("e", "null", None), ("e", "timed", day(9))]
    table = spark.createDataFrame(rows, "paper_id string, body string, harvested_at timestamp_ntz")
    found = {r["paper_id"]: r["body"] for r in corpus.one_row_per_paper(table, "body").collect()}
    again = {r["paper_id"]: r["body"] for r in corpus.one_row_per_paper(table.orderBy(F.desc("body")), "body").collect()}
    assert corpus.one_row_per_paper(table, "body").count() == 5 and found == again
    assert found["a"] == "one" and found["d"] == "only" and found["e"] == "timed" and found["b"] in "xy"
