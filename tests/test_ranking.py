import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.operators import ranking, recommend
from lexforge.plans import learning


def test_fitness(spark):
    ranked = spark.createDataFrame([(1, d, d) for d in range(1, 6)] + [(2, 1, 9)], "query_id long, rank int, doc long")
    relevant = spark.createDataFrame([(1, 1), (1, 4), (1, 4), (3, 1)], "query_id long, doc long")
    found = {r["query_id"]: r["fitness"] for r in ranking.rank_fitness(ranked, relevant).collect()}
    assert found == {1: pytest.approx(1 + 1 / math.sqrt(4)), 3: 0}


def test_unjudged_documents(spark):
    scored = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4)], "query_id long, doc long, score double")
    judged = spark.createDataFrame([(1, 2, 3)], "query_id long, doc long, relevance int")
    assert sorted(map(tuple, ranking.evaluation(scored, judged).collect())) == [(1, 1, 5, 0.5), (1, 2, 3, 0.4)]


def partial(spark):
    return spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 0.8), (1, 3, 1, 0.1), (2, 4, 2, 0.5), (2, 5, 1, 0.6)], "query_id long, doc long, doc_type int, score double")


def test_many_weightings_and_their_evolution(spark):
    relevant = spark.createDataFrame([(1, 2), (2, 4)], "query_id long, doc long")
    weights = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (1, 1, 0.1), (1, 2, 0.9)], "w_id int, doc_type int, weight double")
    found = {r["w_id"]: r["fitness"] for r in ranking.weights_fitness(partial(spark), relevant, weights).collect()}
    assert found == {0: pytest.approx(2 / math.sqrt(2)), 1: pytest.approx(2.0)}
    best = ranking.evolve_weights(partial(spark), relevant, {1: 0.5, 2: 0.5}, rounds=4, seed=3)
    assert best[0][0] >= found[0] and all(sum(w.values()) == pytest.approx(1) for _, w in best)
    assert ranking.evolve_weights(partial(spark), relevant, {1: 0.5, 2: 0.5}, rounds=2, seed=3) == ranking.evolve_weights(partial(spark), relevant, {1: 0.5, 2: 0.5}, rounds=2, seed=3)


def test_pairs_and_machine(spark):
    rng = np.random.default_rng(1)
    true = np.array([1.0, -2.0, 0.5])
    rows, features = [], []
    for q in range(5):
        x = rng.normal(size=(8, 3))
        for place, i in enumerate(np.argsort(x @ true)):
            rows.append((q, q * 10 + int(i), place))
            features.append((q * 10 + int(i), [float(a) for a in x[i]]))
    lists = spark.createDataFrame(rows + [(0, 999, 50)], "qid long, doc long, target int")
    table = spark.createDataFrame(features + [(998, None)], "doc long, v array<double>")
    pairs = ranking.rank_pairs(lists, table)
    assert pairs.count() == 5 * 8 * 7
    model = ranking.rank_machine(pairs)
    got = lists.join(table, "doc").withColumn("s", recommend.margin(F.col("v"), model)).collect()
    for q in range(5):
        own = sorted((r for r in got if r["qid"] == q), key=lambda r: r["s"])
        assert np.corrcoef([r["target"] for r in own], range(8))[0, 1] > 0.9
    line = spark.range(1).select(ranking.svm_rank_line(F.lit(3), F.lit(7), F.array(F.lit(0.5), F.lit(-1.0)))).first()[0]
    assert line == "3 qid:7  1:0.5 2:-1.0"


def test_history_and_training_set(spark):
    events = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", 10), (1, 2, "2024-01-02 00:00:00", 11), (1, 3, "2024-01-02 00:00:00", 12), (2, 4, "2024-01-01 00:00:00", 10), (1, 5, None, 13)], "user_id long, event_id long, t string, doc_id long").withColumn("ts", F.to_timestamp("t"))
    assert sorted(map(tuple, recommend.recent_history(events, 2).collect())) == [(1, 11, 2), (1, 12, 1), (2, 10, 1)]
    candidates = spark.createDataFrame([(1, 11), (1, 40), (2, 41)], "user_id long, doc_id long")
    assert sorted(map(tuple, recommend.unseen(candidates, events).collect())) == [(1, 40), (2, 41)]
    every = spark.range(10, 60).withColumnRenamed("id", "doc_id")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    made = recommend.training_set(events, candidates, every, users, 6).collect()
    for user, known in ((1, {10, 11, 12, 13, 40}), (2, {10, 41}), (3, set())):
        own = {r["doc_id"]: r["label"] for r in made if r["user_id"] == user}
        assert known <= set(own) and len(set(own) - known) == 6
        assert {d for d, label in own.items() if label} == {r["doc_id"] for r in events.collect() if r["user_id"] == user}


def test_recommendations(spark):
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, [float(a) for a in rng.normal(size=4) + (3 if i % 2 else -3)]) for i in range(60)], "doc_id long, v array<double>")
    rows = spark.createDataFrame([(i, 1 if i % 2 and i < 20 else 0) for i in range(60)] + [(900, 0)], "doc_id long, label int")
    found = recommend.recommend(rows, vectors, 10).collect()
    assert len(found) == 10 and all(r["doc_id"] % 2 == 1 and r["doc_id"] >= 20 for r in found)
    assert recommend.recommend(rows.where("label = 0"), vectors, 10).count() == 0


def test_related_documents(spark):
    vectors = spark.createDataFrame([(d, t, 0.5) for d, ts in {1: "ab", 2: "ab", 3: "bc", 4: "xy", 5: "xa"}.items() for t in ts], "doc_id long, term string, val double")
    paragraph = spark.createDataFrame([(1, [0.0]), (2, [5.0]), (3, [1.0]), (4, None)], "doc_id long, v array<float>")
    found = [(r["query_id"], r["rank"], r["doc"], r["score"]) for r in recommend.related(vectors.where("doc_id in (1, 5)").select("doc_id"), vectors, paragraph, "doc_id", 3).orderBy("query_id", "rank").collect()]
    assert [x for x in found if x[0] == 1] == [(1, 1, 1, 0.0), (1, 2, 3, -1.0), (1, 3, 2, -25.0)]
    assert {x[2] for x in found if x[0] == 5} <= {1, 2, 4, 5}


def test_recommendations_from_terms_and_history(spark):
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(d, t, 0.3) for d in range(40) for t in ("even" if d % 2 == 0 else "odd", f"t{d % 5}")], "doc_id long, term string, val double")
    paragraph = spark.createDataFrame([(d, [float(a) for a in rng.normal(size=3) + (4 if d % 2 else -4)]) for d in range(40)], "doc_id long, v array<double>")
    history = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 5, 3)], "user_id long, doc_id long, rank int")
    terms = spark.createDataFrame([(2, "odd"), (2, "t1")], "user_id long, term string")
    found = [r["doc_id"] for r in recommend.recommend_to(1, history, vectors, paragraph, n=5).collect()]
    assert len(found) == 5 and all(d % 2 == 1 and d not in (1, 3, 5) for d in found)
    assert 0 < recommend.recommend_to(2, history, vectors, paragraph, terms, n=5).count() <= 5
    assert recommend.recommend_to(3, history, vectors, paragraph, terms).count() == 0
    near = {(r["user_id"], r["doc_id"]) for r in recommend.history_candidates(history, vectors, paragraph, 4, 2).collect()}
    assert near and {u for u, _ in near} == {1}


def test_every_embedding_is_ranked_with_all_its_features(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, int(i >= 250), [float(x) for x in rng.normal(size=64) + (i % 50) / 50]) for i in range(270)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    scores = learning.svm_rank_scores(spark, str(tmp_path)).collect()
    lines = {r["doc"]: r for r in learning.svm_rank_lines(spark, str(tmp_path)).collect()}
    assert sorted(r["doc"] for r in scores) == sorted(lines) == list(range(270))
    assert all(len(r["line"].split("  ")[1].split()) == 64 for r in lines.values())
    lists = {}
    for doc, r in lines.items():
        lists.setdefault(r["qid"], []).append((int(r["line"].split()[0]), doc))
    assert sorted(lists[1]) == [(20 - k, 250 + k) for k in reversed(range(20))]
    for qid, own in lists.items():
        assert len({doc >= 250 for _, doc in own}) == 1 and len(own) < 2 * learning.LIST
        assert [t for t, _ in sorted(own)] == list(range(1, len(own) + 1)) and [d for _, d in sorted(own)] == sorted((d for _, d in own), reverse=True)


def test_recommendations_for_every_fiftieth_user_from_all_documents(spark, tmp_path):
    rng = np.random.default_rng(7)
    vectors = [(i, 0, [float(x) for x in rng.normal(size=64) + (1 if i >= 500 else -1)]) for i in range(600)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    events = [(500 + 7 * k % 100, user) for user in (0, 50, 51) for k in range(user // 50, 12)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    found = learning.recommend_svm(spark, str(tmp_path)).collect()
    assert {r["user_id"] for r in found} == {0, 50} and len(found) == 40
    assert any(r["doc_id"] >= 500 for r in found)
    items, history = spark.range(600).withColumnRenamed("id", "doc_id"), spark.createDataFrame([(50, d) for d in {e for e, u in events if u == 50}], "user_id long, doc_id long")
    candidates = history.select("user_id", (F.col("doc_id") * 7 % 600).alias("doc_id"))
    rows = recommend.training_set(history, candidates, items, history.select("user_id").distinct(), 100)
    paragraph = spark.createDataFrame([(i, v) for i, _, v in vectors], "doc_id long, v array<float>")
    alone = [(r["doc_id"], pytest.approx(r["score"], abs=1e-4)) for r in recommend.recommend(rows.select("doc_id", "label"), paragraph, 20).collect()]
    assert sorted(alone, key=lambda x: x[0]) == sorted((r["doc_id"], r["score"]) for r in found if r["user_id"] == 50)


def test_weight_evolution_runs_all_rounds(spark, monkeypatch):
    asked = []
    whole = inspect.signature(ranking.evolve_weights)

    def evolve(*args, **named):
        bound = whole.bind(*args, **named)
        bound.apply_defaults()
        asked.append(bound.arguments["rounds"])
        return [(1.0, bound.arguments["start"])]

    monkeypatch.setattr(ranking, "evolve_weights", evolve)
    monkeypatch.setattr(learning, "_partial", lambda s, f: s.createDataFrame([], "query_id long, doc long, doc_type int, score double"))
    monkeypatch.setattr(learning, "_relevant", lambda s, f: s.createDataFrame([], "query_id long, doc long"))
    assert learning.weight_evolution(spark, "").count() == 5
    assert asked == [40]
