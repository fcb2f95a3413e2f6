"""The best documents found in blocks equal those of a plain ranking."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.operators import best, impact, lexical


def plain(queries, postings, n):
    values, out = {}, {}
    for d, t, x in postings:
        values.setdefault(t, {}).setdefault(d, 0.0)
        values[t][d] += x or 0.0
    for q, own in queries.items():
        scores = {}
        for t, w in own:
            for d, x in values.get(t, {}).items():
                scores[d] = scores.get(d, 0.0) + w * x
        out[q] = sorted((-round(s, 6), d) for d, s in scores.items())[:n]
    return {(q, r + 1, d, -s) for q, own in out.items() for r, (s, d) in enumerate(own)}


@pytest.mark.parametrize("block", [1, 40, 10_000])
@pytest.mark.parametrize("name", [int, lambda i: f"p{i}"])
def test_blocks_give_the_ranking_of_all(spark, monkeypatch, block, name):
    """Common and rare terms, weights of zero and below, equal scores, a term twice in a document, several passes."""
    rng = random.Random(block)
    terms = [f"t{k}" for k in range(30)]
    postings = [(name(i), t, rng.choice([0.0, 0.25, rng.random()])) for i in range(300) for t in rng.choices(terms, [40 / (k + 1) for k in range(30)], k=6)] + [(name(7), "t3", None)]
    queries = {q: [(t, rng.choice([-0.5, 0.0, 1.0, rng.random()])) for t in rng.sample([*terms, "none"], rng.randint(1, 5))] for q in range(60)}
    monkeypatch.setattr(best, "BLOCK", block)
    monkeypatch.setattr(best, "MOST_TERMS", 70)
    kind = "long" if name is int else "string"
    asked = spark.createDataFrame([(q, t, float(w)) for q, own in queries.items() for t, w in own], "query_id long, term string, w double")
    rows = best.gathered(spark.createDataFrame(postings, f"doc {kind}, term string, x double"))
    found = lexical.top(best.best(asked, rows, 4, "doc", kind), 4).select("query_id", "rank", "doc", F.round("score", 6))
    assert {(q, r, d, round(s, 6) + 0.0) for q, r, d, s in map(tuple, found.collect())} == {(q, r, d, s + 0.0) for q, r, d, s in plain(queries, postings, 4)}


@pytest.mark.parametrize("block", [300, 3000, 10_000])
def test_long_queries_are_compared_at_once(monkeypatch, block):
    """Documents that are alike, weights below zero, terms in no document, queries that match hardly anything; no document is scored term by term."""
    import pickle

    import pyarrow as pa

    rng = random.Random(block)
    terms = [f"t{k}" for k in range(60)]
    shares = [40 / (k + 1) for k in range(60)]
    texts = {i: {t: rng.choice([0.25, rng.random()]) for t in set(rng.choices(terms, shares, k=15))} for i in range(500)}
    texts |= {i + 500: own for i, own in texts.items() if i < 200}
    queries = {q: {t: rng.choice([-0.1, 1.0, rng.random()]) for t in {*rng.choices([*terms, "none"], [*shares, 5], k=25), *terms[:8]}} for q in range(60)}
    queries[60] = {f"t{k}": -1.0 for k in range(20)}
    queries[61] = {f"t{k}": 1.0 for k in range(40, 60)}
    monkeypatch.setattr(best, "BLOCK", block)
    monkeypatch.setattr(best, "CELLS", 5000, raising=False)
    called = []
    monkeypatch.setattr(best._Block, "add", lambda *more: called.append(more))
    asked = pa.table(dict(zip(("query_id", "term", "w"), zip(*[(q, t, float(w)) for q, own in queries.items() for t, w in own.items()]))))
    rows = [(d, t, x) for d, own in texts.items() for t, x in own.items()]

    class Sent:
        value = pickle.dumps(best._packed(asked.sort_by("query_id").combine_chunks()))

    batch = pa.record_batch(dict(zip(("doc", "term", "x"), map(pa.array, zip(*rows)))))
    found = {}
    for out in best._scored(Sent, 5, "doc", None)(iter([batch])):
        for q, d, s in zip(*(c.to_pylist() for c in out.columns)):
            found.setdefault(q, []).append((-round(s, 6), d))
    got = {(q, r + 1, d, -s + 0.0) for q, own in found.items() for r, (s, d) in enumerate(sorted(own)[:5])}
    assert got == {(q, r, d, s + 0.0) for q, r, d, s in plain({q: list(own.items()) for q, own in queries.items()}, rows, 5)} and not called


def test_documents_related_to_seeds_are_scored_once(spark, monkeypatch):
    """And of the seeds alone vectors are made besides, not of all texts."""
    from lexforge.plans import learning

    plan = learning.related_docs(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_postings_are_counted_where_they_lie(spark, size):
    rng = random.Random(size)
    rows = [(d, f"t{k}", 1.0) for d in range(200) if d % 9 for k in rng.sample(range(12), rng.randint(1, 6))]
    placed = best.gathered(spark.createDataFrame(rows, "doc long, term string, x double"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        found = {r["term"]: (r["df"], r["docs"]) for r in best.frequencies(placed, "doc").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found.pop(None) == (0, len({d for d, _, _ in rows}))
    assert found == {f"t{k}": (sum(t == f"t{k}" for _, t, _ in rows), 0) for k in range(12)}


def test_only_the_best_leave_a_block():
    class Sent:
        value = None

    import pickle

    import pyarrow as pa

    Sent.value = pickle.dumps(best._packed(pa.table({"query_id": [1], "term": ["a"], "w": [1.0]})))
    rows = pa.record_batch({"doc": np.arange(50_000), "term": ["a"] * 50_000, "x": np.arange(50_000) / 1e4})
    out = list(best._scored(Sent, 3, "doc", None)(iter([rows])))
    assert [b.column("doc").to_pylist() for b in out] == [[49_999, 49_998, 49_997]]
    assert list(best._scored(Sent, 3, "doc", None)(iter([]))) == []


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["lexical_topk", "lexical_topk_zero_fill", "lexical_paging", "rank_fitness", "impact_search", "impact_search_pruned", "related_docs", "field_weighted_batch", "result_lines"])
def test_a_search_keeps_no_postings(spark, monkeypatch, name):
    """What is written to the checkpoint folder stays far below the postings of all texts, which took more disk than the tables."""
    from pyspark.sql.classic.dataframe import DataFrame

    from lexforge.plans import files, learning, search

    postings, sizes, plain_checkpoint = search.lnc_weights(spark, FOLDER).count(), [], DataFrame.checkpoint

    def watched(self, *args, **more):
        out = plain_checkpoint(self, *args, **more)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "checkpoint", watched)
    assert (search.QUERIES | learning.QUERIES | files.QUERIES)[name](spark, FOLDER).count()
    assert sizes and max(sizes) < postings / 4


@pytest.mark.parametrize("name", ["index_search", "index_search_named"])
def test_pairs_of_a_stored_index_are_ranked_before_they_are_moved(spark, name):
    from lexforge.plans import files, search

    plan = (search.QUERIES | files.QUERIES)[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ltc" not in plan


def test_smoothed_postings_are_the_smoothed_counts_of_whole_texts(spark):
    """Repeated words, neighbours at distance 0, a neighbour set again later, unknown words, texts without any."""
    rng = random.Random(9)
    near = [(f"w{a}", f"w{b}", rng.choice([0.0, 0.5, 1.5, rng.random()])) for a in range(12) for b in rng.sample(range(14), 3)]
    texts = [(i * 7, rng.choices([f"w{k}" for k in range(14)] + ["other"], k=rng.randint(0, 12))) for i in range(80)] + [(5, []), (9, ["other"])]
    neighbours = spark.createDataFrame(near, "term string, near string, dist double")
    lists = spark.createDataFrame(texts, "doc_id long, t array<string>")
    positions = impact.token_positions(lists.withColumnRenamed("t", "tokens"), "doc_id").join(neighbours.select("term").distinct(), "term", "left_semi")
    counts = {(r["doc_id"], r["term"]): r["val"] for r in impact.smoothed_counts(positions, neighbours, "doc_id").collect()}
    square = {}
    for (d, _), v in counts.items():
        square[d] = square.get(d, 0.0) + v * v
    found = {(r["doc_id"], r["term"]): r["x"] for r in lists.mapInArrow(impact.smoothed_postings(neighbours), "doc_id long, term string, x double").collect()}
    assert found == pytest.approx({k: v / (square[k[0]] or 1.0) for k, v in counts.items()}) and found


def test_a_smoothed_search_keeps_no_vectors(spark, monkeypatch):
    """Nothing of a document but its place among a block's best is written or moved."""
    from pyspark.sql.classic.dataframe import DataFrame

    from lexforge.plans import learning

    seen, plain_checkpoint = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *args, **more: seen.append(self.columns) or plain_checkpoint(self, *args, **more))
    assert learning.smoothed_search(spark, FOLDER).count()
    assert seen and not any("doc_id" in columns for columns in seen)


def test_every_match_is_judged_where_it_lies(spark, monkeypatch):
    """All matches, zeros and negative scores included, in several passes and blocks, with and without a judgement."""
    rng = random.Random(3)
    postings = [(i, f"t{k}", rng.choice([0.0, rng.random()])) for i in range(120) for k in rng.sample(range(9), 2)]
    queries = {q: [(f"t{k}", rng.choice([-1.0, 0.0, 1.0])) for k in rng.sample(range(11), 2)] for q in range(20)}
    judged = {(q, i): 1 for q in range(20) for i in rng.sample(range(120), 5)}
    monkeypatch.setattr(best, "BLOCK", 50)
    monkeypatch.setattr(best, "ROWS", 30)
    monkeypatch.setattr(best, "MOST_BESIDE", 40)
    asked = spark.createDataFrame([(q, t, w) for q, own in queries.items() for t, w in own], "query_id long, term string, w double")
    beside = spark.createDataFrame([(*k, v) for k, v in judged.items()], "query_id long, doc long, relevance int")
    found = best.every(asked, best.gathered(spark.createDataFrame(postings, "doc long, term string, x double")), "doc", "long", None, beside)
    rows = found.select("query_id", "doc", "relevance", F.round("score", 6)).collect()
    assert {(q, d, r, s + 0.0) for q, d, r, s in map(tuple, rows)} == {(q, d, judged.get((q, d)), s + 0.0) for q, _, d, s in plain(queries, postings, 1000)}
    assert len(rows) == len(plain(queries, postings, 1000))


def test_an_evaluation_moves_no_pairs(spark):
    from lexforge.plans import learning

    plan = learning.eval_dump(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("MapInArrow")]
    assert "Aggregate" not in top and "strategy=broadcast" in top


@pytest.mark.parametrize("weights", [[0.1, 0.3, 0.7], [0.5, 0.0, -0.2]])
def test_graded_blocks_hold_the_best_of_every_weighting(spark, monkeypatch, weights):
    """Equal scores, parts without a weight, weights that turn the order round, several passes and blocks."""
    rng = random.Random(len(weights))
    parts = {i: rng.randrange(4) for i in range(200)}
    postings = [(i, f"t{k}", rng.choice([0.0, 0.25, rng.random()]), parts[i]) for i in range(200) for k in rng.sample(range(9), 3)]
    queries = {q: [(f"t{k}", rng.choice([0.0, 0.5, rng.random()])) for k in rng.sample(range(11), 3)] for q in range(20)}
    grid = [(w, p, weights[(w + p) % 3]) for w in range(3) for p in range(3)]  # none for part 3
    monkeypatch.setattr(best, "BLOCK", 60)
    monkeypatch.setattr(best, "MOST_KEPT", 90)
    asked = spark.createDataFrame([(q, t, float(w)) for q, own in queries.items() for t, w in own], "query_id long, term string, w double")
    rows = spark.createDataFrame(postings, "doc long, term string, x double, part int").repartition(3, "doc").sortWithinPartitions("doc")
    found = best.graded(asked, rows, spark.createDataFrame(grid, "w_id int, part int, weight double"), 4, "doc").collect()
    assert len(found) == len({(r["query_id"], r["doc"]) for r in found}) and all(r["part"] == parts[r["doc"]] for r in found)
    every = {}
    for q, _, d, s in plain(queries, [p[:3] for p in postings], 1000):
        every.setdefault(q, []).append((d, s))
    exact = {(q, d): s for q, own in every.items() for d, s in own}
    assert all(abs(r["score"] - exact[r["query_id"], r["doc"]]) < 1e-6 for r in found)
    got = {(r["query_id"], r["doc"]) for r in found}
    sums = {}
    for d, t, x, _ in postings:
        for q, own in queries.items():
            for term, w in own:
                if term == t:
                    sums[q, d] = sums.get((q, d), 0.0) + w * x
    for w in range(3):
        factor = {p: f for i, p, f in grid if i == w}
        for q in queries:
            order = sorted((-round(s * factor[parts[d]], 6), d) for (k, d), s in sums.items() if k == q and parts[d] in factor)
            assert {(q, d) for _, d in order[:4]} <= got


def test_a_weight_grid_moves_only_the_best_pairs(spark, monkeypatch):
    from lexforge.operators import ranking
    from lexforge.plans import learning

    seen, plain_fitness = [], ranking.weights_fitness
    monkeypatch.setattr(ranking, "weights_fitness", lambda partial, *more: seen.append(partial._jdf.queryExecution().optimizedPlan().toString()) or plain_fitness(partial, *more))
    assert learning.weight_grid_fitness(spark, FOLDER).count() == 6
    assert seen and all("MapInArrow" in plan and "Aggregate" not in plan[: plan.index("MapInArrow")] for plan in seen)
