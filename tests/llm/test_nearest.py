import heapq
import math
import time

import numpy as np
import pytest

from lexforge.llm import nearest

from .tables import papers


def row(i, v, **more):
    return {"paper_id": f"{i:05d}", "other": None if v is None else ([None if x is None else float(x) for x in v], None, None)} | more


def brute(rows, k=5):
    usable = {}
    for r in rows:
        v = r["other"] and r["other"][0]
        if r["paper_id"] and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable.setdefault(r["paper_id"], np.array(v, np.float32).astype(float))
    ids = sorted(usable)
    if len(ids) < 2:
        return set()
    x = np.array([usable[i] / np.linalg.norm(usable[i]) for i in ids])
    s = x @ x.T
    out = set()
    for i, p in enumerate(ids):
        for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k]:
            out.add(tuple(sorted((p, ids[j]))))
    return out


@pytest.mark.parametrize("leaf", [nearest.LEAF, 40])
def test_recall_against_brute_force(spark, monkeypatch, leaf):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 64))
    rows = [row(i, centres[i % 12] + 0.6 * rng.normal(size=64)) for i in range(900)]
    monkeypatch.setattr(nearest.Tree.__init__, "__defaults__", (leaf, 5))
    found = {tuple(r) for r in nearest.neighbour_pairs(papers(spark, rows)).collect()}
    true = brute(rows)
    assert len(found & true) >= (1 if leaf > 100 else 0.95) * len(true)


@pytest.mark.parametrize("n, fitted, asking", [(30, 30, 20), (110, 90, 20), (200, 100, 20)])
def test_calibration_queries_are_not_fitted_where_there_are_others(spark, monkeypatch, n, fitted, asking):
    monkeypatch.setattr(nearest, "SAMPLE", 100)
    monkeypatch.setattr(nearest, "CALIBRATION", 20)
    seen = {}
    tree, visits = nearest.Tree, nearest.calibrated_visits

    def fit(sample, total):
        seen["fitted"] = sample
        return tree(sample, total, 10)

    def calibrate(made, classes, queries, *rest):
        seen.setdefault("asking", nearest.unit_rows(np.array([q["vector"] for q in queries])))
        return visits(made, classes, queries, *rest)

    monkeypatch.setattr(nearest, "Tree", fit)
    monkeypatch.setattr(nearest, "calibrated_visits", calibrate)
    rng = np.random.default_rng(8)
    assert nearest.neighbours(papers(spark, [row(i, rng.normal(size=64)) for i in range(n)])).count() == 5 * n
    assert (len(seen["fitted"]), len(seen["asking"])) == (fitted, asking)
    both = {x.tobytes() for x in seen["fitted"]} & {x.tobytes() for x in seen["asking"]}
    assert len(both) == (20 if n <= 100 else 0)


def test_crowded_leaves_are_fitted_again(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 64))
    rows = [row(i, centres[i % 40] + 0.5 * rng.normal(size=64)) for i in range(1200)]
    for name, value in (("SAMPLE", 100), ("CALIBRATION", 60), ("LEAF", 15)):
        monkeypatch.setattr(nearest, name, value)
    monkeypatch.setattr(nearest.Tree.__init__, "__defaults__", (15, 5))
    made, refined = [], nearest.refined

    def watched(tree, classes, total):
        before = tree.leaves
        made.append((before, refined(tree, classes, total)))
        return made[0][1]

    monkeypatch.setattr(nearest, "refined", watched)
    found = {tuple(r) for r in nearest.neighbour_pairs(papers(spark, rows)).collect()}
    true = brute(rows)
    before, tree = made[0]
    assert tree.leaves > 2 * before and sorted(x for x in tree.leaf_of if x >= 0) == list(range(tree.leaves))
    assert len(found & true) >= 0.95 * len(true)


def test_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(size=64)
    rows = [row(i, same) for i in range(40)] + [row(100 + i, rng.normal(size=64)) for i in range(10)]
    rows += [row(200, None), row(201, [0.0] * 64), row(202, [1.0] * 63), row(203, [float("nan")] + [1.0] * 63), row(204, [float("inf")] + [1.0] * 63), row(205, [None] + [1.0] * 63), row(206, [])]
    rows += [rows[0] | {"harvested_at": None}, row(1, same) | {"paper_id": None}]
    found = {tuple(r) for r in nearest.neighbour_pairs(papers(spark, rows)).collect()}
    assert found == brute(rows)
    lists = nearest.neighbours(papers(spark, rows)).collect()
    assert {r["paper_id"] for r in lists} == {f"{i:05d}" for i in [*range(40), *range(100, 110)]}
    assert sorted(r["neighbour_id"] for r in lists if r["paper_id"] == "00039") == [f"{i:05d}" for i in range(5)]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_vectors(spark, n):
    rows = [row(i, np.arange(64) + i + 1.0) for i in range(n)]
    assert nearest.neighbour_pairs(papers(spark, rows)).count() == (1 if n == 2 else 0)


def test_crowded_leaf_is_split(spark, monkeypatch):
    """All vectors in one leaf, cells and groups of a few: the result stays exact."""
    monkeypatch.setattr(nearest, "CELL", 50)
    monkeypatch.setattr(nearest, "GROUP", 60)
    monkeypatch.setattr(nearest, "VISITS", 70)
    rng = np.random.default_rng(5)
    rows = [row(i, rng.normal(size=64)) for i in range(300)]
    assert {tuple(r) for r in nearest.neighbour_pairs(papers(spark, rows)).collect()} == brute(rows)


def test_best_bin_first_ends_with_every_leaf():
    rng = np.random.default_rng(6)
    x = nearest.unit_rows(rng.normal(size=(2000, 64)))
    tree = nearest.Tree(x, 2000, 50)
    order = tree.leaf_order(x[:50], tree.leaves)
    assert tree.leaves > 8
    assert all(sorted(o) == list(range(tree.leaves)) for o in order)
    assert (order[:, :1] == tree.leaf_order(x[:50], 1)).all()


def queue_order(tree, query, visits):
    queue, out = [(0.0, 0)], []
    while queue and len(out) < visits:
        _, node = heapq.heappop(queue)
        if tree.leaf_of[node] >= 0:
            out.append(int(tree.leaf_of[node]))
        for child in tree.children[node]:
            heapq.heappush(queue, (tree.half[child] - query @ tree.centres[child], child))
    return out


def test_order_is_that_of_a_queue_and_quick_over_many_leaves():
    rng = np.random.default_rng(9)
    x = nearest.unit_rows(rng.normal(size=(30_000, 64)))
    tree = nearest.Tree(x, len(x), 16)
    assert tree.leaves > 3000
    for visits in (1, 40, tree.leaves):
        assert tree.leaf_order(x[:8], visits).tolist() == [queue_order(tree, q, visits) for q in x[:8]]
    began = time.process_time()
    tree.leaf_order(x[:128], tree.leaves)  # as the calibration does, at the driver
    assert time.process_time() - began < 10
