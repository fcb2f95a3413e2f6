import random
from collections import defaultdict

import pytest

from lexforge.operators import skew


def tf(spark, rows):
    return spark.createDataFrame(rows, "gram_id long, doc_id long, lnc double, _salt string, field string, key_id long, n long, s double").repartition(3)


def sample(seed=1, n=6000):
    rng = random.Random(seed)
    return [(rng.choice([7, 7, 7, rng.randrange(2000), None]), rng.choice([1, rng.randrange(500)]), rng.choice([None, rng.random()]), "x", "y", 1, 2, 3.0) for _ in range(n)]


def test_totals_and_dominant_keys_equal_a_plain_count(spark):
    rows = sample() + sample()[:50] * 2
    plain = defaultdict(lambda: [0, 0, None])
    for g, d, w, *_ in rows:
        for field, key in (("gram_id", g), ("doc_id", d)):
            own = plain[field, key]
            own[0] += 1
            if w is not None:
                own[1] += 1
                own[2] = (own[2] or 0) + w
    found = {(r["field"], r["key_id"]): (r["n_rows"], r["n_weights"], r["lnc_sum"]) for r in skew.key_totals(tf(spark, rows)).collect()}
    assert set(found) == set(plain)
    for k, (n, w, s) in plain.items():
        assert found[k][:2] == (n, w) and found[k][2] == (None if s is None else pytest.approx(s))
    heavy = {k for k, (n, *_) in plain.items() if n >= 0.005 * len(rows) and k[1] is not None}
    assert {tuple(r) for r in skew.dominant_keys(tf(spark, rows)).collect()} == heavy


def test_heavy_keys_are_salted(spark):
    large = skew.heavy_keys(tf(spark, sample()), ["gram_id", "doc_id"])
    assert 7 in large["gram_id"] and 1 in large["doc_id"] and None not in large["gram_id"]
    with pytest.raises(ValueError):
        skew.heavy_keys(tf(spark, []), ["gram_id"], 1e-6)


def test_empty_table_and_null_columns(spark):
    assert skew.key_totals(tf(spark, [])).count() == 0
    assert skew.dominant_keys(tf(spark, [])).count() == 0
    rows = [(None, None, None, None, None, None, None, None)] * 4
    assert {tuple(r) for r in skew.key_totals(tf(spark, rows)).collect()} == {("gram_id", None, 4, 0, None), ("doc_id", None, 4, 0, None)}
    assert skew.dominant_keys(tf(spark, rows)).count() == 0


def test_one_key_has_all_rows(spark):
    rows = [(3, 4, 0.5, None, None, None, None, None)] * 500
    assert {tuple(r) for r in skew.dominant_keys(tf(spark, rows)).collect()} == {("gram_id", 3), ("doc_id", 4)}
