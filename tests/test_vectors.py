import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.functions import vectors as V
from lexforge.operators import neighbours


def table(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<float>")


@pytest.mark.parametrize("measure", ["euclid", "dot"])
@pytest.mark.parametrize("tile", [neighbours.TILE, 40])
def test_nearest_equals_brute_force(spark, monkeypatch, measure, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    x[10] = x[20] = x[30]
    own = table(spark, [*x, None])
    found = {(r["src_id"], r["rank"]): (r["dst_id"], r["value"]) for r in neighbours.nearest(own.where("id % 10 = 0"), own, 4, measure).collect()}
    y = x.astype(float)
    for i in range(0, 150, 10):
        value = y @ y[i] if measure == "dot" else ((y - y[i]) ** 2).sum(1)
        order = sorted(range(150), key=lambda j: (-round(value[j], 9) if measure == "dot" else round(value[j], 9), j))[:4]
        assert [found[i, k + 1][0] for k in range(4)] == order
        assert [found[i, k + 1][1] for k in range(4)] == [pytest.approx(value[j], abs=1e-6) for j in order]


def test_no_vectors(spark):
    none = table(spark, [])
    assert neighbours.nearest(none, none, 3).count() == 0
    assert neighbours.nearest(table(spark, [[1, 2]]), none, 3).count() == 0


def test_hashing_finds_most(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 16))
    own = table(spark, [centres[i % 10] + 0.05 * rng.normal(size=16) for i in range(300)])
    asked = own.where("id < 20")
    exact = {(r["src_id"], r["dst_id"]) for r in neighbours.nearest(asked, own, 10).collect()}
    near = {(r["src_id"], r["dst_id"]) for r in neighbours.nearest_by_hashing(asked, own, 10, 2.0).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_two_components_keep_most_of_flat_data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 6))
    found = np.array([[r["x"], r["y"]] for r in neighbours.two_components(table(spark, x)).orderBy("id").collect()])
    assert (found**2).sum() == pytest.approx((x**2).sum(), rel=1e-4)


def test_columns(spark):
    rows = table(spark, [[3, 0, 4], [0, 0, 0], None])
    made = rows.select(V.norm(F.col("v")).alias("n"), V.unit(F.col("v")).alias("u"), V.to_sparse(F.col("v")).alias("s"), V.to_dense(V.to_sparse(F.col("v")), 3).alias("d"), V.repeated_to(F.col("v"), 5).alias("r")).collect()
    assert made[0]["n"] == 5 and made[0]["u"] == [0.6, 0, 0.8] and [tuple(x) for x in made[0]["s"]] == [(0, 3), (2, 4)]
    assert made[0]["d"] == [3, 0, 4] and made[0]["r"] == [3, 0, 4, 3, 0]
    assert made[1]["u"] == [0, 0, 0] and made[1]["s"] == [] and made[1]["d"] == [0, 0, 0]
    assert made[2]["n"] is None and made[2]["u"] is None
    assert rows.select(V.dot(F.col("v"), F.array(F.lit(1.0)))).first()[0] is None
    assert [r[0] for r in rows.select(V.inverse_square(F.lit(3.0))).limit(1).collect()] == [5.0]


def test_sums(spark):
    own = table(spark, [[1, 2], [3, 4], [5, 6]])
    chosen = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (2, 9)], "id long, vec_id long")
    assert sorted((r["id"], r["v"]) for r in neighbours.vector_sum(chosen, own).collect()) == [(0, [6, 8]), (1, [3, 4])]
