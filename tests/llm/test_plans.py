"""No join of these queries is left to an estimate of sizes: estimates don't see what explode and Python functions put out."""

import os

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from lexforge.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ["p1_found", "p1_groups", "p3_found", "p4_found", "p4_entities", "p5_found", "p6_text", "p8_mix", "p9_found"])
def test_every_join_names_its_strategy(spark, monkeypatch, name):
    plans = []

    def watch(method):
        plain = getattr(DataFrame, method)

        def run(self, *args, **more):
            plans.append(self._jdf.queryExecution().optimizedPlan().toString())
            return plain(self, *args, **more)

        monkeypatch.setattr(DataFrame, method, run)

    for method in ("checkpoint", "collect"):
        watch(method)
    queries.queries()[name](spark, FOLDER).collect()
    joins = [line.strip() for plan in plans for line in plan.split("\n") if line.strip(" :+-").startswith("Join ")]
    assert [j for j in joins if "strategy=" not in j] == []
    assert not any("BroadcastNestedLoop" in p or "Cartesian" in p for p in plans)
    assert joins or name == "p9_found"
