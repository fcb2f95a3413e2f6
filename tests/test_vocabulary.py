"""The vocabulary of whole texts and the joins with it: no plan may send words to the driver because an estimate takes them for few."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from lexforge.functions.text import words
from lexforge.operators import training
from lexforge.plans import files, learning

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def plans(monkeypatch):
    """The optimised plans of all that is run."""
    seen = []

    def watch(method):
        plain = getattr(DataFrame, method)

        def run(self, *args, **more):
            seen.append(self._jdf.queryExecution().optimizedPlan().toString())
            return plain(self, *args, **more)

        monkeypatch.setattr(DataFrame, method, run)

    for method in ("checkpoint", "collect"):
        watch(method)
    return seen


def unnamed(plans):
    return [line.strip() for plan in plans for line in plan.split("\n") if line.strip(" :+-").startswith("Join ") and "strategy=" not in line]


def test_the_vocabulary_of_whole_texts(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(10**9) * 1000 + i, " ".join(rng.choices([f"w{k}" for k in range(60)] + ["the"] * 30, k=rng.randint(0, 40)))) for i in range(300)] + [(5, None), (6, " ! "), (7, "one one one")]
    seen, order, freq = Counter(), [], Counter(w for _, t in rows for w in (t or "").split() if w != "!")
    for _, text in sorted(r for r in rows if r[1]):
        for w in text.split():
            seen[w] += w != "!"
            if seen[w] == 3 and w not in order:
                order.append(w)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        found = training.text_vocabulary(docs, "doc_id", words(F.col("text")), 3).collect()
        none = training.text_vocabulary(docs.limit(0), "doc_id", words(F.col("text")), 3).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["term"]: (r["freq"], r["token_id"]) for r in found} == {w: (freq[w], k) for k, w in enumerate(order)} and none == 0


def test_a_vocabulary_of_token_rows_joins_by_shuffle(spark, plans):
    training.vocabulary(spark.createDataFrame([(1, 0, "a"), (1, 1, "a")], "doc_id long, pos int, term string"), "doc_id", 2).collect()
    assert not [j for j in unnamed(plans) if "_p" not in j]


@pytest.mark.parametrize("name", ["noise_shares", "purged_sequences", "subsample_probs", "pvdm_contexts", "skipgram_pairs", "subsampled_tokens", "labelled_tokens", "negative_checks", "paragraph_vectors"])
def test_no_join_with_the_vocabulary_is_left_to_an_estimate(spark, plans, name):
    query = learning.QUERIES.get(name) or files.QUERIES[name]
    query(spark, FOLDER).collect()
    assert plans and unnamed(plans) == []
