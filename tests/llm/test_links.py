import random

from lexforge.llm.links import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root if find(x) != x}


def run(spark, edges):
    made = spark.createDataFrame(edges, "a long, b long")
    return {r["a"]: r["b"] for r in components(made).collect()}


def test_chains_stars_and_random_graphs(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(200)]
    loose = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    edges = chain + star + loose + [(5, 5), chain[3], (7, 6)]
    assert run(spark, edges) == plain([e for e in edges if e[0] != e[1]])


def test_null_ends_and_no_links(spark):
    assert run(spark, [(None, 1), (2, None), (3, 3)]) == {}
    assert run(spark, []) == {}
