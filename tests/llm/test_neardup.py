import random
from itertools import combinations

import numpy as np

from lexforge.llm import neardup
from lexforge.llm.papers import words_of

from .tables import papers


def triples(text):
    w = words_of(text)
    return set(zip(w, w[1:], w[2:]))


def brute(rows):
    """All pairs of similarity 0.5 or more, by comparing every pair."""
    sets = {r["paper_id"]: triples(f"{r.get('title') or ''} {r.get('body') or ''}") for r in rows}
    out = set()
    for p, q in combinations(sorted(sets), 2):
        a, b = sets[p], sets[q]
        if a and b and 2 * len(a & b) >= len(a | b):
            out.add((p, q))
    return out


def corpus(seed=1, bases=30):
    rng = random.Random(seed)
    stock = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(bases):
        words = rng.choices(stock, k=rng.randint(40, 200))
        rows.append({"paper_id": f"{i:03d}-0", "title": "On " + " ".join(words[:4]), "body": " ".join(words)})
        for k in range(1, rng.randint(1, 4)):
            other = list(words)
            for _ in range(rng.randint(1, max(2, len(words) // 12))):
                at = rng.randrange(len(other))
                other[at : at + rng.randint(0, 2)] = rng.choices(stock, k=rng.randint(0, 2))
            rows.append({"paper_id": f"{i:03d}-{k}", "title": "On " + " ".join(words[:4]), "body": " ".join(other)})
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    found = {tuple(r) for r in neardup.near_pairs(papers(spark, rows)).collect()}
    true = brute(rows)
    assert len(true) > 15
    assert found <= true
    assert len(found) >= 0.97 * len(true)


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [
        {"paper_id": "a", "title": "one two", "body": "three four five six"},
        {"paper_id": "b", "title": "One, two three", "body": "four FIVE six!"},  # the same triples as a
        {"paper_id": "c", "title": "one two three", "body": "four five six"},
        {"paper_id": "c", "title": "one two three", "body": "four five six"},  # harvested twice
        {"paper_id": "d", "title": None, "body": None},
        {"paper_id": "e", "title": "two words", "body": ""},
        {"paper_id": "f", "title": "two words", "body": None},
        {"paper_id": None, "title": "one two", "body": "three four five six"},
        {"paper_id": "g", "title": "", "body": long},
        {"paper_id": "h", "title": "end", "body": long},
    ]
    found = {tuple(r) for r in neardup.near_pairs(papers(spark, rows)).collect()}
    assert found == {("a", "b"), ("a", "c"), ("b", "c"), ("g", "h")}
    groups = {r["paper_id"]: (r["group_id"], r["n_links"]) for r in neardup.groups(papers(spark, rows)).collect()}
    assert groups == {"a": ("a", 0), "b": ("a", 0), "c": ("a", 0), "d": ("d", 0), "e": ("e", 0), "f": ("f", 0), "g": ("g", 1), "h": ("g", 1)}


def test_empty_table(spark):
    assert neardup.near_pairs(papers(spark, [])).count() == 0
    assert neardup.groups(papers(spark, [])).count() == 0


def test_every_copy_is_paired_at_any_number_of_copies(spark, monkeypatch):
    body = " ".join(f"y{i}" for i in range(40))
    rows = [{"paper_id": f"{i:03d}", "title": "t", "body": body} for i in range(60)] + [{"paper_id": f"z{i}", "title": "t", "body": body + " more"} for i in range(20)]
    for copies in (neardup.COPIES, 7):  # one tile, and several
        monkeypatch.setattr(neardup, "COPIES", copies)
        found = [tuple(r) for r in neardup.near_pairs(papers(spark, rows)).collect()]
        assert len(found) == len(set(found)) == 80 * 79 // 2
    assert {r["group_id"] for r in neardup.groups(papers(spark, rows)).collect()} == {"000"}


def test_two_thousand_copies_and_their_neighbour(spark):
    body = " ".join(f"y{i}" for i in range(40))
    rows = [{"paper_id": f"{i:04d}", "title": "t", "body": body} for i in range(2000)] + [{"paper_id": "z", "title": "t", "body": body + " more"}]
    pairs = neardup.near_pairs(papers(spark, rows))
    assert pairs.count() == 2001 * 2000 // 2
    assert pairs.where("paper_id_2 = 'z'").count() == 2000


def test_crowded_anchors_are_compared_in_tiles(spark, monkeypatch):
    """Many near-copies share their anchors; whole pieces, tiles and flooded anchors find the same pairs."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(words)
        own[rng.randrange(120)] = f"n{i}"
        rows.append({"paper_id": f"{i:03d}", "title": "t", "body": " ".join(own)})
    true = brute(rows)
    assert len(true) == 90 * 89 // 2
    seen = []
    for crowd, hits in ((2048, 10**9), (16, 10**9), (16, 20), (1, 10**9)):
        monkeypatch.setattr(neardup, "CROWD", crowd)
        monkeypatch.setattr(neardup, "PROBE_HITS", hits)
        found = {tuple(r) for r in neardup.near_pairs(papers(spark, rows)).collect()}
        assert found <= true and len(found) >= 0.99 * len(true)
        seen.append(found)
    assert seen[0] == seen[1] == seen[2] == seen[3]


def test_fingerprints_that_agree_in_three_places_share_an_anchor():
    rng = np.random.default_rng(0)
    for agree in range(neardup.M + 1):
        a = rng.integers(0, neardup.PRIME, (20, neardup.M))
        b = rng.integers(0, neardup.PRIME, (20, neardup.M))
        for i in range(20):
            same = rng.choice(neardup.M, agree, replace=False)
            b[i, same] = a[i, same]
        x, y = neardup.anchors_of(a), neardup.anchors_of(b)
        for i in range(20):
            assert bool(set(x[i]) & set(y[i])) == (agree >= neardup.K)


def test_an_anchor_is_a_polynomial_through_its_symbols():
    """Fingerprints of one codeword have one anchor from all subsets."""
    c = [5, 7, 11]
    word = np.array([[sum(k * (i + 1) ** e for e, k in enumerate(c)) % neardup.PRIME for i in range(neardup.M)]])
    assert len(set(neardup.anchors_of(word)[0])) == 1


def test_ids_beyond_the_bound_are_joined_by_shuffle(spark, monkeypatch):
    rows = corpus(3, 12)
    sent = sorted(map(tuple, neardup.near_pairs(papers(spark, rows)).collect()))
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    assert sent and sorted(map(tuple, neardup.near_pairs(papers(spark, rows)).collect())) == sent
