from collections import Counter

from lexforge.llm import frequency
from lexforge.llm.papers import words_of

from .tables import papers


def grams(spark, rows):
    return spark.createDataFrame(rows, "gram_id long, term_id_1 long, term_id_2 long")


def test_words_equal_a_plain_count(spark, monkeypatch):
    for name, value in (("BLOCK_WORDS", 3), ("RANGE", 4), ("BLOCK_RANGES", 1)):  # many blocks and ranges
        monkeypatch.setattr(frequency, name, value)
    bodies = ["The reward; the REWARD.", "state-of-the-art 12 x_y", "", None, "Ärger ärger ÄRGER", "the " * 5000, "---"]
    rows = [{"paper_id": str(i), "body": b} for i, b in enumerate(bodies)] + [{"paper_id": "0", "body": bodies[0]}, {"paper_id": None, "body": "lost"}]
    counted = {r["word"]: (r["n_occurrences"], r["n_texts"]) for r in frequency.body_words(papers(spark, rows))[0].collect()}
    occurrences, presence = Counter(), Counter()
    for b in bodies:
        own = words_of(b or "")
        occurrences.update(own)
        presence.update(set(own))
    assert counted == {w: (n, presence[w]) for w, n in occurrences.items()}


def test_identifiers_are_dense(spark):
    rows = [{"paper_id": str(i), "body": f"w{i} w{i + 1} common"} for i in range(200)]
    made = frequency.word_counts(papers(spark, rows).select("body"))
    assert sorted(r["word_id"] for r in made.collect()) == list(range(202))


def test_marks_of_terms(spark):
    rows = [{"paper_id": str(i), "body": "often " + ("some " if i < 4 else "") + ("seldom" if i < 2 else "")} for i in range(20)] + [{"paper_id": "x", "body": None}]
    terms = spark.createDataFrame([(0, ""), (1, "Often "), (2, "some"), (3, "seldom"), (4, "never"), (5, None), (6, "  OFTEN")], "term_id long, term string")
    found = {r["term_id"]: (r["n_papers"], r["mark"]) for r in frequency.term_frequencies(papers(spark, rows), terms).collect()}
    assert found == {0: (0, "rare"), 1: (20, "common"), 2: (4, None), 3: (2, "rare"), 4: (0, "rare"), 5: (0, "rare"), 6: (20, "common")}


def test_grams_of_the_same_terms_share_their_df(spark):
    g = grams(spark, [(1, 5, 0), (2, 5, 0), (3, 6, 7), (4, None, 0), (5, None, 0)])
    idf = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 2, 1), (1, 1, 1), (9, 50, 0), (None, 3, 0), (4, None, 2)], "gram_id long, df long, run_id int")
    units = spark.range(10)
    found = {r["gram_id"]: (r["n"], r["mark"]) for r in frequency.gram_frequencies(g, idf, units).collect()}
    assert found == {1: (4, "common"), 2: (4, "common"), 3: (0, "rare"), 4: (0, "rare"), 5: (0, "rare")}


def test_empty_tables(spark):
    none = papers(spark, [])
    terms = spark.createDataFrame([], "term_id long, term string")
    idf = spark.createDataFrame([], "gram_id long, df long, run_id int")
    assert frequency.useless(none, terms, grams(spark, []), idf, spark.range(0)).count() == 0
    assert frequency.vocabulary(none, terms).count() == 0
