import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import names

from .tables import papers

FORMS = [("Katarzyna", "Kasia"), ("Robert", "Bob"), (None, "X"), ("Y", None)]


def authors(spark, *lists):
    return papers(spark, [{"paper_id": str(i), "authors": own} for i, own in enumerate(lists)])


def forms(spark, rows=FORMS):
    return spark.createDataFrame(rows, "given_name string, short_form string")


def linked(spark, typed, extra=()):
    """Names as (firstname, lastname) or as one string; plain names around them show which tokens are given names."""
    usual = [(g, f) for g in ("Katarzyna", "Robert", "Olga", "Ravi", "Mei", "Susanna") for f in ("Brenmolat", "Vosgitane", "Lurpakind", "Hemzodari", "Stidefoya", "Kelpunesor")]
    rows = [t if isinstance(t, tuple) else (None, t) for t in typed]
    found = names.linked_names(authors(spark, usual, rows, list(extra)), forms(spark)).collect()
    full = {(f"{a} {b}" if a is not None else b) for a, b in rows}
    return {tuple(r) for r in found if set(r) & full}


SAME = [
    [("Katarzyna A.", "Cletzapovi"), "Cletzapovi, Katarzyna A.", "Cletzapovi KA", ("K. A.", "Cletzapovi"), ("Kasia", "Cletzapovi"), ("katarzyna a.", "cletzapovi"), ("Katarzyna A.", "CLETZAPOVI"), ("Katarzyna A.", "Cletzapovi, PhD"), ("Prof. K. A.", "Cletzapovi"), ("Katarzyna", "Cletzpaovi"), ("Cletzapovi", "Katarzyna")],
    [("Robert", "van Erilbénikelt"), ("Bob", "van Erilbenikelt"), ("R.", "van Erilbenikelt"), ("Robert  ", "Erilbenikelt"), "van Erilbenikelt, R."],
    [("Olga", "Trefonasku-Wendibar"), ("Olga", "Trefonasku Wendibar"), ("O.", "Trefonasku-Wendibar"), ("Olga", "Trefonasku-Wendbar")],
    ["Dopelitite High Energy Observatory Collaboration", "Collaboration, Dopelitite High Energy Observatory", "The Dopelitite High Energy Observatory Collab.", "Dopelitite HEO Collaboration", "High Energy Observatory Collaboration (Dopelitite)", "Dopelitite Observatory Collaboration", "Dopelitite High-Energy Observatory Collaboration"],
]


@pytest.mark.parametrize("typed", SAME)
def test_variants_are_linked(spark, typed):
    full = sorted({f"{t[0]} {t[1]}" if isinstance(t, tuple) else t for t in typed})
    expected = {(a, b) for i, a in enumerate(full) for b in full[i + 1 :]}
    found = linked(spark, typed)
    assert found <= expected
    assert len(found) >= 0.9 * len(expected)


def test_others_are_not_linked(spark):
    typed = [("Olga F.", "Cletzapovi"), ("Ravi", "Cletzapovi"), ("Mei M.", "Dorganilev"), ("Mei K.", "Dorganilev"), "Gumemefuit Open Survey Consortium", "Haladerinn Open Survey Consortium", ("Susanna", "Marpakoris"), ("Susanna", "Lintodevar")]
    assert linked(spark, typed) == set()


def test_nulls_blanks_and_repeats(spark):
    lists = [None, [], [(None, None), (None, ""), (None, "  "), ("A", None)], [("Olga", "Cletzapovi")] * 3, [None, ("O.", "Cletzapovi")], [(None, "1234"), (None, "漢字"), (None, "Q" * 5000)]]
    assert {tuple(r) for r in names.linked_names(authors(spark, *lists), forms(spark)).collect()} == {("O. Cletzapovi", "Olga Cletzapovi")}
    found = {r["name"]: (r["entity"], r["n_links"]) for r in names.entities(authors(spark, *lists), forms(spark)).collect()}
    assert found["Olga Cletzapovi"] == ("O. Cletzapovi", 1) and found["漢字"] == ("漢字", 0)


def test_empty_tables(spark):
    assert names.linked_names(papers(spark, []), forms(spark, [])).count() == 0
    assert names.entities(papers(spark, []), forms(spark)).count() == 0


def test_common_suffixes_are_refined(spark, monkeypatch):
    """Far more names with one ending than a block may hold: the links stay, the blocks stay small."""
    monkeypatch.setattr(names, "COMMON", 8)
    letters = "abcdefghijklmnopqrst"
    stems = [f"{a}{v}{b}{w}r" for a in letters[:10] for v in "ae" for b in "mnlk" for w in "io"]
    own = [("Olga", s.title() + "ivanenko") for s in stems] + [("O.", s.title() + "ivanenko") for s in stems]
    found = {tuple(r) for r in names.linked_names(authors(spark, own), forms(spark)).collect()}
    expected = {tuple(sorted((f"O. {s.title()}ivanenko", f"Olga {s.title()}ivanenko"))) for s in stems}
    assert expected <= found


def test_short_forms_meet_in_a_crowd_of_one_family_name(spark):
    """More names of one family than a block may hold, in every letter: a short form still meets its formal name."""
    short = [("Robert", "Bob"), ("William", "Bill"), ("Margaret", "Peggy")]
    crowd = [(a + v + "gulno" + b, "Smith") for a in "BRWMP" for v in "aeiou" for b in "fkp"]
    own = [*crowd, *[(g, "Smith") for pair in short for g in pair], ("B.", "Smith"), ("R.", "Smith")]
    assert len(own) > names.COMMON
    found = {tuple(r) for r in names.linked_names(authors(spark, own), forms(spark, short)).collect()}
    assert {tuple(sorted((f"{a} Smith", f"{b} Smith"))) for a, b in [*short, ("R.", "Bob"), ("B.", "Bob"), ("R.", "Robert")]} <= found
    assert ("B. Smith", "Robert Smith") not in found


def test_a_proper_suffix_of_a_crowd_is_not_dropped(spark, monkeypatch):
    """Two misspellings share only a suffix that more names of the same initial and head have than a block may hold."""
    monkeypatch.setattr(names, "COMMON", 8)
    crowd = [("Olga", f"Kar{a}u{b}ivanenko") for a in "bdfgknp" for b in "tdp"]
    own = [*crowd, ("Olga", "Karmolivanenko"), ("O.", "Karmoivanenko")]
    found = {tuple(r) for r in names.linked_names(authors(spark, own), forms(spark)).collect()}
    assert ("O. Karmoivanenko", "Olga Karmolivanenko") in found


def test_short_family_names_and_short_tokens_meet(spark):
    typed = [("W.", "Li"), ("Wei", "Li"), ("Wei", "Lo"), ("Bo", "Y"), ("Bo", "Wu"), ("B.", "Wu")]
    found = {tuple(r) for r in names.linked_names(authors(spark, typed), forms(spark)).collect()}
    assert found == {("W. Li", "Wei Li"), ("B. Wu", "Bo Wu")}


def test_a_slip_in_the_head_of_a_crowded_family_name(spark, monkeypatch):
    monkeypatch.setattr(names, "COMMON", 8)
    crowd = [("Olga", f"Kar{a}u{b}ivanenko") for a in "bdfgknp" for b in "tdp"]
    slips = [f"{x}molivanenko" for x in ("Dro", "Do", "Dro", "Rdo", "Dio")]
    found = {tuple(r) for r in names.linked_names(authors(spark, crowd, [("Olga", x) for x in slips]), forms(spark)).collect()}
    full = sorted({f"Olga {x}" for x in slips})
    assert {(a, b) for i, a in enumerate(full) for b in full[i + 1 :] if "Dromolivanenko" in a + b} <= found


def test_a_crowd_of_one_family_name_with_a_hub(spark):
    """Five hundred given names of one family name and an initial that fits a share of them: all pairs with the hub, in tiles."""
    given = [f"{a}{v}{b}{w}{c}" for a in "OAE" for v in "aeiou" for b in "lmnr" for w in "ai" for c in "kstd"][:480]
    own = [(g.title(), "Cletzapovi") for g in given] + [("O.", "Cletzapovi"), ("O.", "Celtzapovi")]
    found = {tuple(r) for r in names.linked_names(authors(spark, own, [(g.title(), "Brenmolat") for g in given] * 1), forms(spark)).collect()}
    hub = {tuple(sorted(("O. Cletzapovi", f"{g.title()} Cletzapovi"))) for g in given if g[0] == "O"}
    assert hub <= found and ("O. Celtzapovi", "O. Cletzapovi") in found
    assert not any("O. Clet" in a + b and " Cletzapovi" in a + b and not {a[0], b[0]} == {"O"} for a, b in found)


def test_generic_words_are_told_by_their_company(spark):
    """No list has these words: beside many proper words they tell no organisation from another."""
    proper = ["Wegegifayl", "Kokegowoine", "Dilalabuite", "Nupigaheyl", "Lolididiase"]
    typed = [(None, f"{p} Plovdor Hebrat") for p in proper] + [(None, f"Plovdor Hebrat {p}") for p in proper] + [(None, "Wgeegifayl Plovdor Hebrat")]
    people = [(g, f) for g in ("Olga", "Ravi") for f in ("Brenmolat", "Vosgitane")]
    found = {tuple(r) for r in names.linked_names(authors(spark, typed, people), forms(spark)).collect()}
    same = {tuple(sorted((f"{p} Plovdor Hebrat", f"Plovdor Hebrat {p}"))) for p in proper}
    assert found == same | {tuple(sorted(("Wgeegifayl Plovdor Hebrat", x))) for x in ("Wegegifayl Plovdor Hebrat", "Plovdor Hebrat Wegegifayl")}


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert names.common_subsequence(a, b) == table[-1][-1]
