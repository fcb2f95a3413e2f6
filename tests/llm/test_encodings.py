import random

import pytest

from lexforge.llm import encodings

from .tables import documents

STOCK = {
    "en": "the score of each policy was measured before signal error reward with under linear field we show that and its result differs strongly from model".split(),
    "de": "größe für über prüfung die wärme fläche während nähe störung außerdem schätzung lösung können träger müssen und der mit wird übergang gemäß".split(),
    "fr": "équation à été modèle après réseau système énergie très où déjà même phénomène par les une géométrie théorie opération fréquence".split(),
    "ru": "сигнал и вектор что плотность на спектр который модель для частота также более решение при между погрешность после анализ".split(),
    "el": "και σφάλμα η ενέργεια με συχνότητα που μοντέλο δεν είναι από πυκνότητα για διάνυσμα όπως φάσμα μέτρηση μεταξύ".split(),
}


def text(rng, lang, n=30):
    words = rng.choices(STOCK[lang], k=n)
    return " ".join(words).capitalize() + rng.choice([".", " (5 Å).", " – 12 °C."])


@pytest.fixture(scope="module")
def judge():
    rng = random.Random(1)
    return encodings.clean_judge({lang: [text(rng, lang, rng.randint(8, 60)) for _ in range(120)] for lang in STOCK})


def garble(t, written, read):
    return "".join(encodings._SINGLE[read][1][b] for b in t.encode(written))


CHAINS = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("iso8859-7", "latin-1"), ("cp1252", "cp437"), ("cp1252", "cp1251")]


@pytest.mark.parametrize("written, read", CHAINS)
def test_round_trip(judge, written, read):
    rng = random.Random(2)
    lang = {"cp1251": "ru", "koi8-r": "ru", "cp866": "ru", "iso8859-7": "el", "cp1252": "fr"}.get(written, "de")
    found = restored = 0
    for _ in range(20):
        good = text(rng, lang).replace("Å", "x").replace("–", "-").replace("°", "x")
        bad = garble(good, written, read)
        now, chain = judge.restored(bad)
        found += bool(chain)
        restored += now == good
    assert found >= 19 and restored >= 17


def test_twice_and_in_part(judge):
    rng = random.Random(3)
    good = text(rng, "fr")
    assert judge.restored(garble(garble(good, "utf-8", "cp1252"), "utf-8", "cp1252"))[0] == good
    part = text(rng, "en") + " " + garble("“results”", "utf-8", "cp1252") + " " + text(rng, "en")
    assert "“results”" in judge.restored(part)[0]


def test_clean_texts_stay(judge):
    rng = random.Random(4)
    for lang in STOCK:
        for _ in range(40):
            t = text(rng, lang)
            assert judge.restored(t) == (t, [])
    for t in ("If Â†Â = 1 the score differs (7 Å).", "FUNÇÃO SÃO É", "‘Âme’ and ‘São’", "├── corpus\n└── index", "αβγ→∂²ψ/∂t²", "漢字 العربية 👩‍🔬", "x" * 100000 + " é"):
        assert judge.restored(t) == (t, [])


def test_table(spark):
    rng = random.Random(5)
    rows = [{"doc_id": i, "text": text(rng, lang), "lang": lang} for i, lang in enumerate(sorted(STOCK) * 40)]
    bad = {500: garble(text(rng, "de"), "utf-8", "latin-1"), 501: "gr��e", 502: garble(text(rng, "ru"), "cp1251", "latin-1")}
    rows += [{"doc_id": i, "text": t, "lang": None} for i, t in bad.items()]
    rows += [{"doc_id": 600, "text": None}, {"doc_id": 601, "text": ""}, {"doc_id": 602, "text": "  "}, {"doc_id": 500, "text": bad[500]}, {"doc_id": None, "text": "ok"}]
    made = encodings.repaired(documents(spark, rows)).collect()
    assert len(made) == len(rows)
    assert {r["doc_id"] for r in made if r["garbled"]} == set(bad)
    assert {r["doc_id"]: r["restored"] for r in made}[501] == "gr��e"
    assert {r["doc_id"]: r["restored"] for r in made}[600] is None


def test_empty_and_unlabelled_tables(spark):
    assert encodings.repaired(documents(spark, [])).count() == 0
    assert [r["garbled"] for r in encodings.repaired(documents(spark, [{"doc_id": 1, "text": "grÃ¶ÃŸe"}])).collect()] == [True]


def test_a_whole_chain_is_judged(judge, monkeypatch):
    """A first step that gains nothing by itself is followed."""
    rng = random.Random(7)
    good = text(rng, "de")
    bad = garble(garble(good, "utf-8", "cp1252"), "utf-8", "cp1252")
    once, gain = garble(good, "utf-8", "cp1252"), encodings.Judge._gain
    monkeypatch.setattr(encodings.Judge, "_gain", lambda self, was, now: -5 if now == once else gain(self, was, now))
    now, chain = judge.restored(bad)
    assert now == good and len(chain) == 2


def test_a_judge_that_was_sent_says_the_same(judge):
    import pickle

    sent = pickle.loads(pickle.dumps(judge))
    rng = random.Random(8)
    for lang in STOCK:
        bad = garble(text(rng, lang).replace("–", "-").replace("Å", "x"), "utf-8", "latin-1")
        assert not sent.samples and sent.restored(bad) == judge.restored(bad)


def test_reasons(spark):
    rng = random.Random(5)
    rows = [{"doc_id": i, "text": text(rng, lang), "lang": lang} for i, lang in enumerate(sorted(STOCK) * 40)]
    part = garble(text(rng, "de"), "utf-8", "latin-1")
    rows += [{"doc_id": 500, "text": part}, {"doc_id": 501, "text": "gr��e"}, {"doc_id": 502, "text": part + " gr��e"}]
    made = {r["doc_id"]: r for r in encodings.repaired(documents(spark, rows)).collect()}
    assert [made[i]["reason"] for i in (0, 500, 501, 502)] == [None, "chain and loss" if "\x9f" in part or "\x84" in part else "chain", "loss", "chain and loss"]
    assert "Ã" not in made[502]["restored"] and "��" in made[502]["restored"]


def test_every_labelled_text_is_learnt_from(spark, monkeypatch):
    """More texts than a sample had, a long and a short one, and damaged ones that are left out."""
    rng = random.Random(11)
    rows = [{"doc_id": i, "text": text(rng, lang, rng.randint(3, 12)), "lang": lang} for i, lang in enumerate(["de", "ru"] * 700)]
    rows += [{"doc_id": 2000 + i, "text": t, "lang": "de"} for i, t in enumerate(["žluť"] * 40 + ["wort " * 2000 + "ąę"] * 40)]
    rows += [{"doc_id": 3000 + i, "text": garble(text(rng, "ru").replace("Å", "x"), "cp1251", "latin-1"), "lang": "ru"} for i in range(20)]
    rows += [{"doc_id": 4000, "text": None, "lang": "de"}, {"doc_id": 4001, "text": "öß", "lang": None}]
    monkeypatch.setattr(encodings, "HELD", 50)
    made = encodings.learnt(documents(spark, rows))
    plain = encodings.clean_judge({lang: [r["text"] for r in rows if r["lang"] == lang and r["text"]] for lang in ("de", "ru")})
    assert (made.pairs, made.alphabet, made.contents) == (plain.pairs, plain.alphabet, plain.contents)
    assert {"ž", "ť", "ą"} <= made.alphabet and "ñ" not in made.alphabet
