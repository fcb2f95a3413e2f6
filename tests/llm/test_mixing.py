import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import mixing
from lexforge.llm.tokens import Encoder, rank_file

from .tables import documents


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeat int")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 1000)), min_size=1, max_size=8), st.integers(0, 5000))
def test_water_fill(sources, total):
    weights = {str(i): w for i, (w, _) in enumerate(sources)}
    caps = {str(i): c for i, (_, c) in enumerate(sources)}
    out = mixing.water_fill(weights, caps, total)
    assert all(-1e-9 <= out[s] <= caps[s] + 1e-6 for s in out)
    most = max(weights.values()) or 1.0  # tiny weights would overflow the ratios below
    weights = {s: w / most if w / most >= 1e-12 else 0.0 for s, w in weights.items()}
    reachable = sum(caps[s] for s in caps if weights[s] > 0)
    assert sum(out.values()) == pytest.approx(min(total, reachable), abs=1e-6)
    below = [out[s] / weights[s] for s in out if weights[s] > 0 and 0 < out[s] < caps[s] - 1e-6]
    assert not below or max(below) - min(below) <= 1e-6 * max(below)


def test_selection_reaches_the_shares(spark):
    rows = [{"doc_id": i, "text": f"word{i} and more text " * (1 + i % 7), "source": ["Big_One", "big-one ", "small", "other", None][i % 5]} for i in range(1000)]
    rows += [{"doc_id": 2000, "text": None, "source": "small"}, {"doc_id": 2001, "text": "", "source": "small"}]
    wanted = targets(spark, [("big_one", 0.5, 1), ("SMALL", 0.4, 3), ("missing", 0.1, 2), (None, 0.1, 1)])
    selection, shares = mixing.mixed(documents(spark, rows), wanted)
    own = Encoder(rank_file("byte_bpe_50k"))
    chosen = selection.collect()
    assert {r["source"] for r in chosen} == {"big_one", "small"}
    assert len({r["doc_id"] for r in chosen}) == len(chosen)
    assert all(r["n_tokens"] == len(own.encode_all([rows[r["doc_id"]]["text"]])[0]) for r in chosen)
    report = {r["source"]: r for r in shares.collect()}
    assert set(report) == {"big_one", "small", "missing"}
    assert report["missing"]["actual_tokens"] == 0
    for s, cap in (("big_one", 1), ("small", 3)):
        assert max(r["repeats"] for r in chosen if r["source"] == s) <= cap
        assert report[s]["actual_tokens"] == sum(r["n_tokens"] * r["repeats"] for r in chosen if r["source"] == s)
        assert report[s]["actual_share"] == pytest.approx(report[s]["target_share"], abs=0.005)
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, mixing.mixed(documents(spark, rows), wanted)[0].collect()))


def test_total_can_be_given(spark):
    rows = [{"doc_id": i, "text": "one two three four", "source": "s"} for i in range(300)]
    selection, shares = mixing.mixed(documents(spark, rows), targets(spark, [("s", 1.0, 5)]), total=2000)
    assert shares.first()["actual_tokens"] == pytest.approx(2000, abs=4)
    assert {r["repeats"] for r in selection.collect()} <= {1, 2}


def test_empty_tables(spark):
    selection, shares = mixing.mixed(documents(spark, []), targets(spark, [("s", 1.0, 2)]))
    assert selection.count() == 0 and shares.first()["actual_share"] == 0
    selection, shares = mixing.mixed(documents(spark, [{"doc_id": 1, "text": "x", "source": "s"}]), targets(spark, []))
    assert selection.count() == 0 and shares.count() == 0
