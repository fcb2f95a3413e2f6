import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import tokens

from .tables import documents


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokens.rank_file("byte_bpe_50k").replace(".tiktoken", ".json"))
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


CASES = ["", " ", "\n\n  \t", "<|endoftext|> and <unk>", " unknown ", "don't we'll I'M", "a" * 3000, " " * 2000 + "x", "Größe – 12 °C", "漢字 العربية 👩‍🔬", "�​", "x\x00y", "1234567 ½ ²"]


def test_equals_another_library(reference):
    own = tokens.Encoder(tokens.rank_file("byte_bpe_50k"))
    rng = random.Random(1)
    texts = CASES + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(60))) for _ in range(300)]
    for text, ids in zip(texts, own.encode_all(texts)):
        assert list(ids) == reference(text)
        assert own.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    own = tokens.encoder(tokens.rank_file("byte_bpe_multi_50k"))
    assert own.decode(own.encode_all([text])[0]) == text


def test_table(spark, reference):
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(CASES)] + [{"doc_id": 90, "text": None}, {"doc_id": 0, "text": "twice"}, {"doc_id": None, "text": "no id"}, {"doc_id": 91, "text": "word " * 60000}]
    table = documents(spark, rows)
    found = {(r["doc_id"], tuple(r["ids"])) for r in tokens.token_ids(table).collect()}
    assert found == {(r["doc_id"], tuple(reference(r["text"]) if r["text"] else ())) for r in rows}
    assert {(r["doc_id"], r["text"]) for r in tokens.decoded(tokens.token_ids(table)).collect()} == {(r["doc_id"], r["text"] or "") for r in rows}
    assert tokens.token_ids(documents(spark, [])).count() == 0


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    own = tokens.Encoder(tokens.rank_file("byte_bpe_50k"))
    for i in range(20):
        own.encode_all([" ".join(f"w{i}x{k}" for k in range(10))])
    assert len(own.memo) <= 70


def test_gap_in_the_ranks(tmp_path):
    (tmp_path / "bad.tiktoken").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        tokens.read_ranks(str(tmp_path / "bad.tiktoken"))
