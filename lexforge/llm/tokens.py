"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary file is turned directly into a sentencepiece BPE model: every piece keeps its id,
its bytes are mapped to one character each, its score is the negative rank, and normalisation is
the identity. Texts are cut into pre-tokens first, as the merges never cross them.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARIES = os.environ.get("LEXFORGE_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokens kept with their ids by each worker; a full memo is emptied.
MEMO = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints in Latin-1, else from U+0100 on."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(itself) else chr(next(moved)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file in the order of their ids."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = sorted((int(rank), base64.b64decode(piece)) for piece, rank in pairs)
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError(f"{path}: the ranks have gaps")
    return [piece for _, piece in ranks]


def sentencepiece_model(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the positions in ``pieces``.

    One piece more, of a form no mapped text can have, stands for the unknown; it never occurs, as
    all 256 bytes are pieces.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    if {bytes([b]) for b in range(256)} - set(pieces):
        raise ValueError("a byte has no piece")
    mapped = byte_characters()
    model = pb.ModelProto()
    for rank, piece in enumerate(pieces):
        model.pieces.add(piece="".join(mapped[b] for b in piece), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece=" unknown ", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t, n = model.trainer_spec, model.normalizer_spec
    t.model_type, t.vocab_size, t.unk_piece = pb.TrainerSpec.BPE, len(model.pieces), " unknown "
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = len(pieces), -1, -1, -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Encoder:
    """Ids of texts and texts of ids by the rank file at ``path``."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.pieces = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.pieces))
        self.words = regex.compile(PATTERN).findall
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.memo: dict[str, np.ndarray] = {}

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, int32. Null and empty texts have none."""
        words = [self.words(x) if x else [] for x in texts]
        fresh = list({w for ws in words for w in ws if w not in self.memo})
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = list({w for ws in words for w in ws})
        known = self.memo
        mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for w in fresh]
        for w, ids in zip(fresh, self.model.encode(mapped, num_threads=1)):
            known[w] = np.array(ids, np.int32)
        none = np.empty(0, np.int32)
        return [np.concatenate([known[w] for w in ws]) if ws else none for ws in words]

    def decode(self, ids) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def rank_file(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or VOCABULARIES, f"{name}.tiktoken")


def _slices(texts: list[str | None], characters: int = 1 << 20) -> Iterator[slice]:
    """Runs of texts with about so many characters, so that a batch of long texts stays small."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= characters:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _slices(texts):
                ids = own.encode_all(texts[part])
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), lists], ["doc_id", "ids"])

    return run


def token_ids(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``documents``: the token ids of its whole ``text``.

    No special tokens are added and strings that look like them are plain text. Null and empty
    texts give an empty list; blank texts are encoded as they are. Rows are never merged, so
    repeated rows come out repeated. Only ``doc_id`` and ``text`` are read. No shuffle.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_ids(rank_file(name, folder)), "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row, as :func:`token_ids` but with the lengths only."""
    path = rank_file(name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts = [len(x) for part in _slices(texts) for x in own.encode_all(texts[part])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    kept = [c for c in documents.columns if c != "text"]
    rows = documents.select(*kept, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, n_tokens long")


def decoded(ids: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, text) of rows of :func:`token_ids`, by the inverse mapping of every id."""
    path = rank_file(name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(x) if x is not None else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
