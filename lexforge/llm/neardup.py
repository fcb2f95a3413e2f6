"""Near-duplicate papers: pairs whose word triples overlap by half or more.

Anchor-point covering. The fingerprint of a text is a word of ``M`` symbols of a prime field, each
the minimum of its triples under another hash, so two texts differ in about (1 - similarity) * M
symbols. The anchors are the codewords of the Reed-Solomon code of dimension ``K`` over that field,
whose covering radius is M - K: any K symbols lie on one codeword. A fingerprint is sent to every
anchor within that radius, so fingerprints at a distance up to M - K always meet at an anchor. What
meets at an anchor is compared there by a 192-bit sketch; only the pairs that pass are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, by_shuffle, cut, hashed_sample
from .links import components
from .papers import words_of

#: Length and dimension of the code; with 12 and 3 a pair of similarity 0.5 meets with probability 0.981, of 0.6 with 0.997.
M, K = 12, 3
PRIME = (1 << 31) - 1
BINS = 64
#: Bins of the sketch that may differ: at a similarity of one half 28 do, with a deviation of 4.
MOST_DIFFERENT = 43
#: Fingerprints that are compared with each other at one anchor in one piece; those of a fuller anchor are spread over tiles of about this size.
CROWD = 2048
#: Fingerprints whose anchors are counted at the driver to know those that an anchor of at least PROBE_HITS of them would flood.
PROBE, PROBE_HITS = 4000, 20
#: Copies of a content that one tile of the pairs of papers holds.
COPIES = 1024
#: Pairs compared at once in memory.
_AT_ONCE = 1 << 21
#: Ids above this number aren't broadcast.
BROADCAST_IDS = 1_000_000

_SKETCH = "struct<s0:long,s1:long,s2:long>"
_U = np.uint64


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


_FACTORS = _odd(M, 11)
_PLACES = _odd(4, 12)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _PLACES[3]
    return x ^ (x >> _U(29))


class Triples:
    """Hashes of the sets of all three successive words of texts."""

    def __init__(self, memo: int = 400_000):
        self.memo: dict[str, int] = {}
        self.most = memo

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted 64-bit hashes without repeats; empty for null and for fewer than three words."""
        words = words_of(text or "")
        if len(words) < 3:
            return np.empty(0, np.uint64)
        if len(self.memo) > self.most:
            self.memo.clear()
        known, out = self.memo, []
        for w in words:
            if (h := known.get(w)) is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        h = np.array(out, np.uint64)
        return np.unique(_mixed(h[:-2] * _PLACES[0] + h[1:-1] * _PLACES[1] + h[2:] * _PLACES[2]))


def _symbols(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of non-empty sets, (len(sets), M)."""
    joined, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    minima = [np.minimum.reduceat(_mixed(joined * f), starts) for f in _FACTORS]
    return np.stack([m % _U(PRIME) for m in minima], axis=1)


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Three bits of the least hash of each of 64 bins, as three words of 64 bits, (len(sets), 3)."""
    joined, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # a set is sorted, so the first hash of a bin is its least
    cell = owner * BINS + (joined >> _U(58)).astype(np.int64)
    cells, first = np.unique(cell, return_index=True)
    bits = _mixed(joined[first])
    out = np.zeros((len(sets), 3), np.uint64)
    for i in range(3):
        np.bitwise_or.at(out[:, i], cells // BINS, ((bits >> _U(i)) & _U(1)) << (cells % BINS).astype(np.uint64))
    return out


def _words(sketches: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(3)], ["s0", "s1", "s2"])


def _matrix(sketches: pa.StructArray) -> np.ndarray:
    return np.stack([x.to_numpy() for x in sketches.flatten()], axis=1)


def _text(batch: pa.RecordBatch, i: int) -> list[str]:
    return [f"{t or ''} {b or ''}" for t, b in zip(batch.column(i).to_pylist(), batch.column(i + 1).to_pylist())]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    triples = Triples()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sets = [triples(t) for t in _text(part, 1)]
            some = [s for s in sets if len(s)]
            kept = np.array([bool(len(s)) for s in sets])
            symbols, sketches, keys = np.zeros((len(sets), M), np.int32), np.zeros((len(sets), 3), np.int64), [None] * len(sets)
            if some:
                symbols[kept], sketches[kept] = _symbols(some).astype(np.int32), _sketches(some).view(np.int64)
                for i in np.flatnonzero(kept):
                    keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * M), pa.array(symbols.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), lists, _words(sketches)], ["paper_id", "content", "symbols", "sketch"])


def _solutions() -> tuple[np.ndarray, np.ndarray]:
    """The K-subsets of positions, and for each the matrix that gives the polynomial through its symbols."""
    subsets = list(combinations(range(M), K))
    out = np.zeros((len(subsets), K, K), np.uint64)
    for s, subset in enumerate(subsets):
        for j, at in enumerate(subset):
            basis, below = [1], 1
            for other in subset:
                if other != at:
                    basis = [(a - b * (other + 1)) % PRIME for a, b in zip([0, *basis], [*basis, 0])]
                    below = below * (at - other) % PRIME
            inverse = pow(below, -1, PRIME)
            out[s, :, j] = [c * inverse % PRIME for c in basis]
    return np.array(subsets), out


_SUBSETS, _MATRICES = _solutions()


def anchors_of(symbols: np.ndarray) -> np.ndarray:
    """48-bit names of all anchors within the covering radius of each fingerprint, (n, number of subsets)."""
    y = symbols.astype(np.uint64)[:, _SUBSETS]  # n, subsets, K
    name = np.zeros(y.shape[:2], np.uint64)
    for row in range(K):
        # three products below 2**62 stay below 2**64
        coefficient = sum(y[:, :, j] * _MATRICES[None, :, row, j] for j in range(K)) % _U(PRIME)
        name = _mixed(name * _PLACES[0] + coefficient)
    return name >> _U(16)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id, sketch): every fingerprint at all its anchors."""
    for batch in batches:
        ids, sketches = batch.column(0).to_numpy(), _matrix(batch.column(2))
        symbols = batch.column(1).flatten().to_numpy().reshape(-1, M)
        for start in range(0, len(ids), 512):
            part = slice(start, start + 512)
            names = anchors_of(symbols[part]).astype(np.int64)
            own, sketch = (np.repeat(x[part], names.shape[1], axis=0) for x in (ids, sketches))
            yield pa.RecordBatch.from_arrays([pa.array(names.ravel()), pa.array(own), _words(sketch)], ["anchor", "id", "sketch"])


def _close(ids: np.ndarray, sketches: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The pairs of rows whose sketches differ little, as pairs of ids, the smaller first, (n, 2)."""
    x, y = sketches.view(np.uint64)[left], sketches.view(np.uint64)[right]
    near = np.bitwise_count(np.bitwise_or.reduce(x ^ y, axis=1)) <= MOST_DIFFERENT
    pairs = np.stack([ids[left[near]], ids[right[near]]], axis=1)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    pairs.sort(axis=1)
    return pairs


def _within(ids: np.ndarray, sketches: np.ndarray, starts: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Close pairs of each of the runs of one length that begin at ``starts``."""
    i, j = np.triu_indices(length, 1)
    step = max(1, _AT_ONCE // len(i))
    for k in range(0, len(starts), step):
        base = starts[k : k + step, None]
        yield _close(ids, sketches, (base + i).ravel(), (base + j).ravel())


def _compared(crowd: int):
    """Fingerprints in the order of their anchors, compared with those at the same anchor.

    Rows (a, b) are close pairs. The fingerprints of an anchor with more than ``crowd`` come out
    again as rows (anchor, id, sketch), uncompared; no more than that many are ever held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: list[np.ndarray], left: list[tuple]) -> pa.RecordBatch:
            own = np.unique(np.concatenate([np.empty((0, 2), np.int64), *pairs]), axis=0)
            anchor, ids, sketch = (np.concatenate([e, *x]) for e, x in zip(empty, zip(*left) if left else [[]] * 3))
            none, words = (pa.nulls(len(own), pa.int64()), pa.nulls(len(ids), pa.int64())), _words(sketch)
            columns = [(pa.array(own[:, 0]), none[1]), (pa.array(own[:, 1]), none[1]), (none[0], pa.array(anchor)), (none[0], pa.array(ids)), (pa.nulls(len(own), words.type), words)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["a", "b", "anchor", "id", "sketch"])

        empty = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 3), np.int64)]
        held = empty
        crowded: int | None = None  # the anchor whose fingerprints are being passed on
        for batch in _one_more(batches):
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))] if batch is not None else empty
            rows = [np.concatenate(x) for x in zip(held, new)]
            anchor, ids, sketch = rows
            starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.empty(0, np.int64)
            ends = np.append(starts[1:], len(anchor)).astype(np.int64)
            pairs, left = [], []
            if batch is not None and len(starts):  # the last run may go on
                last = slice(starts[-1], None)
                if ends[-1] - starts[-1] > crowd or anchor[-1] == crowded:
                    crowded = int(anchor[-1])
                    held = empty
                else:
                    held = [x[last] for x in rows]
                    starts, ends = starts[:-1], ends[:-1]
            lengths = ends - starts
            passed = (lengths > crowd) | (anchor[starts] == crowded if crowded is not None else False)
            for s, e in zip(starts[passed], ends[passed]):
                left.append((anchor[s:e], ids[s:e], sketch[s:e]))
            for length in np.unique(lengths[~passed & (lengths > 1)]):
                pairs += _within(ids, sketch, starts[~passed & (lengths == length)], int(length))
            if pairs or left:
                yield out(pairs, left)

    return run


def _one_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _compared_tiles(table: pa.Table) -> pa.Table:
    """Close pairs of one tile with another, or within one."""
    ids, own, sketches = table["id"].to_numpy(), table["own"].to_numpy(), _matrix(table["sketch"].combine_chunks())
    lo, hi = (table[c][0].as_py() for c in ("lo", "hi"))
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    pairs = [np.empty((0, 2), np.int64)]
    step = max(1, _AT_ONCE // max(1, len(right)))
    for k in range(0, len(left), step):
        some = left[k : k + step]
        pairs.append(_close(ids, sketches, np.repeat(some, len(right)), np.tile(right, len(some))))
    found = np.unique(np.concatenate(pairs), axis=0)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    triples = Triples()
    for batch in batches:
        sets = [triples(t) for t in _text(batch, 1)]
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], ["id", "triples"])


def fingerprints(papers: DataFrame) -> DataFrame:
    """(paper_id, content, symbols, sketch), a row per paper, that of its first harvest.

    ``content`` names the set of triples; it is null below three words. Copies of a paper are merged
    after the texts have been reduced to fingerprints, so no text is shuffled.
    """
    rows = papers.where(F.col("paper_id").isNotNull())
    tagged = rows.select(F.struct("paper_id", F.col("harvested_at").alias("at")).alias("key"), F.col("title").cast("string").alias("title"), F.col("body").cast("string").alias("body"))
    kind = tagged.schema["key"].dataType.simpleString()
    made = tagged.mapInArrow(_fingerprints, f"paper_id {kind}, content binary, symbols array<int>, sketch {_SKETCH}")
    value = F.struct("content", "symbols", "sketch")
    first = made.groupBy("paper_id.paper_id").agg(F.min_by(value, F.struct(F.coalesce("paper_id.at", F.lit("9999-12-31").cast("timestamp_ntz")).cast("timestamp_ntz"), "content")).alias("v"))
    return first.select("paper_id", "v.*")


def _flooded(classes: DataFrame, total: int) -> list[int]:
    """Anchors that so many fingerprints of a bounded probe have that one task shouldn't even read them all."""
    probe = hashed_sample(classes.select("id", "symbols"), total, PROBE, "id")
    if not probe:
        return []
    names, times = np.unique(anchors_of(np.array([r["symbols"] for r in probe])), return_counts=True)
    return [int(x) for x in names[(times >= PROBE_HITS) & (times / len(probe) * total > CROWD)]]


def close_pairs(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: the ids of all fingerprints that meet at an anchor and have close sketches, each pair once.

    Every fingerprint goes to all its anchors and is compared there. An anchor that holds more than
    ``CROWD`` is taken apart into tiles by the number it holds, and tiles are compared with each
    other by tasks of their own, so no pair is left out and no task gets a whole crowd.
    """
    spark = classes.sparkSession
    met = classes.select("id", "symbols", "sketch").mapInArrow(_anchor_rows, f"anchor long, id long, sketch {_SKETCH}")
    flooded = _flooded(classes, classes.count())
    rest, crowds = met, []
    if flooded:  # at most PROBE * anchors / PROBE_HITS
        known = F.broadcast(spark.createDataFrame([(x,) for x in flooded], "anchor long"))
        rest, crowds = met.join(known, "anchor", "left_anti"), [met.join(known, "anchor", "left_semi")]
    found = cut(rest.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compared(CROWD), f"a long, b long, anchor long, id long, sketch {_SKETCH}"))
    pairs = found.where(F.col("a").isNotNull()).select("a", "b")
    passed = found.where(F.col("id").isNotNull()).select("anchor", "id", "sketch")
    if not passed.isEmpty():
        crowds.append(passed)
    for crowd in crowds:
        sizes = crowd.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("tiles"))
        own = crowd.join(broadcast_if_small(sizes), "anchor").withColumn("own", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
        tiled = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.select("anchor", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "sketch")
        pairs = pairs.unionByName(tiled.groupBy("anchor", "lo", "hi").applyInArrow(_compared_tiles, "a long, b long"))
    return pairs.distinct()


def content_links(papers: DataFrame, similarity: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Papers with the class of their content, and the links between classes.

    members: (paper_id, first), where ``first`` is the least paper_id with the same set of triples;
    papers below three words stand in classes of their own. links: (a, b, similarity), a < b, both of
    them first papers of their classes, for every found pair whose exact Jaccard similarity of
    triples is at least ``similarity``.
    """
    own = cut(fingerprints(papers))
    classes = own.where(F.col("content").isNotNull()).groupBy("content").agg(F.min("paper_id").alias("first"), F.min_by(F.struct("symbols", "sketch"), "paper_id").alias("v"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "content", "first", "v.*"))
    members = own.join(by_shuffle(classes.select("content", "first")), "content", "left").select("paper_id", F.coalesce("first", "paper_id").alias("first"), F.col("content").isNotNull().alias("comparable"))

    close = cut(close_pairs(classes))
    needed = cut(close.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(by_shuffle(classes.select("id", "first")), "id"))
    texts = papers.select("paper_id", F.col("title").cast("string").alias("title"), F.col("body").cast("string").alias("body"), "harvested_at")
    names = needed.select(F.col("first").alias("paper_id"), "id")
    wanted = texts.join(F.broadcast(names) if needed.count() <= BROADCAST_IDS else by_shuffle(names), "paper_id").select("id", "title", "body")
    sets = cut(wanted.mapInArrow(_sets_of, "id long, triples array<long>").groupBy("id").agg(F.first("triples").alias("triples")))
    x, y = (by_shuffle(sets.select(F.col("id").alias(i), F.col("triples").alias(t))) for i, t in (("a", "ta"), ("b", "tb")))
    common = F.size(F.array_intersect("ta", "tb"))
    measured = close.join(x, "a").join(y, "b").select("a", "b", (common / (F.size("ta") + F.size("tb") - common)).alias("similarity")).where(F.col("similarity") >= similarity)
    x, y = (by_shuffle(needed.select(F.col("id").alias(i), F.col("first").alias(f))) for i, f in (("a", "fa"), ("b", "fb")))
    named = measured.join(x, "a").join(y, "b")
    return members, named.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"), "similarity")


def near_pairs(papers: DataFrame, similarity: float = 0.5) -> DataFrame:
    """(paper_id_1, paper_id_2), smaller id first: every pair of papers that are linked.

    Papers with the same set of triples are one content; they are paired with each other and with
    every paper of a linked content, at any number of copies. The copies of a content are spread
    over tiles of about ``COPIES``, so the pairs of a crowd are made by as many tasks as it takes;
    their number is that of the cases, by definition the square of a crowd. ``groups`` gives the
    same classes in a row per paper. Null and short texts are in no pair, an empty table gives none.
    """
    members, links = content_links(papers, similarity)
    members = cut(members.where("comparable").select("paper_id", "first"))
    sizes = members.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    tiles = cut(sizes.select(F.col("first").alias("b"), "n", F.ceil(F.col("n") / COPIES).cast("int").alias("tiles")))
    q = members.withColumnRenamed("first", "b").join(by_shuffle(tiles), "b").select("b", F.col("paper_id").alias("q"), F.pmod(F.xxhash64("paper_id"), "tiles").cast("int").alias("tile"))
    same = members.select(F.col("first").alias("b"), F.col("paper_id").alias("p"), F.lit(True).alias("same"))
    other = links.select("a", "b").join(by_shuffle(members.withColumnRenamed("first", "a")), "a").select("b", F.col("paper_id").alias("p"), F.lit(False).alias("same"))
    p = same.join(by_shuffle(tiles.where("n > 1")), "b").unionByName(other.join(by_shuffle(tiles), "b"))
    p = p.select("b", "p", "same", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    pairs = p.join(by_shuffle(q), ["b", "tile"]).where("not same or p < q")
    return pairs.select(F.least("p", "q").alias("paper_id_1"), F.greatest("p", "q").alias("paper_id_2"))


def groups(papers: DataFrame, similarity: float = 0.5) -> DataFrame:
    """(paper_id, group_id, n_links), a row per paper: the least paper_id it is linked to over any number of links.

    ``n_links`` counts the other contents linked to the paper's content; copies are no links. A
    paper without any stands alone in a group.
    """
    members, links = content_links(papers, similarity)
    links = cut(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(links).select(F.col("a").alias("first"), F.col("b").alias("root"))
    joined = members.join(by_shuffle(degree), "first", "left").join(by_shuffle(roots), "first", "left")
    return joined.select("paper_id", F.coalesce("root", "first").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
