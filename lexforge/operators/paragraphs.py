"""Paragraph vectors trained on samples of two words and the next one, with a sampled softmax."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import vector_sums
from ..session import by_shuffle, cut

#: Numbers a net may have; it is held whole by every task. Larger vocabularies are refused.
MOST_WEIGHTS = 20_000_000
#: Negatives of a batch, and samples of one.
NEGATIVES, BATCH = 15, 128
#: Intervals by which draws of negatives are joined.
INTERVALS = 1 << 14


def negatives(examples: DataFrame, shares: DataFrame, keys: list[str], n: int = NEGATIVES, seed: int = 1) -> DataFrame:
    """(*keys, i, token_id): ``n`` draws for every row of ``examples`` by the shares (token_id, q) of the vocabulary.

    Each draw is a number below 1 taken from a hash of the keys, so reruns agree, and falls on the
    term whose part of the cumulated shares holds it. The unit interval is cut into ``INTERVALS``
    and draws are joined by interval, so no task holds the vocabulary; a term that spans many
    intervals has a row in each.
    """
    from pyspark.sql import Window

    coarse = shares.withColumn("_b", F.pmod(F.xxhash64("token_id"), F.lit(4096)))
    parts = coarse.groupBy("_b").agg(F.sum("q").alias("s"))  # 4096 rows at most
    offset = parts.select("_b", (F.sum("s").over(Window.orderBy("_b")) - F.col("s")).alias("_from"), F.sum("s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    inside = Window.partitionBy("_b").orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = coarse.join(F.broadcast(offset), "_b").withColumn("high", (F.col("_from") + F.sum("q").over(inside)) / F.col("_all"))
    placed = placed.withColumn("low", F.col("high") - F.col("q") / F.col("_all"))
    spans = placed.select("token_id", "low", "high", F.explode(F.sequence(F.greatest(F.floor(F.col("low") * INTERVALS), F.lit(0)), F.least(F.floor(F.col("high") * INTERVALS), F.lit(INTERVALS - 1)))).alias("cell"))
    drawn = examples.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    drawn = drawn.withColumn("u", F.pmod(F.xxhash64(*keys, "i", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).withColumn("cell", F.floor(F.col("u") * INTERVALS))
    hit = drawn.join(by_shuffle(spans), "cell").where((F.col("u") >= F.col("low") - 1e-12) & (F.col("u") < F.col("high")))
    return hit.groupBy(*keys, "i").agg(F.min("token_id").alias("token_id"))


def sampled_softmax(hidden: np.ndarray, weights: np.ndarray, bias: np.ndarray, labels: np.ndarray, drawn: np.ndarray, q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean loss of a batch, and its derivatives by the logits of the labels, (B,), and of the drawn negatives, (B, K).

    Logits are lessened by the logarithm of how often a term is expected among the draws; a negative
    that is the label itself doesn't count.
    """
    k = len(drawn)
    own = (hidden * weights[labels]).sum(axis=1) + bias[labels] - np.log(k * q[labels])
    other = hidden @ weights[drawn].T + bias[drawn] - np.log(k * q[drawn])
    other[labels[:, None] == drawn[None, :]] = -np.inf
    top = np.maximum(own, other.max(axis=1))
    e_own, e_other = np.exp(own - top), np.exp(other - top[:, None])
    total = e_own + e_other.sum(axis=1)
    loss = float((top + np.log(total) - own).mean())
    return loss, (e_own / total - 1) / len(labels), e_other / total[:, None] / len(labels)


class Net:
    """Word vectors, and the weights and bias of the softmax over a paragraph's and two words' vectors, one after another."""

    def __init__(self, words: int, size: int, seed: int):
        random = np.random.default_rng(seed)
        self.words, self.size = words, size
        self.vectors = random.normal(0, 0.1, (words, size))
        self.weights, self.bias = np.zeros((words, 3 * size)), np.zeros(words)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.vectors.ravel(), self.weights.ravel(), self.bias])

    def take(self, flat: np.ndarray) -> Net:
        a, b = self.words * self.size, self.words * self.size * 4
        self.vectors, self.weights, self.bias = flat[:a].reshape(self.words, -1).copy(), flat[a:b].reshape(self.words, -1).copy(), flat[b:].copy()
        return self

    def step(self, paragraphs: np.ndarray, who: np.ndarray, c1: np.ndarray, c2: np.ndarray, labels: np.ndarray, drawn: np.ndarray, q: np.ndarray, rate: float, frozen: bool, sums: dict[str, np.ndarray]) -> float:
        """One step down the gradient on a batch; only the paragraphs' vectors move if the net is ``frozen``."""
        hidden = np.concatenate([paragraphs[who], self.vectors[c1], self.vectors[c2]], axis=1)
        loss, own, other = sampled_softmax(hidden, self.weights, self.bias, labels, drawn, q)
        back = own[:, None] * self.weights[labels] + other @ self.weights[drawn]
        n = self.size
        if not frozen:
            rows, parts = np.concatenate([labels, drawn]), np.concatenate([own[:, None] * hidden, other.T @ hidden])
            slopes = np.concatenate([own, other.sum(axis=0)])[:, None]
            _descend(self.weights, rows, parts, sums["weights"], rate)
            _descend(self.bias[:, None], rows, slopes, sums["bias"], rate)
            _descend(self.vectors, np.concatenate([c1, c2]), np.concatenate([back[:, n : 2 * n], back[:, 2 * n :]]), sums["vectors"], rate)
        _descend(paragraphs, who, back[:, :n], sums["paragraphs"], rate)
        return loss


def _descend(target: np.ndarray, rows: np.ndarray, parts: np.ndarray, sums: np.ndarray, rate: float) -> None:
    """Move the rows down the sums of their derivatives, each by ``rate`` over the root of what it has moved before."""
    own, place = np.unique(rows, return_inverse=True)
    slope = np.zeros((len(own), target.shape[1]))
    np.add.at(slope, place, parts)
    sums[own] += (slope * slope).mean(axis=1)
    target[own] -= rate * slope / (np.sqrt(sums[own])[:, None] + 1e-9)


def _start(keys: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.random.default_rng([7, int(k) & 0x7FFFFFFF]).normal(0, 0.1, size) for k in keys]) if len(keys) else np.zeros((0, size))


def _epoch(net: Net, table: pa.Table, q: np.ndarray, rate: float, epochs: int, frozen: bool, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Keys and vectors of the paragraphs of a part after ``epochs`` passes over its samples, and the loss of the last."""
    key, c1, c2, label = (table.column(i).to_numpy() for i in range(4))
    keys, who = np.unique(key, return_inverse=True)
    paragraphs, random, loss = _start(keys, net.size), np.random.default_rng(seed), 0.0
    sums = {"weights": np.zeros(net.words), "bias": np.zeros(net.words), "vectors": np.zeros(net.words), "paragraphs": np.zeros(len(keys))}
    for _ in range(epochs):
        order, losses = random.permutation(len(who)), []
        for at in range(0, len(order), BATCH):
            b = order[at : at + BATCH]
            losses.append(net.step(paragraphs, who[b], c1[b], c2[b], label[b], random.choice(len(q), NEGATIVES, p=q), q, rate, frozen, sums))
        loss = float(np.mean(losses)) if losses else 0.0
    return keys, paragraphs, loss


def trained_net(contexts: DataFrame, shares: DataFrame, size: int = 32, rounds: int = 3, rate: float = 0.05, parts: int = 8, seed: int = 1) -> tuple[Net, np.ndarray, list[float]]:
    """A net trained on samples (key, c1, c2, label), the shares of its words in order of token_id, and the loss of each round.

    Paragraphs are spread by key over ``parts``; each part trains a copy of the net and the copies
    are averaged, weighted by their samples, before the next round. token_ids must be dense.
    """
    rows = shares.select("token_id", "q").orderBy("token_id")
    words = rows.count()
    if words * (4 * size + 1) > MOST_WEIGHTS:
        raise ValueError(f"a net of {words} words and {size} elements has more than {MOST_WEIGHTS} weights")
    q = np.array([r["q"] for r in rows.collect()])  # bounded by MOST_WEIGHTS
    q = q / q.sum()
    net, spark, losses = Net(words, size, seed), contexts.sparkSession, []
    samples = cut(contexts.select("key", "c1", "c2", "label").repartition(parts, "key"))
    for number in range(rounds):
        sent = spark.sparkContext.broadcast(pickle.dumps((net, q)))

        def part(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            own, shares_of = pickle.loads(sent.value)
            n, total, flat = 0, 0.0, own.flat()
            for batch in batches:  # a batch of rows at a time is all that is held
                _, _, loss = _epoch(own, pa.Table.from_batches([batch]), shares_of, rate, 1, False, seed + number)
                n, total = n + batch.num_rows, total + loss * batch.num_rows
            flat = own.flat() * n
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.append(flat, [total, n])], pa.list_(pa.float64()))], ["one", "v"])

        summed = vector_sums(samples.mapInArrow(part, "one int, v array<double>"), "one").first()
        if summed is None or not summed["v"][-1]:
            break
        flat = np.array(summed["v"])
        net.take(flat[:-2] / flat[-1])
        losses.append(flat[-2] / flat[-1])
        sent.unpersist()
    return net, q, losses


def paragraph_vectors(contexts: DataFrame, net: Net, q: np.ndarray, epochs: int = 20, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """(key, v): a vector of each paragraph of ``contexts`` (key, c1, c2, label), learnt with the net left as it is.

    A paragraph of very many samples is one group; its samples are numbers only. Paragraphs without
    samples have no row.
    """
    sent = contexts.sparkSession.sparkContext.broadcast(pickle.dumps((net, q)))

    def learn(table: pa.Table) -> pa.Table:
        own, shares = pickle.loads(sent.value)
        keys, vectors, _ = _epoch(own, table, shares, rate, epochs, True, seed)
        return pa.table({"key": keys, "v": pa.array(list(vectors), pa.list_(pa.float64()))})

    rows = contexts.select("key", "c1", "c2", "label", F.pmod(F.xxhash64("key"), F.lit(1024)).alias("part"))
    return rows.groupBy("part").applyInArrow(lambda table: learn(table.select(["key", "c1", "c2", "label"])), "key long, v array<double>")
