"""Related documents and recommendations to users."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_double, dot, squared_distance, vector_sums
from ..session import broadcast_if_small, by_shuffle, cut
from .impact import impact_search
from .lexical import top


def related(seeds: DataFrame, vectors: DataFrame, paragraph: DataFrame, key: str, n: int = 20, offset: int = 0, source: tuple | None = None) -> DataFrame:
    """(query_id, rank, doc, score): the documents related to each of ``seeds`` (key).

    Candidates are the best 2n + offset by impact search with the seed's own stored vector, the seed
    among them. If it has a paragraph vector (key, v), candidates that have one are ranked by the
    negative squared distance to it and the others fall out; otherwise the candidates stand as they are.
    ``source`` is that of :func:`impact_search`.
    """
    chosen = seeds.select(key).distinct()
    if source:  # the seeds' rows alone are made vectors
        rows, before = source
        own = rows.join(broadcast_if_small(chosen), key, "left_semi")
        queries = (own.mapInArrow(before, vectors.withColumnRenamed("val", "x").select(key, "term", "x").schema) if before else own).select(F.col(key).alias("query_id"), "term", F.col("x").alias("val"))
    else:
        queries = vectors.join(chosen, key, "left_semi").select(F.col(key).alias("query_id"), "term", "val")
    found = impact_search(queries, vectors, key, 2 * n + offset, source=source)
    own = paragraph.where("v is not null").select(F.col(key).alias("query_id"), F.col("v").alias("qv"))
    theirs = paragraph.where("v is not null").select(F.col(key).alias("doc"), "v")
    both = found.join(own, "query_id", "left").join(theirs, "doc", "left").where("qv is null or v is not null")
    again = both.select("query_id", "doc", F.when(F.col("qv").isNull(), F.col("score")).otherwise(-squared_distance(F.col("v"), F.col("qv"))).alias("score"))
    return top(again, n, offset).select("query_id", "rank", "doc", "score")


def recent_history(events: DataFrame, n: int = 100) -> DataFrame:
    """(user_id, doc_id, rank): the documents of each user's n latest events, latest first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("user_id", "doc_id", "rank")


def unseen(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """The candidates (user_id, doc_id) that a user's history doesn't have."""
    return candidates.join(history.select("user_id", "doc_id").distinct(), ["user_id", "doc_id"], "left_anti")


def hashed_order(id_column: str, salt: Column) -> Column:
    """A fixed order that looks random: by the md5 of salt and id."""
    return F.md5(F.concat_ws("-", salt.cast("string"), F.col(id_column).cast("string")))


def training_set(history: DataFrame, candidates: DataFrame, documents: DataFrame, users: DataFrame, negatives: int = 100) -> DataFrame:
    """(user_id, doc_id, label): history, candidates and other documents of each user, 1 for what is in the history.

    The others are the ``negatives`` documents of lowest md5 that are in neither. Documents are ordered
    by md5 of their id alone, so one ordered list serves all users: its first ``2 * negatives`` do for
    nearly all of them, and only users who have taken too many of these are set against a list twice
    as long, until all have enough or the documents end. A user with a long history costs others nothing.
    """
    taken = cut(history.select("user_id", "doc_id").unionByName(candidates.select("user_id", "doc_id")).distinct())
    ordered = documents.select("doc_id", hashed_order("doc_id", F.lit("n")).alias("h"))
    short, size, total, chosen = cut(users.select("user_id").distinct()), 2 * negatives, documents.count(), []
    while True:
        first = cut(ordered.orderBy("h", "doc_id").limit(size))
        pool = _each_with(short, first)
        order = Window.partitionBy("user_id").orderBy("h", "doc_id")
        rest = pool.join(by_shuffle(taken), ["user_id", "doc_id"], "left_anti").withColumn("r", F.row_number().over(order)).where(F.col("r") <= negatives)
        rest = cut(rest.select("user_id", "doc_id"))
        enough = rest.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= negatives).select("user_id")
        if size >= total:
            chosen.append(rest)
            break
        chosen.append(rest.join(by_shuffle(enough), "user_id", "left_semi"))
        short, size = cut(short.join(by_shuffle(enough), "user_id", "left_anti")), 2 * size
        if short.isEmpty():
            break
    every = taken
    for rest in chosen:
        every = every.unionByName(rest)
    every = every.distinct()
    return every.join(history.select("user_id", "doc_id", F.lit(1).alias("label")).distinct(), ["user_id", "doc_id"], "left").na.fill(0, ["label"])


def _each_with(users: DataFrame, items: DataFrame, parts: int = 64) -> DataFrame:
    """Every user with every item of a list: items are spread over parts, which meet copies of the users, so neither side is sent whole to a task."""
    salted = items.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    return users.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(by_shuffle(salted), "_part").drop("_part")


def linear_svm(rows: DataFrame, c: float = 0.1, iterations: int = 50, balanced: bool = True, intercept: bool = True):
    """A linear support vector machine on rows (v, label), each class weighing n / (2 n of the class)."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(sizes.values())
    weight = F.lit(1.0)
    if balanced:
        for label, n in sizes.items():
            weight = F.when(F.col("label") == label, total / (len(sizes) * n)).otherwise(weight)
    ready = rows.select(array_to_vector(as_double(F.col("v"))).alias("features"), F.col("label").cast("double").alias("label"), weight.alias("w"))
    return LinearSVC(regParam=1 / (c * max(1, total)), maxIter=iterations, tol=1e-5, weightCol="w", fitIntercept=intercept, standardization=False).fit(ready)


def margin(v: Column, model) -> Column:
    """The decision value of a linear model, as a Column."""
    return dot(v, F.array(*[F.lit(float(x)) for x in model.coefficients])) + F.lit(float(model.intercept))


#: Rows of a user up to which one task trains that user's machine; a user with more is trained by all tasks.
ROWS_A_USER = 100_000


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _squared_hinge(x: np.ndarray, sign: np.ndarray, cost: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and second derivatives, one after another, of the squared hinge loss of some rows."""
    short = 1 - sign * (x @ w)
    hit = short > 0
    x, part = x[hit], (cost * short)[hit]
    return np.concatenate([[(part * short[hit]).sum()], -2 * (part * sign[hit]) @ x, (2 * (x * cost[hit, None]).T @ x).ravel()])


def svm_by_newton(sums: Callable[[np.ndarray], np.ndarray], width: int, iterations: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    """The weights with the least half square plus loss; ``sums`` gives :func:`_squared_hinge` over all rows.

    The optimum is one alone, so it doesn't matter who adds up the rows.
    """
    w = np.zeros(width)
    here = sums(w)
    for _ in range(iterations):
        slope, bend = w + here[1 : width + 1], np.eye(width) + here[width + 1 :].reshape(width, width)
        step, least, size = np.linalg.solve(bend, slope), here[0] + w @ w / 2, 1.0
        while True:
            new = w - size * step
            there = sums(new)
            if there[0] + new @ new / 2 <= least or size < 1e-4:
                break
            size /= 2
        gain, w, here = least - there[0] - new @ new / 2, new, there
        if gain <= tolerance * max(1.0, least):
            break
    return w


def _costs(positive: int, negative: int, c: float) -> tuple[float, float]:
    """Cost of a row of either class, balanced: n / (2 n of the class)."""
    n = positive + negative
    return c * n / (2 * max(1, positive)), c * n / (2 * max(1, negative))


def recommend_all(user_rows: DataFrame, vectors: DataFrame, n: int = 20, c: float = 0.1) -> DataFrame:
    """(user_id, doc_id, score): the n best of each user's unseen documents by a machine trained on the user's rows (user_id, doc_id, label).

    The machine is linear with squared hinge loss, balanced classes and an intercept. Those of all
    users are trained side by side, one task a user; the few users with more than ``ROWS_A_USER``
    rows are trained by all tasks, which add up the same sums. A user without both labels gets no rows.
    """
    spark = user_rows.sparkSession
    rows = cut(user_rows.join(by_shuffle(vectors.where("v is not null").select("doc_id", as_double(F.col("v")).alias("v"))), "doc_id").select("user_id", "doc_id", "label", "v"))
    sizes = rows.groupBy("user_id").agg(F.count_if(F.col("label") > 0).alias("p"), F.count(F.lit(1)).alias("n")).where("p > 0 and p < n")
    large = sizes.where(F.col("n") > ROWS_A_USER).collect()  # at most rows / ROWS_A_USER
    usual = rows.join(by_shuffle(sizes.where(F.col("n") <= ROWS_A_USER).select("user_id")), "user_id", "left_semi")

    def trained(table: pa.Table) -> pa.Table:
        v, label = table["v"].combine_chunks(), table["label"].to_numpy() > 0
        x = _with_one(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1))
        high, low = _costs(int(label.sum()), int((~label).sum()), c)
        sign, cost = np.where(label, 1.0, -1.0), np.where(label, high, low)
        w = svm_by_newton(lambda w: _squared_hinge(x, sign, cost, w), x.shape[1])
        return pa.table({"user_id": table["user_id"].slice(0, 1), "w": pa.array([w[:-1]], pa.list_(pa.float64())), "b": pa.array([w[-1]])})

    kind = f"user_id {rows.schema['user_id'].dataType.simpleString()}, w array<double>, b double"
    models = usual.groupBy("user_id").applyInArrow(trained, kind)
    for user in large:
        w = _trained_by_all(rows.where(F.col("user_id") == user["user_id"]).select("v", "label"), _costs(user["p"], user["n"] - user["p"], c))
        models = models.unionByName(spark.createDataFrame([(user["user_id"], [float(x) for x in w[:-1]], float(w[-1]))], kind))
    scored = rows.where("label = 0").join(by_shuffle(models), "user_id").select("user_id", "doc_id", (dot(F.col("v"), F.col("w")) + F.col("b")).alias("score"))
    order = Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def _trained_by_all(rows: DataFrame, costs: tuple[float, float]) -> np.ndarray:
    """A machine on rows (v, label) whose sums are added up by all tasks; one row of sums a step reaches the driver."""
    width = rows.select(F.size("v")).first()[0] + 1

    def sums(w: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + width + width * width)
            for batch in batches:
                label = batch.column(1).to_numpy() > 0
                x = _with_one(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                total += _squared_hinge(x, np.where(label, 1.0, -1.0), np.where(label, *costs), w)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["one", "v"])

        return np.array(vector_sums(rows.mapInArrow(part, "one int, v array<double>"), "one").first()["v"])

    return svm_by_newton(sums, width)


def recommend(user_rows: DataFrame, vectors: DataFrame, n: int = 20, offset: int = 0) -> DataFrame:
    """(doc_id, score) for one user's training set (doc_id, label): unseen documents by the margin of a machine trained on it.

    Documents without a vector drop out. Without both labels nothing can be learnt and there are no rows.
    """
    best = recommend_all(user_rows.select(F.lit(0).alias("user_id"), "doc_id", "label"), vectors, n + offset)
    return best.orderBy(F.desc(F.round("score", 6)), "doc_id").offset(offset).limit(n).select("doc_id", "score")


def recommend_users(history: DataFrame, vectors: DataFrame, paragraph: DataFrame, n: int = 20, negatives: int = 100) -> DataFrame:
    """(user_id, rank, doc_id, score): what to show each user of ``history`` (user_id, doc_id, rank), all in one batch.

    Candidates are the documents related to a few of the user's recent ones; a machine trained on the
    history against these and ``negatives`` others ranks what the user hasn't seen. Users whose
    history has no vectors get no rows.
    """
    candidates = cut(history_candidates(history, vectors, paragraph, n))
    documents = vectors.select("doc_id").distinct()
    rows = training_set(history, candidates, documents, history.select("user_id").distinct(), negatives)
    best = recommend_all(rows, paragraph, n)
    order = Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return best.select("user_id", F.row_number().over(order).alias("rank"), "doc_id", "score")


def history_candidates(history: DataFrame, vectors: DataFrame, paragraph: DataFrame, n: int = 20, seeds: int = 5, window: int = 100) -> DataFrame:
    """(user_id, doc_id): n documents related to each of a few of a user's recent documents.

    ``history`` holds (user_id, doc_id, rank). The seeds are the documents of lowest md5 among the
    ``window`` latest. All users' seeds are searched for in one batch.
    """
    recent = history.where(F.col("rank") <= window).select("user_id", "doc_id").distinct()
    order = Window.partitionBy("user_id").orderBy(hashed_order("doc_id", F.col("user_id")), "doc_id")
    chosen = recent.withColumn("r", F.row_number().over(order)).where(F.col("r") <= seeds).select("user_id", "doc_id")
    near = related(chosen.select("doc_id"), vectors, paragraph, "doc_id", n)
    return chosen.join(near.select(F.col("query_id").alias("doc_id"), "doc"), "doc_id").select("user_id", F.col("doc").alias("doc_id")).distinct()


def recommend_to(user, history: DataFrame, vectors: DataFrame, paragraph: DataFrame, terms: DataFrame | None = None, n: int = 20, offset: int = 0) -> DataFrame:
    """(doc_id, score): what to show a user, best first.

    ``terms`` (user_id, term) are words the user chose: they make one query whose best 2n + offset
    documents are the candidates, otherwise the user's history gives them. Without a history the
    candidates stand as found; with one a machine is trained on it against the candidates and a hundred
    others. Nothing is known of a user without terms and history, so there are no rows.
    """
    own = history.where(F.col("user_id") == user)
    words = terms.where(F.col("user_id") == user).limit(100) if terms is not None else None
    if words is not None and not words.isEmpty():
        asked = words.groupBy(F.lit(0).alias("query_id"), "term").agg(F.log1p(F.count(F.lit(1))).alias("val"))
        found = impact_search(asked, vectors, "doc_id", 2 * n + offset)
        if own.isEmpty():
            return found.where((F.col("rank") > offset) & (F.col("rank") <= offset + n)).select(F.col("doc").alias("doc_id"), "score")
        candidates = found.select(F.lit(user).alias("user_id"), F.col("doc").alias("doc_id"))
    else:
        candidates = history_candidates(own, vectors, paragraph, n)
    every = vectors.select("doc_id").distinct()
    rows = training_set(own, candidates, every, own.select("user_id").distinct())
    return recommend(rows.select("doc_id", "label"), paragraph, n, offset)
