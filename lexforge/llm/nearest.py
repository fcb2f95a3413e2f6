"""The most similar vectors of every vector, by a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_shuffle, cut, hashed_sample
from .papers import one_per_paper

WIDTH = 64
#: The tree is fitted on at most so many vectors, those of the lowest hash; all vectors are indexed.
SAMPLE = 4096
#: Queries, those of the next hashes (of the last where no more are there), whose true neighbours say how many leaves a search must visit.
CALIBRATION = 256
BRANCHES = 8
#: Vectors a leaf is meant to hold, and that one cell of a crowded leaf holds at most.
LEAF, CELL = 768, 4096
#: Leaves that are fuller than so many times ``LEAF`` on average are fitted again, each on at most so many of its own vectors, up to so many leaves in all.
CROWDED, AGAIN, MOST_LEAVES = 3, 8192, 65_536
#: Vectors that a node is split by at least, where they stand for more than themselves: what is fitted on fewer tears apart vectors that are close.
FEWEST, FEWEST_AGAIN = 512, 128
#: Costs of nodes for queries that are held at once.
MOST_COSTS = 2_000_000
#: Vectors, and visits by queries, that one task gets together.
GROUP, VISITS = 32_768, 500_000
#: What single precision can make of a difference of similarities.
SLACK = 1e-5


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """A k-means tree. Node i has its centre in row i; leaves carry numbers from left to right."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int = LEAF, seed: int = 5, *, fewest: int = FEWEST):
        self.random = np.random.default_rng(seed)
        centres, children = [np.zeros(sample.shape[1])], [[]]
        self.fewest = fewest if total > len(sample) else 2 * BRANCHES
        self._grow(0, sample, total / max(1, len(sample)), leaf, centres, children)
        self._number(centres, children)

    def _grow(self, node: int, rows: np.ndarray, scale: float, leaf: int, centres: list, children: list[list[int]]) -> None:
        parts = self._split(rows) if len(rows) * scale > leaf and len(rows) >= self.fewest else []
        if len(parts) < 2:
            return
        for part in parts:
            children[node].append(len(centres))
            centres.append(part.mean(axis=0)), children.append([])
        for child, part in zip(children[node], parts):
            self._grow(child, part, scale, leaf, centres, children)

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        centres = rows[self.random.choice(len(rows), BRANCHES, replace=False)]
        for _ in range(8):
            near = np.argmax(rows @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
            centres = np.array([rows[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
        return [rows[near == i] for i in range(BRANCHES) if (near == i).any()]

    def graft(self, below: dict[int, tuple[np.ndarray, list[list[int]]]]) -> None:
        """Put fitted subtrees (centres, children; node 0 stands for the leaf) in place of leaves, and number the leaves anew."""
        centres, children = list(self.centres), [list(c) for c in self.children]
        for node in np.flatnonzero(self.leaf_of >= 0):
            if (own := below.get(int(self.leaf_of[node]))) is not None and own[1][0]:
                base = len(centres) - 1
                children[node] = [base + c for c in own[1][0]]
                centres += list(own[0][1:])
                children += [[base + c for c in x] for x in own[1][1:]]
        self._number(centres, children)

    def _number(self, centres: list, children: list[list[int]]) -> None:
        self.centres, self.children = np.array(centres), children
        self.half = 0.5 * (self.centres * self.centres).sum(axis=1)
        self.leaf_of, self.leaves = np.full(len(children), -1), 0
        todo = [0]
        while todo:
            node = todo.pop()
            if not children[node]:
                self.leaf_of[node], self.leaves = self.leaves, self.leaves + 1
            todo += reversed(children[node])
        self.child_table = np.full((len(children), BRANCHES), -1)
        for i, own in enumerate(children):
            self.child_table[i, : len(own)] = own
        # nodes by depth with the nodes above them; the way to each leaf from the root, which ends with the leaf, once more for every depth it lacks
        parent, depth, nodes = np.zeros(len(children), int), [], np.zeros(1, int)
        while len(nodes):
            depth.append(nodes)
            own = self.child_table[nodes]
            parent[own[own >= 0]] = np.repeat(nodes, (own >= 0).sum(axis=1))
            nodes = own[own >= 0]
        self.levels = [(x, parent[x]) for x in depth[1:]]
        leaf = np.flatnonzero(self.leaf_of >= 0)
        way = [leaf[np.argsort(self.leaf_of[leaf])]]
        for _ in self.levels:
            way.append(parent[way[-1]])
        way = np.stack(way[::-1], axis=1)
        lacking = (way == 0).sum(axis=1, keepdims=True) - 1
        self.way = np.take_along_axis(way, np.minimum(np.arange(way.shape[1]) + lacking, way.shape[1] - 1), 1)

    def _opened(self, nodes: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of each node, and half their squared distance from its vector but for a constant; inf where there is none."""
        own = self.child_table[nodes]
        cost = self.half[own] - np.einsum("nd,nkd->nk", vectors, self.centres[own])
        return own, np.where(own >= 0, cost, np.inf)

    def leaf_order(self, queries: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` leaves of each query, best bin first.

        A priority queue of nodes by the distance of their centres, whose nearest is always taken and
        opened, meets the leaves by the farthest node on their way from the root, those that have it
        in common by the farthest below it, and so on. So no queue is run: the costs of all nodes are
        one product, and only leaves within reach are put in order.
        """
        n, visits = len(queries), min(visits, self.leaves)
        out = np.zeros((n, visits), np.int32)
        step = max(1, MOST_COSTS // len(self.centres))
        for start in range(0, n if self.leaves > 1 else 0, step):
            cost = self.half - queries[start : start + step] @ self.centres.T
            cost[:, 0] = -np.inf  # the root is always taken
            far = cost.copy()
            for nodes, above in self.levels:
                far[:, nodes] = np.maximum(far[:, nodes], far[:, above])
            far = far[:, self.way[:, -1]]
            edge = np.partition(far, visits - 1, axis=1)[:, visits - 1 : visits]
            row, leaf = np.nonzero(far <= edge)
            keys = [far[row, leaf]]  # then the farthest of what is left of the way, from each depth on
            for depth in range(2, self.way.shape[1]):
                keys.append(cost[row[:, None], self.way[leaf, depth:]].max(axis=1))
            order = np.lexsort([*reversed(keys), row])
            row, leaf = row[order], leaf[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            out[start + row[place < visits], place[place < visits]] = leaf[place < visits]
        return out

    def own_leaf(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that holds each vector: from the root always to the nearest child."""
        node = np.zeros(len(vectors), int)
        while True:
            inner = np.flatnonzero(self.leaf_of[node] < 0)
            if not len(inner):
                return self.leaf_of[node]
            own, cost = self._opened(node[inner], vectors[inner])
            node[inner] = own[np.arange(len(inner)), np.argmin(cost, axis=1)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def _list_array(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def usable_vectors(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The papers with a usable vector (paper_id, content), and the vectors (content, vector).

    Usable: 64 elements, all finite, not all zero. ``content`` names a vector; a paper has that of
    its first harvest. The vectors themselves are shuffled once, copies merged before.
    """
    limit = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    usable = (F.size("vector") == WIDTH) & finite & F.exists("vector", lambda x: x != 0)
    raw = papers.withColumn("vector", F.col("other.para_vec").cast("array<float>"))
    content = F.when(usable, F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.hash("vector"))))
    first = one_per_paper(raw, content).withColumnRenamed("v0", "content").where(F.col("content").isNotNull())
    return first, raw.where(usable).select(content.alias("content"), "vector").groupBy("content").agg(F.first("vector").alias("vector"))


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, all of them if there are fewer."""
    return np.argpartition(-sims, k - 1, axis=1)[:, :k] if sims.shape[1] > k else np.tile(np.arange(sims.shape[1]), (len(sims), 1))


def _exact(queries: np.ndarray, keys: np.ndarray, k: int):
    """The best k classes of each part of the table for each of a few queries, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), unit_rows(_matrix(batch.column(1)))
            sims = queries @ vectors.T
            sims[keys[:, None] == ids[None, :]] = -2
            best = _best(sims, k)
            q = np.repeat(np.arange(len(queries)), best.shape[1])
            flat = best.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[flat]), pa.array(sims[q, flat]), _list_array(vectors[flat], pa.float64())], ["q", "id", "sim", "vector"])

    return run


def calibrated_visits(tree: Tree, classes: DataFrame, queries: list, recall: float, k: int) -> int:
    """Leaves that a search must visit for ``recall`` of the true k neighbours of the calibration queries."""
    if tree.leaves == 1 or not queries:
        return 1
    vectors = unit_rows(np.array([q["vector"] for q in queries]))
    keys = np.array([q["id"] for q in queries])
    found = classes.select("id", "vector").mapInArrow(_exact(vectors, keys, k), "q long, id long, sim double, vector array<double>")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))).where((F.col("r") <= k) & (F.col("sim") > -2))
    true = ranked.select("q", "vector").collect()  # k rows a calibration query
    leaves = tree.own_leaf(np.array([t["vector"] for t in true]))
    order = tree.leaf_order(vectors, tree.leaves)
    needed = np.sort([int(np.flatnonzero(order[t["q"]] == leaf)[0]) + 1 for t, leaf in zip(true, leaves)])
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])


def _leaf_of(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.own_leaf(unit_rows(_matrix(batch.column(1)))).astype(np.int32)), batch.column(0), batch.column(1)], ["leaf", "h", "vector"])

    return run


def refined(tree: Tree, classes: DataFrame, total: int) -> Tree:
    """The tree with its crowded leaves fitted again, each by a task of its own on a bounded part of its vectors.

    Where the sample is too small for leaves of ``LEAF`` vectors, the leaves it gives are split by a
    second level. The model, at most ``MOST_LEAVES`` leaves, is all that reaches the driver.
    """
    if total <= CROWDED * LEAF * tree.leaves or tree.leaves >= MOST_LEAVES:
        return tree
    placed = cut(classes.select(F.xxhash64("content").alias("h"), "vector").mapInArrow(_leaf_of(tree), "leaf int, h long, vector array<float>"))
    sizes = dict(placed.groupBy("leaf").count().collect())  # a row per leaf
    aim = max(2 * LEAF, math.ceil(total / MOST_LEAVES))
    crowded = [(leaf, n, min(1.0, AGAIN / n)) for leaf, n in sizes.items() if n > CROWDED * LEAF]
    wanted = F.broadcast(placed.sparkSession.createDataFrame(crowded, "leaf int, n long, share double"))  # a row per leaf
    # another hash than that of the leaf's first sample
    part = placed.join(wanted, "leaf").where(F.shiftrightunsigned(F.xxhash64("h"), 1) < F.col("share") * float(1 << 63))

    def fitted(table: pa.Table) -> pa.Table:
        own = Tree(unit_rows(_matrix(table["vector"].combine_chunks())), table["n"][0].as_py(), aim, fewest=FEWEST_AGAIN)
        return pa.table({"leaf": table["leaf"].slice(0, 1), "tree": pa.array([pickle.dumps((own.centres, own.children))], pa.binary())})

    made = part.select("leaf", "n", "vector").groupBy("leaf").applyInArrow(fitted, "leaf int, tree binary").collect()
    tree.graft({r["leaf"]: pickle.loads(bytes(r["tree"])) for r in made})
    return tree


def _placed(tree: Tree, visits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                vectors = unit_rows(_matrix(part.column(1)))
                order = tree.leaf_order(vectors, visits)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tree.own_leaf(vectors).astype(np.int32)), _list_array(order.astype(np.int32), pa.int32())], ["id", "vector", "leaf", "visits"])

    return run


#: (leaf, cells of the leaf, cell, group of the cell, parts of its searches), a row per cell.
Plan = list[tuple[int, int, int, int, int]]


def _spread(ids: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each id, even if ids of one partition follow each other."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def _stored(plan: Plan):
    """Every vector to the cell of its leaf, once for each part of the searches there."""
    cells = {(leaf, cell): (g, parts) for leaf, _, cell, g, parts in plan}
    most = {leaf: n for leaf, n, *_ in plan}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaves = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            g, part, rows = [], [], []
            for leaf in np.unique(leaves):
                own = np.flatnonzero(leaves == leaf)
                for cell in range(most[leaf]):
                    some = own[_spread(ids[own], most[leaf]) == cell]
                    group, parts = cells[leaf, cell]
                    for p in range(parts):
                        g.append(np.full(len(some), group)), part.append(np.full(len(some), p)), rows.append(some)
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g), pa.int32()), pa.array(np.concatenate(part), pa.int32()), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)], ["g", "part", "id", "vector", "leaf"])

    return run


def _asking(plan: Plan):
    """Every search to the groups that hold leaves it visits, once a group, with those leaves."""
    leaf, _, _, group, parts = (np.array(x) for x in zip(*plan))
    order = np.argsort(leaf, kind="stable")
    leaf, group, parts = leaf[order], group[order], parts[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                one = batch.slice(start, 4096)
                ids, visits = one.column(0).to_numpy(), one.column(2)
                per = np.diff(visits.offsets.to_numpy())
                row, at = np.repeat(np.arange(len(ids)), per), visits.flatten().to_numpy()
                low, high = np.searchsorted(leaf, at), np.searchsorted(leaf, at, "right")
                n = high - low  # cells of each visited leaf
                row, at = np.repeat(row, n), np.repeat(at, n)
                cell = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                g, part = group[cell], _spread(ids[row], 1 << 20) % parts[cell]
                _, first = np.unique(np.stack([row, g, part, at]), axis=1, return_index=True)
                row, g, part, at = row[first], g[first], part[first], at[first]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1]) | (part[1:] != part[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(at.astype(np.int32)))
                take = pa.array(row[new])
                yield pa.RecordBatch.from_arrays([pa.array(g[new], pa.int32()), pa.array(part[new], pa.int32()), one.column(0).take(take), one.column(1).take(take), lists], ["gq", "pq", "q", "qv", "at"])

    return run


def _compare(k: int):
    def run(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        if not vectors.num_rows or not queries.num_rows:
            return none
        leaf, ids = vectors["leaf"].to_numpy(), vectors["id"].to_numpy()
        v = unit_rows(_matrix(vectors["vector"].combine_chunks()))
        short = v.astype(np.float32)
        visits = queries["at"].combine_chunks()
        owner, at = np.repeat(np.arange(len(visits)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()
        q, own = _matrix(queries["qv"].combine_chunks()), queries["q"].to_numpy()
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        reached = np.full((len(own), k), -2.0)  # the best similarities of each query so far
        parts = []
        for one in np.unique(leaf):
            rows = np.flatnonzero(leaf == one)
            askers = owner[np.searchsorted(at, one) : np.searchsorted(at, one, "right")]
            for start in range(0, len(askers), 1024):
                some = askers[start : start + 1024]
                exact = unit_rows(q[some])
                sims = exact.astype(np.float32) @ short[rows].T
                # in single precision, all that may be among the best; the least of k + 1 parts' maxima is reached k times at least besides the query itself
                goal, each = reached[some].min(axis=1), len(rows) // (k + 1)
                if each:
                    goal = np.maximum(goal, sims[:, : each * (k + 1)].reshape(len(some), k + 1, each).max(axis=2).min(axis=1))
                who, which = np.divmod(np.flatnonzero(sims >= (goal - SLACK).astype(np.float32)[:, None]), len(rows))
                other = own[some[who]] != ids[rows[which]]
                who, which = who[other], which[other]
                kept = np.einsum("nd,nd->n", exact[who], v[rows[which]])
                parts.append((own[some[who]], ids[rows[which]], kept))
                order = np.lexsort((-kept, who))
                who, kept = who[order], kept[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                new = np.full((len(some), k), -2.0)
                new[who[place < k], place[place < k]] = kept[place < k]
                reached[some] = np.sort(np.concatenate([reached[some], new], axis=1), axis=1)[:, k:]
        if not parts:
            return none
        a, b, s = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, -s, a))  # the best k of each query over the leaves here
        a, b, s = a[order], b[order], s[order]
        first = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.empty(0, bool)
        place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
        return pa.table({"q": a[place < k], "id": b[place < k], "sim": s[place < k]})

    return run


def fitted_and_asking(sample: list) -> tuple[list, list]:
    """The vectors the tree is fitted on and the calibration queries, which are others where there are more than ``SAMPLE``."""
    if len(sample) <= SAMPLE:
        return sample, sample[-CALIBRATION:]
    n = max(len(sample) - CALIBRATION, min(SAMPLE, len(sample) // 2))
    return sample[:n], sample[n:]


def neighbours(papers: DataFrame, k: int = 5, recall: float = 0.997) -> DataFrame:
    """(paper_id, rank, neighbour_id, similarity): the k papers of the nearest vectors by cosine, ties to the smaller id.

    Papers without a usable vector (64 elements, all finite, not all zero) are neither queries nor
    neighbours; null elements make a vector unusable. Papers with the same vector form one class
    that is indexed once, with the k + 1 smallest of its ids, so copies cost nothing however many
    they are, and they are each other's nearest. The index is a k-means tree fitted on at most
    ``SAMPLE`` vectors, its crowded leaves on more of their own, and filled with every class. A search visits as many leaves, best bin first,
    as give ``recall`` of the true neighbours of ``CALIBRATION`` queries compared with all vectors.
    Crowded leaves are split into cells that tasks compare apart. Fewer than two usable papers give
    no rows.
    """
    spark = papers.sparkSession
    owners, vectors = usable_vectors(papers)
    owners = cut(owners)
    small = owners.withColumn("r", F.row_number().over(Window.partitionBy("content").orderBy("paper_id"))).where(F.col("r") <= k + 1)
    lists = small.groupBy("content").agg(F.sort_array(F.collect_list("paper_id")).alias("ids"))  # k + 1 at most
    classes = cut(lists.join(by_shuffle(vectors), "content").withColumn("id", F.monotonically_increasing_id()))

    total = classes.count()
    fitted, queries = fitted_and_asking(hashed_sample(classes.select("id", "vector", "content"), total, SAMPLE + CALIBRATION, "content"))
    rows = unit_rows(np.array([r["vector"] for r in fitted]).reshape(-1, WIDTH))
    tree = refined(Tree(rows, total), classes, total)
    visits = calibrated_visits(tree, classes, queries, recall, k)
    if len(fitted) < total:  # few queries measure roughly: the more careful of two measures is taken
        visits = max(visits, calibrated_visits(tree, classes, fitted[-CALIBRATION:], recall, k))
    placed = cut(classes.select("id", "vector").mapInArrow(_placed(tree, visits), "id long, vector array<float>, leaf int, visits array<int>"))

    # A row per leaf reaches the driver: its vectors, and the searches that visit it.
    sizes = dict(placed.groupBy("leaf").count().collect())
    asked = dict(placed.select(F.explode("visits").alias("leaf")).groupBy("leaf").count().collect())
    most = max(CELL // 4, min(GROUP, total // (2 * spark.sparkContext.defaultParallelism) + 1))
    grouped, by_group, vectors_in = [], [0], 0
    for leaf in range(tree.leaves):
        cells = max(1, math.ceil(sizes.get(leaf, 0) / CELL))
        for cell in range(cells):
            in_cell = math.ceil(sizes.get(leaf, 0) / cells)
            if vectors_in and vectors_in + in_cell > most:
                by_group.append(0)
                vectors_in = 0
            grouped.append((leaf, cells, cell, len(by_group) - 1))
            vectors_in, by_group[-1] = vectors_in + in_cell, by_group[-1] + asked.get(leaf, 0)
    plan = [(*x, max(1, math.ceil(by_group[x[3]] / VISITS))) for x in grouped]  # a search goes to one part of a group, whatever it visits there
    inside = placed.select("id", "vector", "leaf").mapInArrow(_stored(plan), "g int, part int, id long, vector array<float>, leaf int")
    asking = placed.select("id", "vector", "visits").mapInArrow(_asking(plan), "gq int, pq int, q long, qv array<float>, at array<int>")
    compared = inside.groupBy("g", "part").cogroup(asking.groupBy("gq", "pq")).applyInArrow(_compare(k), "q long, id long, sim double")

    best = compared.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))).where(F.col("r") <= k)
    others = best.join(by_shuffle(classes.select("id", "ids")), "id").select("q", F.explode(F.slice("ids", 1, k)).alias("n"), "sim")
    others = others.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "n"))).where(F.col("r") <= k)
    lists = others.groupBy("q").agg(F.collect_list(F.struct("sim", "n")).alias("others"))  # k at most
    around = classes.select("content", "id", "ids").join(by_shuffle(lists.withColumnRenamed("q", "id")), "id", "left")
    own = F.transform("ids", lambda x: F.struct(F.lit(1.0).alias("sim"), x.alias("n")))
    around = around.select("content", F.concat(own, F.coalesce("others", F.array().cast("array<struct<sim:double,n:string>>"))).alias("near"))
    members = owners.join(by_shuffle(around), "content")
    near = F.filter("near", lambda x: x["n"] != F.col("paper_id"))
    lists = members.select("paper_id", F.slice(F.array_sort(near, lambda x, y: F.when(x["sim"] > y["sim"], -1).when(x["sim"] < y["sim"], 1).when(x["n"] < y["n"], -1).otherwise(1)), 1, k).alias("near"))
    return lists.select("paper_id", F.posexplode("near").alias("p", "x")).select("paper_id", (F.col("p") + 1).alias("rank"), F.col("x.n").alias("neighbour_id"), F.col("x.sim").alias("similarity"))


def neighbour_pairs(papers: DataFrame, k: int = 5, recall: float = 0.997) -> DataFrame:
    """(paper_id_1, paper_id_2), smaller id first: one is among the other's k nearest."""
    near = neighbours(papers, k, recall)
    return near.select(F.least("paper_id", "neighbour_id").alias("paper_id_1"), F.greatest("paper_id", "neighbour_id").alias("paper_id_2")).distinct()
