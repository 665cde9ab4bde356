"""Centroid clustering of integer vectors by kd-tree filtering.

Vectors stay in trees, one for each block of at most ``TREE_ROWS`` vectors of a partition. A node of a tree covers a run of
vectors, with their number, their integer sums and the box around them. Each round sends the centroids through every tree from its
root: of a node's centroids, the one nearest to the middle of its box rules out those that it strictly dominates, that is those
from which every point of the box is farther (by distance, then number). A node that is left with one centroid is assigned whole, by its number
and sums; leaves that are not are resolved vector by vector. So a round reads the trees, hands on one row of sums for a
centroid and tree, and gives what an assignment of every vector gives, exactly.

Trees are built once and written to the shared folder; vectors don't move. What a round gathers is one row a centroid and tree, summed in two
steps, so that no task reads more than its share of a centroid's rows. The driver holds the centroids alone (``k`` vectors).

Arithmetic is exact: components x become floor(256 x), sums are 64-bit integers, products are taken in double precision while all
stay under 2**53 and in 64-bit integers beyond. Components beyond ``MOST`` make squared distances that 64 bits can't hold: an error says so.

Defined results: vectors that are null, of another length than ``width`` or hold a null or non-finite component take no part; rows that repeat are
rows of their own; a null id is a row too, and the last to be a first centroid; first centroids that tie by id are taken in order of
their components; with fewer vectors than ``k`` there are as many centroids as vectors; of equal distances the smaller number wins; a centroid
without vectors stays where it is; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

#: Vectors of a tree, and of a leaf, at most.
TREE_ROWS, LEAF_ROWS = 8192, 32
MOST = 1 << 26
GROUPS = 64


def tree_of(q: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """A kd-tree over the rows of ``q``: the order in which the rows lie, and nodes (begin, end, right child or 0 for a leaf) in depth-first
    order, so that a left child follows its parent. Boxes are halved at the median of their longest side."""
    order, nodes, todo = np.arange(len(q)), [], [(0, len(q), -1)]
    while todo:
        begin, end, parent = todo.pop()
        if parent >= 0:
            nodes[parent][2] = len(nodes)
        own = q[order[begin:end]]
        side = own.max(axis=0) - own.min(axis=0) if end > begin else np.zeros(1)
        at = len(nodes)
        nodes.append([begin, end, 0])
        if end - begin > leaf and side.max() > 0:
            half = (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(own[:, side.argmax()], half)]
            todo.append((begin + half, end, at))
            todo.append((begin, begin + half, -1))
    return order, np.array(nodes, np.int32)


class Tree:
    """Vectors in the order of a tree, its nodes, and the boxes and sums of these."""

    def __init__(self, q: np.ndarray, nodes: np.ndarray, least: np.ndarray, most: np.ndarray, sums: np.ndarray):
        self.q, self.least, self.most, self.sums = q, least, most, sums
        self.begin, self.end, self.right = nodes.T

    @classmethod
    def build(cls, q: np.ndarray) -> tuple["Tree", np.ndarray]:
        """The tree over the rows of ``q``, and the order in which it has them."""
        order, nodes = tree_of(q)
        q = q[order]
        sums = np.concatenate([np.zeros((1, q.shape[1]), np.int64), np.cumsum(q, axis=0, dtype=np.int64)])
        least, most = (np.stack([f(q[b:e], axis=0) for b, e, _ in nodes]) for f in (np.min, np.max))
        return cls(q, nodes, least, most, sums[nodes[:, 1]] - sums[nodes[:, 0]]), order

    def pack(self) -> list[bytes]:
        nodes = np.stack([self.begin, self.end, self.right], axis=1)
        return [x.astype(kind).tobytes() for x, kind in ((self.q, "<i4"), (nodes, "<i4"), (self.least, "<i4"), (self.most, "<i4"), (self.sums, "<i8"))]

    @classmethod
    def unpack(cls, parts: list[bytes], width: int) -> "Tree":
        q, nodes, least, most, sums = (np.frombuffer(x, kind) for x, kind in zip(parts, ("<i4", "<i4", "<i4", "<i4", "<i8")))
        return cls(*(x.reshape(-1, n) for x, n in ((q, width), (nodes, 3), (least, width), (most, width), (sums, width))))

    def filter(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
        """Nodes that are assigned whole (node, centroid), and leaves with the centroid of each of their vectors."""
        size = int(max(np.abs(self.least).max(initial=0), np.abs(self.most).max(initial=0), np.abs(centroids).max(initial=0)))
        kind = np.float64 if 16 * size * size * max(1, self.q.shape[1]) < 2**53 else np.int64
        z, least, most = (x.astype(kind) for x in (centroids, self.least, self.most))
        own, beyond = (z * z).sum(axis=1), np.inf if kind is np.float64 else np.iinfo(np.int64).max
        middle = own - (least + most) @ z.T  # a squared distance to the middle of a box, less what all centroids have
        whole, resolved = [], []
        nodes, left = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
        while len(nodes):
            best = np.where(left, middle[nodes], beyond).argmin(axis=1)
            for b in np.unique(best):
                rows = np.flatnonzero(best == b)
                away = z - z[b]
                # by how much the point of the box that is best for a centroid against b is farther from it than from b
                far = own - own[b] - 2 * (most[nodes[rows]] @ np.maximum(away, 0).T + least[nodes[rows]] @ np.minimum(away, 0).T)
                gone = (far > 0) | ((far == 0) & (np.arange(len(z)) > b))
                gone[:, b] = False
                left[rows] &= ~gone
            single = left.sum(axis=1) == 1
            whole += zip(nodes[single].tolist(), left[single].argmax(axis=1).tolist())
            nodes, left = nodes[~single], left[~single]
            leaf = self.right[nodes] == 0
            for node, mask in zip(nodes[leaf].tolist(), left[leaf]):
                pick = np.flatnonzero(mask)
                part = self.q[self.begin[node] : self.end[node]].astype(kind)
                resolved.append((node, pick[(own[pick] - 2 * (part @ z[pick].T)).argmin(axis=1)]))
            inner, left = nodes[~leaf], left[~leaf]
            nodes, left = np.concatenate([inner + 1, self.right[inner].astype(np.int64)]), np.concatenate([left, left])
        return whole, resolved

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many vectors each centroid gets, and their sums."""
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        whole, resolved = self.filter(centroids)
        for node, number in whole:
            n[number] += self.end[node] - self.begin[node]
            sums[number] += self.sums[node]
        for node, numbers in resolved:
            np.add.at(n, numbers, 1)
            np.add.at(sums, numbers, self.q[self.begin[node] : self.end[node]])
        return n, sums

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, and its squared distance."""
        out = np.empty(len(self.q), np.int32)
        whole, resolved = self.filter(centroids)
        for node, number in whole:
            out[self.begin[node] : self.end[node]] = number
        for node, numbers in resolved:
            out[self.begin[node] : self.end[node]] = numbers
        return out, ((self.q.astype(np.int64) - centroids[out]) ** 2).sum(axis=1)


_COLUMNS = ("q", "nodes", "least", "most", "sums")


def _trees(own: DataFrame, width: int) -> DataFrame:
    """A row for each block of vectors: its ids in the order of its tree, and the tree."""
    kind = own.schema["id"].dataType.simpleString()

    def run(batches):
        def made(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            values = table.column("q").combine_chunks().flatten().to_numpy()
            if np.abs(values).max(initial=0) > MOST:
                raise ValueError(f"a component is beyond {MOST}: its squared distances don't fit 64 bits")
            tree, order = Tree.build(values.astype(np.int64).reshape(-1, width))
            ids = table.column("id").combine_chunks().take(pa.array(order))
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([ids, *[pa.array([x], pa.binary()) for x in tree.pack()]], names=["ids", *_COLUMNS])

        held, n = [], 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, TREE_ROWS - n)
                batch = batch.slice(len(part))
                held.append(part)
                n += len(part)
                if n == TREE_ROWS:
                    yield made(held)
                    held, n = [], 0
        if n:
            yield made(held)
        tidy()

    return own.mapInArrow(run, f"ids array<{kind}>, " + ", ".join(f"{c} binary" for c in _COLUMNS))


def _unpacked(batches, width: int):
    for batch in batches:
        for i in range(len(batch)):
            yield batch, i, Tree.unpack([batch.column(c)[i].as_py() for c in _COLUMNS], width)


def _round(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """The number of vectors of each centroid, and their sums."""
    k, width = centroids.shape

    def run(batches):
        for _, _, tree in _unpacked(batches, width):
            n, sums = tree.totals(centroids)
            some = np.flatnonzero(n)
            group = np.full(len(some), hash(tree.q[:1].tobytes()) % GROUPS, np.int32)  # any number will do
            parts = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * width, pa.int32()), pa.array(sums[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(group), pa.array(n[some]), parts], names=["cluster", "part", "n", "sums"])

    total = [F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")]
    found = trees.select(*_COLUMNS).mapInArrow(run, "cluster int, part int, n long, sums array<long>")
    return {r.cluster: (r.n, r.sums) for r in found.groupBy("cluster", "part").agg(*total).groupBy("cluster").agg(*total).collect()}


def _assigned(trees: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    kind = trees.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch, i, tree in _unpacked(batches, centroids.shape[1]):
            number, distance = tree.assign(centroids)
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(number), pa.array(distance)], names=["id", "cluster", "distance"])

    return trees.mapInArrow(run, f"id {kind}, cluster int, distance long").withColumnRenamed("id", id_col)


def quantised(vectors: DataFrame, width: int, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``q``: floor(256 x) of the vectors that take part, as doubles (they are whole numbers)."""
    v = F.col("v")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    own = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    # the filter stands in the expression, so that it can't be moved behind it
    return own.where(F.coalesce((F.size(v) == width) & F.forall(v, fine), F.lit(False))).select("id", F.transform(v, lambda x: F.when(F.abs(x) <= MOST, F.floor(x * 256).cast("double")).otherwise(x)).alias("q"))


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """id, ``cluster`` and ``distance`` (squared) of each vector after ``rounds`` rounds, and the centroids. The first centroids are the vectors with the ``k``
    smallest SHA-256 digests of ``<seed>:<id>``."""
    with Scratch(vectors.sparkSession) as run:
        own = quantised(vectors, width, id_col, vector_col)
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
        first = own.orderBy(digest.asc_nulls_last(), "q").limit(k).select("q").collect()
        trees = run.keep(_trees(own, width), "trees")
        centroids = np.array([r.q for r in first], np.float64).astype(np.int64).reshape(len(first), width)
        for _ in range(rounds if len(first) else 0):
            for number, (n, sums) in _round(trees, centroids).items():
                centroids[number] = [x // n for x in sums]
    return _assigned(trees, centroids, id_col), centroids.tolist()
