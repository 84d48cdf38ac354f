"""Approximate nearest neighbours (largest inner product) by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is put into a leaf. A query
walks the tree best bin first: a priority queue holds nodes by the largest inner
product that they can hold (with the node's centre, plus its radius times the
query's length). The number of leaves visited is widened until the recall on
calibration queries, measured against all vectors, is reached.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Vectors on which the tree is fitted, at most (in expectation).
FIT_ROWS = 20_000
#: Children of a node, and the leaves that a tree may have at most (2 MB of centres for 64 dimensions).
FANOUT, MAX_LEAVES = 8, 4096
#: Leaves for each root of the number of rows, so that leaves and rows of a leaf grow alike.
LEAF_SHARE = 0.25
#: Queries on which the width of the search is calibrated, and the recall to reach there.
CALIBRATE, RECALL = 64, 0.95
#: Bundles of leaves; vectors, and queries, of a bundle that one task meets at once (larger bundles are cut).
BUNDLES, CHUNK, QUERIES = 32, 8192, 2048


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: centres, radii (of all vectors below), children (first, last) and the leaf's number or -1."""

    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child's at every level."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[at] < 0)
            if not len(inner):
                return self.leaf[at]
            for node in np.unique(at[inner]):
                rows = inner[at[inner] == node]
                c = self.centres[self.first[node] : self.last[node]]
                at[rows] = self.first[node] + np.argmin((c * c).sum(1) - 2.0 * (x[rows] @ c.T), axis=1)

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves, the most promising bin first."""
        length = float(np.sqrt(q @ q))
        queue, out = [(0.0, 0)], []
        while queue and len(out) < leaves:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                continue
            a, b = self.first[node], self.last[node]
            bound = self.centres[a:b] @ q + self.radii[a:b] * length
            for k in range(b - a):
                heapq.heappush(queue, (-float(bound[k]), int(a + k)))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres (non-empty ones) and the assignment, by Lloyd's rounds from random distinct rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= 1:
        return distinct, np.zeros(len(x), np.int64)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2.0 * (x @ centres.T), axis=1)
        used = np.unique(near)
        moved = np.stack([x[near == u].mean(0) for u in used])
        if moved.shape == centres.shape and np.allclose(moved, centres):
            break
        centres = moved
    return centres, np.argmin((centres * centres).sum(1) - 2.0 * (x @ centres.T), axis=1)


def fit_tree(x: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    """A tree of about ``leaves`` leaves over the sample ``x``; radii are the sample's until ``widen`` is applied."""
    rng = np.random.default_rng(seed)
    centres, first, last, leaf = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [0], [0], [-1]
    size = max(2, len(x) // max(1, leaves))
    queue, n = [(0, np.arange(len(x)))], 0
    while queue:
        node, rows = queue.pop(0)
        parts = _kmeans(x[rows], FANOUT, rng) if len(rows) > size and n + len(queue) < MAX_LEAVES - FANOUT else None
        if parts is None or len(parts[0]) < 2:
            leaf[node], n = n, n + 1
            continue
        first[node], last[node] = len(centres), len(centres) + len(parts[0])
        for k, c in enumerate(parts[0]):
            centres.append(c)
            first.append(0)
            last.append(0)
            leaf.append(-1)
            queue.append((first[node] + k, rows[parts[1] == k]))
    return Tree(np.array(centres), np.zeros(len(centres)), np.array(first), np.array(last), np.array(leaf))


def widen(tree: Tree, leaf_radii: np.ndarray) -> Tree:
    """Radii for all vectors: each leaf's is measured, an inner node's covers its children's balls."""
    radii = np.zeros(len(tree.leaf))
    for node in range(len(radii) - 1, -1, -1):
        if tree.leaf[node] >= 0:
            radii[node] = leaf_radii[tree.leaf[node]]
        else:
            a, b = tree.first[node], tree.last[node]
            radii[node] = max((np.linalg.norm(tree.centres[a:b] - tree.centres[node], axis=1) + radii[a:b]).max(), 0.0)
    return Tree(tree.centres, radii, tree.first, tree.last, tree.leaf)


def clean_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v`` (doubles) of the rows that take part: id and vector not null, all components finite, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0.0)
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the queries ``q`` the k rows of ``x`` with the largest inner product, ties to the smaller id, without the row numbered ``own``.

    Gives three arrays: the query's place, the row's place, the product. The
    product of a pair is always summed in the same order, so that equal vectors
    tie exactly; matrix products only preselect, with a margin.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    n = min(k, len(x))
    for lo in range(0, len(q) if n else 0, 256):
        some = q[lo : lo + 256]
        rough = some @ x.T
        rough[own[lo : lo + 256, None] == rows[None, :]] = -np.inf
        least = np.partition(rough, len(x) - n, axis=1)[:, len(x) - n]
        margin = 1e-9 * (np.abs(np.where(np.isfinite(least), least, 0.0)) + np.sqrt((some * some).sum(1)))
        at, to = np.nonzero((rough >= (least - margin)[:, None]) & (rough > -np.inf))
        exact = (some[at] * x[to]).sum(axis=1)
        order = np.lexsort((rows[to], ids[to], -exact, at))
        at, to, exact = at[order], to[order], exact[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append((at[first] + lo, to[first], exact[first]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(table: DataFrame, scratch: Scratch, k: int = 20, step: int = 20, recall: float = RECALL,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of every row whose id is divisible by ``step``.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without id or of another width than the commonest. Fewer
    candidates give fewer rows; an empty table none. Rows that repeat an id are
    queries of their own, each with all other rows as candidates, and share
    ``query_id``. Other columns are not read.

    The tree is fitted on a bounded sample (FIT_ROWS), but every vector is
    indexed. Queries and vectors meet by leaf, the leaves dealt to BUNDLES: a
    bundle of more than CHUNK vectors or QUERIES queries is cut by hashes of their
    rows, and each part of the one meets each of the other, so neither copies of
    one vector nor a leaf that all queries visit are one task's burden. Each part
    returns k rows a query, however many of its leaves the query visits; the k
    best of them are the result.
    """
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    vectors = scratch.write(clean_vectors(table, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    widths = vectors.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if not widths:
        return table.sparkSession.createDataFrame([], schema)
    width, rows = widths["w"], widths["count"]
    vectors = vectors.filter(F.size("v") == width)
    spread = F.crc32(F.md5(F.concat_ws(":", "id", "row")))
    sample = vectors.filter(spread < int(2**32 * min(1.0, FIT_ROWS / rows))).orderBy("id", "row").toPandas()
    tree = fit_tree(np.array(sample["v"].to_list(), float).reshape(-1, width), min(MAX_LEAVES, max(2, int(LEAF_SHARE * rows**0.5))))
    placed = scratch.write(_placed(vectors, tree, width), "placed")
    tree = widen(tree, _radii(placed, tree))
    asked = placed.filter(F.col("id") % step == 0).select("id", "v", "row")
    wide = _calibrate(placed, asked.orderBy(F.crc32(F.md5(F.concat_ws(":", "id", "row"))), "row").limit(CALIBRATE).toPandas(), tree, width, k, recall)
    return _meet(placed, asked, tree, wide, width, k, schema)


_VECTOR = [T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("row", T.LongType())]


def _placed(vectors: DataFrame, tree: Tree, width: int) -> DataFrame:
    """``id, v, row, leaf, far``: each vector's leaf and its distance from the leaf's centre."""
    schema = T.StructType([*_VECTOR, T.StructField("leaf", T.LongType()), T.StructField("far", T.DoubleType())])
    centre = np.zeros((tree.leaves, width))
    at = np.flatnonzero(tree.leaf >= 0)
    centre[tree.leaf[at]] = tree.centres[at]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            leaf = tree.place(x)
            far = np.linalg.norm(x - centre[leaf], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64()), pa.array(far, pa.float64())], schema.names)

    return vectors.select("id", "v", "row").mapInArrow(rows, schema)


def _radii(placed: DataFrame, tree: Tree) -> np.ndarray:
    """Each leaf's radius (at most MAX_LEAVES rows)."""
    radii = np.zeros(tree.leaves)
    for r in placed.groupBy("leaf").agg(F.max("far").alias("far")).collect():
        radii[r["leaf"]] = r["far"]
    return radii


def _calibrate(placed: DataFrame, queries: pd.DataFrame, tree: Tree, width: int, k: int, recall: float) -> int:
    """The least number of leaves (growing by a quarter, then all) at which the calibration queries' recall is reached.

    Their true neighbours come from all vectors: every task returns the k
    nearest of its rows for each of the few queries, with the leaf they lie in.
    """
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("leaf", T.LongType())])
    q, own = np.array(queries["v"].to_list(), float).reshape(-1, width), queries["row"].to_numpy(np.int64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            ids, leaf = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            at, to, score = nearest(q, own, _matrix(batch.column(1), width), ids, batch.column(2).to_numpy(), k)
            found = (at, ids[to], score, leaf[to])
            held = found if held is None else tuple(np.concatenate(c) for c in zip(held, found, strict=True))
            order = np.lexsort((held[1], -held[2], held[0]))
            held = tuple(c[order] for c in held)
            first = np.arange(len(held[0])) - np.searchsorted(held[0], held[0]) < k
            held = tuple(c[first] for c in held)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], schema.names)

    found = placed.select("id", "v", "row", "leaf").mapInArrow(best, schema).toPandas().sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k)
    if not len(found):
        return 1
    place = np.full(len(found), tree.leaves)
    for j in range(len(own)):
        order = {leaf: r for r, leaf in enumerate(tree.visit(q[j], tree.leaves))}
        mine = (found["q"] == j).to_numpy()
        place[mine] = [order[x] for x in found["leaf"].to_numpy()[mine]]
    wide = 1
    while wide < tree.leaves and (place < wide).mean() < recall:
        wide = max(wide + 1, wide * 5 // 4)
    return min(wide, tree.leaves)


def _meet(placed: DataFrame, asked: DataFrame, tree: Tree, wide: int, width: int, k: int, schema: T.StructType) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        """A row for each query and bundle, with the leaves of it that the query visits."""
        for batch in batches:
            at, bundle, leaves = [], [], []
            for n, q in enumerate(_matrix(batch.column(1), width)):
                found = np.array(tree.visit(q, wide), np.int64)
                for b in np.unique(found % BUNDLES).tolist():
                    at.append(n)
                    bundle.append(b)
                    leaves.append(found[found % BUNDLES == b])
            bundle = pa.array(bundle, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(leaves, pa.list_(pa.int64())), bundle], [*batch.schema.names, "leaves", "bundle"]) if whole else pa.RecordBatch.from_arrays([bundle], ["bundle"])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = (_matrix(side.column("v").combine_chunks(), width) if side.num_rows else np.zeros((0, width)) for side in (left, right))
        own, ids, rows, leaf = left.column("row").to_numpy(), right.column("id").to_numpy(), right.column("row").to_numpy(), right.column("leaf").to_numpy()
        lists = left.column("leaves").to_pylist()
        asks, visited = np.repeat(np.arange(len(lists)), [len(y) for y in lists]), np.array([y for z in lists for y in z], np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for one in np.unique(leaf):
            some, mine = asks[visited == one], np.flatnonzero(leaf == one)
            at, to, score = nearest(q[some], own[some], x[mine], ids[mine], rows[mine], k)
            found.append((some[at], mine[to], score))
        at, to, score = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((rows[to], ids[to], -score, at))
        at, to, score = at[order], to[order], score[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        at, to, score = at[first], to[first], score[first]
        return pa.table({"query_id": pa.array(left.column("id").to_numpy()[at], pa.int64()), "query": pa.array(own[at], pa.int64()), "vec_id": pa.array(ids[to], pa.int64()),
                         "row": pa.array(rows[to], pa.int64()), "score": pa.array(score, pa.float64())})

    bundle = T.StructField("bundle", T.LongType())
    parts = lambda most: F.ceil(F.count(F.lit(1)) / most).cast("int")
    placed = placed.withColumn("bundle", F.col("leaf") % BUNDLES)
    visits = asked.mapInArrow(lambda b: walk(b, False), T.StructType([bundle])).groupBy("bundle").agg(parts(QUERIES).alias("lots"))
    sizes = F.broadcast(placed.groupBy("bundle").agg(parts(CHUNK).alias("parts")).join(visits, "bundle"))  # BUNDLES rows at most
    vectors = placed.join(sizes, "bundle").select("id", "v", "row", "leaf", "bundle", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    queries = asked.mapInArrow(lambda b: walk(b, True), T.StructType([*_VECTOR, T.StructField("leaves", T.ArrayType(T.LongType())), bundle])).join(sizes, "bundle").select(
        "id", "v", "row", "leaves", "bundle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("row"), F.col("lots")).cast("int").alias("lot"))
    met = queries.groupBy("bundle", "part", "lot").cogroup(vectors.groupBy("bundle", "part", "lot")).applyInArrow(block, "query_id long, query long, vec_id long, row long, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
