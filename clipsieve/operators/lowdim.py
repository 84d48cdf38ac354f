"""Kernel means and nearest distances of vectors of few dimensions, without meeting all pairs.

A Gaussian is interpolated at Chebyshev nodes, as many a dimension as double
precision asks for, so sums over a table are moments at the nodes. Neighbours
are exact: points lie in the leaves of a tree of half spaces, and a point meets
its own leaf and those that the ball of its k-th neighbour found there reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored

#: Dimensions, and nodes of an interpolation, at most; pairs from which on all-pairs blocks are left for these ways.
WIDTH, NODES, PAIRS = 4, 200_000, 10**8
#: Distinct points of a leaf, leaves of a tree at most, and points a leaf that a tree is made from.
LEAF, LEAVES, SAMPLED = 2000, 4096, 16


def extent(*tables: DataFrame) -> np.ndarray | None:
    """Each dimension's least and largest value over ``vec`` of the tables; None if vectors are wide, of unlike width, empty or not finite."""
    found = []
    for t in tables:
        fine = F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        row = t.agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b"), F.max((~fine).cast("int")).alias("bad"),
                    *[f(F.try_element_at("vec", F.lit(k + 1))) for k in range(WIDTH) for f in (F.min, F.max)]).first()
        if row["a"] is None or row["a"] != row["b"] or row["bad"] or not 1 <= row["a"] <= WIDTH:
            return None
        found.append(np.array([row[3 + 2 * k : 5 + 2 * k] for k in range(row["a"])], float))
    if len({len(x) for x in found}) != 1:
        return None
    return np.column_stack([np.min([x[:, 0] for x in found], axis=0), np.max([x[:, 1] for x in found], axis=0)])


@dataclass(frozen=True)
class Line:
    """Interpolation of exp(-(x - y)^2 / 2 sigma^2) in y over an interval."""

    nodes: np.ndarray
    weights: np.ndarray
    sigma: float

    def basis(self, y: np.ndarray) -> np.ndarray:
        """The nodes' Lagrange polynomials at ``y``, by the barycentric formula."""
        apart = y[:, None] - self.nodes[None]
        hit = apart == 0
        terms = self.weights / np.where(hit, 1.0, apart)
        out = terms / terms.sum(1, keepdims=True)
        exact = hit.any(1)
        out[exact] = hit[exact]
        return out

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-((x[:, None] - self.nodes[None]) ** 2) / (2 * self.sigma**2))


def line(low: float, high: float, sigma: float, most: int = NODES) -> Line | None:
    """As few nodes as interpolate the kernel to 1e-13 anywhere between the ends; None if that takes more than ``most``."""
    n = 2
    while n <= most:
        at = np.cos((2 * np.arange(n) + 1) * np.pi / (2 * n))
        got = Line((low + high) / 2 + (high - low or 1.0) / 2 * at, (-1.0) ** np.arange(n) * np.sin((2 * np.arange(n) + 1) * np.pi / (2 * n)), sigma)
        grid = np.linspace(low, high, 4 * n + 3)
        if np.abs(got.kernel(grid) @ got.basis(grid).T - np.exp(-((grid[:, None] - grid[None]) ** 2) / (2 * sigma**2))).max() < 1e-13:
            return got
        if n > 512:
            return None
        n = n + max(1, n // 6)
    return None


def lines(bounds: np.ndarray, sigma: float) -> list[Line] | None:
    out: list[Line] = []
    for low, high in bounds:
        if (found := line(low, high, sigma)) is None:
            return None
        out.append(found)
    return out if np.prod([len(x.nodes) for x in out]) <= NODES else None


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), float)


def _rest(parts: list[np.ndarray]) -> np.ndarray:
    """Row by row products of all columns of the parts (one column of ones without any)."""
    out = np.ones((len(parts[0]) if parts else 0, 1))
    for p in parts:
        out = (out[:, :, None] * p[:, None, :]).reshape(len(p), -1)
    return out


def mean_kernel(rows: DataFrame, reference: DataFrame, axes: list[Line]) -> DataFrame:
    """``id, affinity``: the kernel's mean over the reference rows. What the driver holds is a number a node, NODES at most."""
    size = int(np.prod([len(a.nodes) for a in axes]))
    chunk = 2048

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((len(axes[0].nodes), size // len(axes[0].nodes))), 0
        for batch in batches:
            x = _matrix(batch["vec"])
            n += len(x)
            for lo in range(0, len(x), chunk):
                some = [a.basis(x[lo : lo + chunk, k]) for k, a in enumerate(axes)]
                total += some[0].T @ (_rest(some[1:]) if len(some) > 1 else np.ones((len(some[0]), 1)))
        if n:
            yield pd.DataFrame({"cell": np.arange(-1, size), "total": np.append(float(n), total.ravel())})

    sums = reference.select("vec").mapInPandas(moments, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).toPandas()
    values = np.zeros(size + 1)
    values[sums["cell"].to_numpy() + 1] = sums["total"].to_numpy()
    mean = (values[1:] / max(values[0], 1.0)).reshape(len(axes[0].nodes), -1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, out = _matrix(batch["vec"]), [np.zeros(0)]
            for lo in range(0, len(x), chunk):
                some = [a.kernel(x[lo : lo + chunk, k]) for k, a in enumerate(axes)]
                out.append(((some[0] @ mean) * (_rest(some[1:]) if len(some) > 1 else 1.0)).sum(1))
            yield pd.DataFrame({"id": batch["id"], "affinity": np.concatenate(out)})

    return rows.select("id", "vec").mapInPandas(score, "id long, affinity double")


@dataclass(frozen=True)
class Cuts:
    """A tree of half spaces: dimension and value of each cut, the two nodes below it, the leaf's number or -1."""

    dim: list[int]
    cut: list[float]
    below: list[tuple[int, int]]
    leaf: list[int]

    def reach(self, x: np.ndarray, r: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves that meet: each row's own leaf or, with radii, every leaf that its ball may reach."""
        rows, leaves, stack = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(0, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if self.leaf[node] >= 0:
                rows.append(at)
                leaves.append(np.full(len(at), self.leaf[node]))
                continue
            v = x[at, self.dim[node]]
            left = v <= self.cut[node] if r is None else v - r[at] <= self.cut[node]
            right = ~left if r is None else v + r[at] >= self.cut[node]
            stack += [(self.below[node][0], at[left]), (self.below[node][1], at[right])]
        return np.concatenate(rows), np.concatenate(leaves)


def cuts(x: np.ndarray, leaves: int) -> Cuts:
    """Cuts at medians of the widest dimension, until a leaf has its share of the sample ``x``."""
    dim, cut, below, leaf, stack, n = [0], [0.0], [(0, 0)], [-1], [(0, np.arange(len(x)))], 0
    while stack:
        node, at = stack.pop()
        spread = np.ptp(x[at], axis=0) if len(at) else np.zeros(x.shape[1])
        d = int(spread.argmax())
        if len(at) <= max(1, len(x) // max(1, leaves)) or spread[d] == 0:
            leaf[node], n = n, n + 1
            continue
        v = x[at, d]
        value = np.median(v)
        if not (v > value).any():
            value = v[v < value].max()
        dim[node], cut[node], below[node] = d, float(value), (len(dim), len(dim) + 1)
        for part in (at[v <= value], at[v > value]):
            stack.append((len(dim), part))
            dim.append(0)
            cut.append(0.0)
            below.append((0, 0))
            leaf.append(-1)
    return Cuts(dim, cut, below, leaf)


def _least(x: np.ndarray, own: np.ndarray | None, y: np.ndarray, times: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of ``x`` the k least distances to rows of ``y``, each as often as it stands; ``own``: the row's place in y, which counts once less."""
    out: list[np.ndarray] = []
    for lo in range(0, len(x), 256):
        some = x[lo : lo + 256]
        d2 = np.zeros((len(some), len(y)))
        for c in range(x.shape[1]):
            d2 += (some[:, c, None] - y[None, :, c]) ** 2
        n = min(k + 1, len(y))
        near = np.argpartition(d2, n - 1, axis=1)[:, :n] if n < len(y) else np.tile(np.arange(n), (len(some), 1))
        if own is not None:  # the row itself is among its nearest, whatever ties there are
            mine = own[lo : lo + 256]
            lost = ~(near == mine[:, None]).any(1)
            near[lost, -1] = mine[lost]
        value = np.take_along_axis(d2, near, 1)
        order = np.argsort(value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, 1), np.sqrt(np.take_along_axis(value, order, 1))
        often = np.minimum(times[near], k + 1)
        if own is not None:
            often = often - (near == mine[:, None])
        out += [np.repeat(v, o)[:k] for v, o in zip(value, often, strict=True)]
    return out


def nearest_values(rows: DataFrame, k: int) -> DataFrame:
    """``id, values``: the distances of the k nearest other rows, ascending (fewer, if there are fewer).

    Equal vectors are one point with a number, so copies don't fill a leaf. No
    task holds more than a leaf and the points whose balls reach it.
    """
    points = stored(rows.groupBy("vec").agg(F.count(F.lit(1)).alias("times")))
    leaves = min(LEAVES, max(1, points.count() // LEAF))
    sample = _matrix(points.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLED * leaves).toPandas()["vec"])
    tree = cuts(sample, leaves)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, leaf = tree.reach(_matrix(batch["vec"]))
            yield batch.iloc[at].assign(leaf=leaf)

    def own(part: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(part["vec"])
        return part.assign(near=_least(x, np.arange(len(x)), x, part["times"].to_numpy(), k))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            r = np.array([v[k - 1] if len(v) >= k else np.inf for v in batch["near"]]) * (1 + 1e-9)
            at, leaf = tree.reach(_matrix(batch["vec"]), r)
            other = leaf != batch["leaf"].to_numpy()[at]
            yield pd.DataFrame({"leaf": leaf[other], "vec": batch["vec"].to_numpy()[at[other]], "r": r[at[other]]})

    def beyond(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(part):
            return pd.DataFrame({"vec": [], "near": []}, dtype=object)
        found = [v[v <= r] for v, r in zip(_least(_matrix(asked["vec"]), None, _matrix(part["vec"]), part["times"].to_numpy(), k), asked["r"], strict=True)]
        some = np.array([len(v) > 0 for v in found])
        return pd.DataFrame({"vec": asked["vec"].to_numpy()[some], "near": pd.Series([v for v in found if len(v)], dtype=object)})

    placed = stored(points.mapInPandas(place, "vec array<double>, times long, leaf long"))
    first = stored(placed.groupBy("leaf").applyInPandas(own, "vec array<double>, times long, leaf long, near array<double>"))
    asked = first.select("vec", "leaf", "near").mapInPandas(visit, "leaf long, vec array<double>, r double")
    more = asked.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInPandas(beyond, "vec array<double>, near array<double>")
    whole = first.select("vec", "near").unionByName(more).groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("values"))
    return rows.select("id", "vec").join(whole, "vec").select("id", "values")
