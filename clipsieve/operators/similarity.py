"""Similarity of clip embeddings: kernels, coverage, diversity, neighbours, support.

All-pairs scores are computed in blocks: the reference side is dealt out in
blocks of rows and each task holds one block of either side as matrices, so no
pair becomes a row. Mean cosines come from a sum of unit vectors, and kernel means
and nearest distances of many short vectors from ``lowdim``, in time that grows
with the rows. Other scores take their reference as given: ``reference_sample``
draws a bounded one, which keeps the work linear in the rows; against all rows it
is quadratic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lowdim
from .normalize import EPS, unit_interval
from .ordering import quantiles
from .stored import stored

BLOCK = 2048


def reference_sample(rows: DataFrame, most: int = 4096, seed: int = 42) -> DataFrame:
    """All rows, or ``most`` of them by a hash of seed and id."""
    return rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), float)


def _blocks(left: DataFrame, right: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``of(left ids, left vectors, right ids, right vectors)`` for every pair of blocks of ``id, vec`` tables."""
    n = max(1, -(-left.count() // BLOCK)), max(1, -(-right.count() // BLOCK))
    a = left.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n[0])).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n[1] - 1).cast("long"))).alias("b"))
    b = right.select("id", "vec").toDF("id", "vec").select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n[1])).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n[0] - 1).cast("long"))).alias("a"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return of(x["id"].to_numpy(), _matrix(x["vec"]), y["id"].to_numpy(), _matrix(y["vec"]))

    return a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(meet, schema)


def _many(rows: DataFrame, reference: DataFrame) -> np.ndarray | None:
    """The extent of short vectors whose pairs are too many for blocks; None otherwise."""
    return lowdim.extent(rows, reference) if rows.count() * reference.count() >= lowdim.PAIRS else None


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0.0)


def mean_affinity(rows: DataFrame, reference: DataFrame, sigma: float) -> DataFrame:
    """``id, affinity``: mean of exp(-d^2 / 2 sigma^2) to all reference rows."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    if (bounds := _many(rows, reference)) is not None and (axes := lowdim.lines(bounds, sigma)) is not None:
        return lowdim.mean_kernel(rows, reference, axes)

    def of(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"id": i, "total": np.exp(-squared_distances(x, y) / (2 * sigma**2)).sum(1), "n": len(j)})

    return _blocks(rows, reference, of, "id long, total double, n long").groupBy("id").agg((F.sum("total") / F.sum("n")).alias("affinity"))


def mmd_squared(rows: DataFrame, subset: DataFrame, sigma: float) -> DataFrame:
    """One row, ``mmd2``: the biased estimate from three kernel means, at least 0."""
    mean = lambda a, b, name: mean_affinity(a, b, sigma).agg(F.avg("affinity").alias(name))
    joined = mean(rows, rows, "rr").crossJoin(mean(subset, subset, "ss")).crossJoin(mean(rows, subset, "rs"))
    return joined.select(F.greatest(F.col("rr") + F.col("ss") - 2 * F.col("rs"), F.lit(0.0)).alias("mmd2"))


def single_coverage(rows: DataFrame, reference: DataFrame, sigma: float) -> DataFrame:
    """``id, coverage``: exp(-MMD^2) of each row as a subset of its own."""
    own = mean_affinity(reference, reference, sigma).agg(F.avg("affinity").alias("rr"))
    return mean_affinity(rows, reference, sigma).crossJoin(F.broadcast(own)).select("id", F.exp(-F.greatest(F.col("rr") + 1 - 2 * F.col("affinity"), F.lit(0.0))).alias("coverage"))


def nearest(rows: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """``id, other, value, r``: the k nearest other rows (by distance, or by cosine), ties to the smaller id; self is left out by id."""
    def of(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        if metric == "cosine":
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), EPS)
            value = -(unit(x) @ unit(y).T)
        else:
            value = np.stack([np.sqrt(((y - row) ** 2).sum(1)) for row in x])
        value[i[:, None] == j[None]] = np.inf
        n = min(k, len(j))
        order = np.argsort(j, kind="stable")
        best = order[np.argsort(value[:, order], axis=1, kind="stable")[:, :n]]
        out = pd.DataFrame({"id": np.repeat(i, n), "other": j[best].ravel(), "value": np.take_along_axis(value, best, 1).ravel()})
        return out[np.isfinite(out["value"])]

    found = _blocks(rows, rows, of, "id long, other long, value double")
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("value", "other"))).filter(F.col("r") <= k)
    return ranked.withColumn("value", -F.col("value")) if metric == "cosine" else ranked


def nearest_values(rows: DataFrame, k: int) -> DataFrame:
    """``id, values``: distances to the k nearest other rows, ascending; rows without any are left out."""
    if _many(rows, rows) is not None:
        return lowdim.nearest_values(rows, k).filter(F.size("values") > 0)
    return nearest(rows, k).groupBy("id").agg(F.array_sort(F.collect_list("value")).alias("values"))


def novelty(rows: DataFrame, k: int = 20) -> DataFrame:
    """``id, novelty_raw, novelty``: mean distance to the k nearest others, then between quantiles; 0 for a single row."""
    mean = F.aggregate("values", F.lit(0.0), lambda s, x: s + x) / F.size("values")
    every = stored(rows.select("id").join(nearest_values(rows, k).select("id", mean.alias("novelty_raw")), "id", "left").withColumn("novelty_raw", F.coalesce("novelty_raw", F.lit(0.0))))
    return unit_interval(every, "novelty_raw", "novelty")


def support(rows: DataFrame, k: int, mode: str = "exponential") -> DataFrame:
    """``id, support`` from the k-th neighbour's distance d: exp(-d / median d), or the share of the k within the median radius (and itself)."""
    found = stored(nearest_values(rows, k).select("id", F.array_max("values").alias("far"), F.col("values").alias("all")))
    median = quantiles(found, "far", (0.5,)).withColumnRenamed("q0", "mid")
    joined = found.crossJoin(F.broadcast(median))
    if mode == "exponential":
        value = F.exp(-F.col("far") / (F.col("mid") + EPS))
    else:
        value = (F.size(F.filter("all", lambda d: d <= F.col("mid"))) + 1) / (F.size("all") + 1)
    return rows.select("id").join(joined.select("id", value.alias("support")), "id", "left").withColumn("support", F.coalesce("support", F.lit(1.0)))


def diversity(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """``id, diversity``: one less the mean scaled cosine ((cos + 1) / 2) to the reference rows other than itself; 0 without any.

    A row's cosines add up to its product with the sum of all unit vectors, less those of its own id.
    """
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"dim": range(-1, len(batch["vec"].iloc[0])), "total": np.append(float(len(batch)), _units(_matrix(batch["vec"])).sum(0))})

    whole = {r["dim"]: r["total"] for r in reference.select("vec").mapInPandas(sums, "dim int, total double").groupBy("dim").agg(F.sum("total").alias("total")).collect()}
    n, direction = int(whole.pop(-1, 0)), np.array([whole[k] for k in sorted(whole)])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            unit = _units(_matrix(batch["vec"]))
            own = np.array([0.0 if o is None else float((_units(np.stack(o)) @ u).sum()) for u, o in zip(unit, batch["own"], strict=True)])
            others = n - np.array([0 if o is None else len(o) for o in batch["own"]])
            cosine = (unit @ direction if n else np.zeros(len(unit))) - own
            yield pd.DataFrame({"id": batch["id"], "diversity": np.where(others > 0, 1 - (cosine / np.maximum(others, 1) + 1) / 2, 0.0)})

    mine = reference.groupBy("id").agg(F.collect_list("vec").alias("own"))
    return rows.select("id", "vec").join(mine, "id", "left").mapInPandas(score, "id long, diversity double")


def subset_diversity(rows: DataFrame) -> DataFrame:
    """One row, ``diversity``: one less the mean scaled cosine over all pairs, from the length of the sum of unit vectors."""
    wide = rows.select("id", F.posexplode("vec").alias("dim", "x"))
    length = wide.groupBy("id").agg(F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(EPS)).alias("l"))
    sums = wide.join(length, "id").groupBy("dim").agg(F.sum(F.col("x") / F.col("l")).alias("s"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    own = length.join(wide, "id").agg(F.sum((F.col("x") / F.col("l")) ** 2).alias("own"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    cosine = (F.col("q") - F.col("own")) / 2 / pairs
    return sums.agg(F.sum(F.col("s") ** 2).alias("q")).crossJoin(n).crossJoin(own).select(F.when(F.col("n") < 2, 0.0).otherwise(1 - (cosine + 1) / 2).alias("diversity"))


def median_sigma(rows: DataFrame, seed: int = 42, most_rows: int = 4096, most_pairs: int = 100_000) -> float:
    """The median distance of random pairs of a bounded sample (1 for fewer than two rows or if all are equal)."""
    n = rows.count()
    some = rows.orderBy("id") if n <= most_rows else rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most_rows)
    x = _matrix(some.select("vec").toPandas()["vec"]) if n else np.zeros((0, 1))
    if len(x) < 2:
        return 1.0
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, len(x), most_pairs), rng.integers(0, len(x), most_pairs)
    d = np.linalg.norm(x[i[i != j]] - x[j[i != j]], axis=1)
    d = d[d > EPS]
    return float(np.median(d)) if len(d) else 1.0


def combined(rows: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    """A weighted sum of score columns, clipped to [0, 1]."""
    total = sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return rows.withColumn(out, F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def within(rows: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """``id, other, cosine``: all pairs of unlike ids whose cosine is at least the threshold, cut to [0, 1]."""
    def of(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        cosine = _units(x) @ _units(y).T
        a, b = np.nonzero((cosine >= threshold) & (i[:, None] != j[None]))
        return pd.DataFrame({"id": i[a], "other": j[b], "cosine": np.clip(cosine[a, b], 0.0, 1.0)})

    return _blocks(rows, others, of, "id long, other long, cosine double")


def penalties(rows: DataFrame, chosen: DataFrame, threshold: float, scale: float = 1.0) -> DataFrame:
    """``id, penalty, near``: over the ``chosen`` rows from the threshold on, both reliabilities times the cosine beyond it (as a share of what can be beyond).

    Both tables have ``id, vec, reliability``. Pairs are summed within a block, so a row a block is all that is shuffled.
    """
    if not 0 <= threshold < 1 or scale <= 0:
        raise ValueError("the threshold must be in [0, 1) and the scale positive")

    def of(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        cosine = np.minimum(_units(x[:, :-1]) @ _units(y[:, :-1]).T, 1.0)
        near = (cosine >= threshold) & (i[:, None] != j[None])
        beyond = np.where(near, (cosine - threshold) / max(1 - threshold, EPS), 0.0)
        return pd.DataFrame({"id": i, "penalty": x[:, -1] * (beyond @ y[:, -1]), "near": near.sum(1)})

    wide = lambda t: t.select("id", F.concat(F.col("vec").cast("array<double>"), F.array(F.col("reliability").cast("double"))).alias("vec"))
    sums = _blocks(wide(rows), wide(chosen), of, "id long, penalty double, near long").groupBy("id").agg(F.sum("penalty").alias("penalty"), F.sum("near").alias("near"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("id").join(sums, "id", "left").select("id", (F.coalesce("penalty", F.lit(0.0)) / scale).alias("penalty"), none("near"))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)
