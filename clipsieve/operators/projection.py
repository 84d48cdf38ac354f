"""Projections of clip embeddings: principal components, random relation features, soft prototypes, window means.

Fits need sums over all rows only (made where the rows are); what comes to the
driver is a matrix of the features' width squared. Rows are projected in Arrow
batches by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import EPS


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def map_rows(rows: DataFrame, column: str, out: str, of, keep: Sequence[str]) -> DataFrame:
    """``keep`` and, as ``out``, what ``of`` (matrix to matrix) makes of the list column, a batch at a time."""
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(of(_matrix(batch.column(len(keep)))))], schema.names)

    return rows.select(*keep, column).mapInArrow(each, schema)


@dataclass(frozen=True)
class Components:
    """Mean and scale of each dimension, the components (rows) and their shares of the variance."""

    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray, size: int, unit: bool) -> np.ndarray:
        y = (x - self.mean) / self.scale @ self.components.T
        y = np.pad(y, ((0, 0), (0, size - y.shape[1])))
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), EPS) if unit else y


def fit_components(rows: DataFrame, column: str, size: int) -> Components:
    """Principal components of all rows, standardised by the population deviation (below 1e-8: 1).

    Each task sends its count, sums and products; rounding is kept small by
    taking a first row off. Of a component and its opposite, the one whose
    largest entry is positive is given.
    """
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("sums", T.BinaryType()), T.StructField("products", T.BinaryType())])
    some = rows.select(column).first()
    if some is None:
        raise ValueError("there are no rows to fit")
    origin = np.asarray(some[0], float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(len(origin)), np.zeros((len(origin), len(origin)))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)) - origin
                n, total, products = n + len(x), total + x.sum(0), products + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())], schema.names)

    n, total, products = 0, 0.0, 0.0
    for r in rows.select(column).mapInArrow(sums, schema).toLocalIterator():
        n, total = n + r["n"], total + np.frombuffer(r["sums"])
        products = products + np.frombuffer(r["products"]).reshape(len(origin), -1)
    mean = total / n
    covariance = products / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(covariance), 0.0))
    scale[scale < 1e-8] = 1.0
    values, vectors = np.linalg.eigh(covariance / np.outer(scale, scale))
    k = min(size, len(origin), max(1, n - 1))
    order = np.argsort(-values, kind="stable")[:k]
    parts = vectors[:, order].T
    parts = parts * np.sign(parts[np.arange(k), np.abs(parts).argmax(1)])[:, None]
    every = np.maximum(values, 0.0).sum() or 1.0
    return Components(mean + origin, scale, parts, np.maximum(values[order], 0.0) / every)


def project(rows: DataFrame, column: str, out: str, fitted: Components, size: int, keep: Sequence[str], unit: bool = False) -> DataFrame:
    """``keep`` and ``out``: the rows on the components, padded with zeros to ``size``; with ``unit`` then of length 1."""
    return map_rows(rows, column, out, lambda x: fitted.project(x, size, unit), keep)


#: Pairs of sequences whose products are taken, at each lag.
RELATIONS = (("visual", "visual"), ("state", "state"), ("action", "action"), ("visual", "action"), ("state", "action"), ("delta_visual", "action"), ("delta_state", "action"))
LAGS = (0, 1, 2, 4)


def random_projections(widths: dict[str, int], size: int = 32, seed: int = 42) -> dict[str, np.ndarray]:
    """A Gaussian matrix for each sequence, drawn one after another from one generator."""
    rng = np.random.default_rng(seed)
    return {name: rng.standard_normal((width, size)) / np.sqrt(float(size)) for name, width in widths.items()}


def relation_features(clip_frames: DataFrame, visual: str, state: str, action: str, size: int = 32, lags: Sequence[int] = LAGS, seed: int = 42) -> DataFrame:
    """``sample_id, relation``: first-order statistics of six projected sequences, and mean products of pairs at lags.

    Frames are projected where they are (visual ones normalised first). Then one
    ordered group a clip, which is short, gives mean, population deviation and
    last less first of each sequence and of its steps, and the products.
    """
    first = clip_frames.select(F.size(visual), F.size(state), F.size(action)).first()
    if first is None:
        return clip_frames.select("sample_id", F.lit(None).cast("array<double>").alias("relation")).limit(0)
    drawn = random_projections(dict(zip(("visual", "state", "action"), first, strict=True)), size, seed)

    def encoded(frame: pa.Table) -> pa.Table:
        frame = frame.sort_by("frame_index")
        rows = {c: _matrix(frame.column(c).combine_chunks()) for c in ("visual", "state", "action")}
        rows["visual"] = rows["visual"] / np.maximum(np.linalg.norm(rows["visual"], axis=1, keepdims=True), EPS)
        seen = {c: rows[c] @ drawn[c] for c in rows}
        seen |= {f"delta_{c}": np.diff(seen[c], axis=0) for c in rows}
        parts = [part for name in seen for part in ((seen[name].mean(0), seen[name].std(0), seen[name][-1] - seen[name][0]) if len(seen[name]) else (np.zeros(size),) * 3)]
        for a, b in RELATIONS:
            n = min(len(seen[a]), len(seen[b]))
            if n <= max(lags):
                raise ValueError(f"a clip of {len(rows['state'])} frames is too short for lag {max(lags)}")
            parts += [(seen[a][: n - lag] * seen[b][lag:n]).mean(0) for lag in lags]
        return pa.table({"sample_id": frame.column("sample_id").slice(0, 1), "relation": _lists(np.concatenate(parts)[None])})

    frames = clip_frames.select("sample_id", "frame_index", F.col(visual).alias("visual"), F.col(state).alias("state"), F.col(action).alias("action"))
    return frames.groupBy("sample_id").applyInArrow(encoded, "sample_id string, relation array<double>")


def soft_prototypes(rows: DataFrame, column: str, centres: np.ndarray, keep: Sequence[str], top: int = 3, temperature: float = 0.1) -> DataFrame:
    """``keep, prototype, weight``: each row's ``top`` centres by the softmax of -d^2 / temperature over all centres (not normalised again), ties to the first."""
    centres = np.asarray(centres, float)
    if not 0 < top <= len(centres) or temperature <= 0:
        raise ValueError("top must be between 1 and the number of centres, and the temperature positive")

    def weights(x: np.ndarray) -> np.ndarray:
        logits = -((x[:, None] - centres[None]) ** 2).sum(2) / temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = np.argsort(-p, axis=1, kind="stable")[:, :top]
        return np.stack([best, np.take_along_axis(p, best, 1)], 2).reshape(len(x), -1)

    pairs = map_rows(rows, column, "p_", weights, keep)
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(top - 1)), lambda k: F.struct(F.get("p_", 2 * k).cast("long").alias("prototype"), F.get("p_", 2 * k + 1).alias("weight"))))
    return pairs.select(*keep, at.alias("slot", "x")).select(*keep, "x.prototype", "x.weight")


def window_means(frames: DataFrame, column: str, width: int, length: int) -> DataFrame:
    """``episode_id, start_step, mean``: unit mean vectors of the ``length`` frames from each start on that fits; ``width``: the vector's."""
    ahead = W.partitionBy("episode_id").orderBy("frame_index").rowsBetween(0, length - 1)
    mean: list[Column] = [F.avg(F.get(column, F.lit(k))).over(ahead) for k in range(width)]
    rows = frames.select("episode_id", F.col("frame_index").alias("start_step"), F.array(*mean).alias("m"), F.count(F.lit(1)).over(ahead).alias("n")).filter(F.col("n") == length)
    size = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("episode_id", "start_step", F.transform("m", lambda x: x / F.greatest(size, F.lit(EPS))).alias("mean"))
