"""Normalisers and per-clip features over array columns. Quantiles are exact, linearly interpolated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering

EPS = 1e-8


def quantiles(frames: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """``dim, q0, q1, ...``: quantiles of each dimension over all rows (each frame once)."""
    return ordering.quantiles(frames.select(F.posexplode(column).alias("dim", "x")), "x", at, ["dim"])


def _bounds(frames: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """One row: an array of quantiles for every dimension, in order."""
    rows = quantiles(frames, column, at)
    names = [f"q{k}" for k in range(len(at))]
    gathered = rows.agg(F.array_sort(F.collect_list(F.struct("dim", *names))).alias("b"))
    return gathered.select(*[F.col(f"b.{n}").alias(n) for n in names])


def _scaled(frames: DataFrame, column: str, bounds: DataFrame, out: str, of) -> DataFrame:
    """``of(x, q0, q1, ...)`` for each dimension; bounds are one row (as many numbers as dimensions)."""
    names = bounds.columns
    joined = frames.crossJoin(F.broadcast(bounds))
    zipped = F.transform(F.col(column), lambda x, i: of(x, *[F.get(F.col(n), i) for n in names]))
    return joined.withColumn(out, zipped).drop(*names)


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def robust_scale(frames: DataFrame, column: str, out: str, low: float = 0.01, high: float = 0.99, eps: float = EPS, fit: DataFrame | None = None) -> DataFrame:
    """Scaled to [0, 1] between two quantiles of ``fit`` (default: the rows themselves)."""
    bounds = _bounds(frames if fit is None else fit, column, (low, high))
    return _scaled(frames, column, bounds, out, lambda x, lo, hi: clip01((x - lo) / F.greatest(hi - lo, F.lit(eps))))


def median_iqr(frames: DataFrame, column: str, out: str, eps: float = EPS) -> DataFrame:
    """Less the median, over the interquartile range; not clipped."""
    bounds = _bounds(frames, column, (0.25, 0.5, 0.75))
    return _scaled(frames, column, bounds, out, lambda x, a, m, b: (x - m) / (b - a + eps))


def quantile_unit(frames: DataFrame, column: str, out: str, clip: bool = True) -> DataFrame:
    """To [-1, 1] between the 1 % and 99 % quantiles; constant dimensions give 0."""
    def of(x: Column, lo: Column, hi: Column) -> Column:
        y = 2 * (x - lo) / (hi - lo) - 1
        y = F.least(F.greatest(y, F.lit(-1.0)), F.lit(1.0)) if clip else y
        return F.when(hi - lo == 0, F.lit(0.0)).otherwise(y)

    return _scaled(frames, column, _bounds(frames, column, (0.01, 0.99)), out, of)


def quantile_restore(frames: DataFrame, column: str, out: str, fit: DataFrame, fit_column: str) -> DataFrame:
    """The inverse of ``quantile_unit``; constant dimensions give their value."""
    return _scaled(frames, column, _bounds(fit, fit_column, (0.01, 0.99)), out, lambda y, lo, hi: lo + (y + 1) / 2 * (hi - lo))


def standardise(frames: DataFrame, column: str, out: str, keep: Sequence[int] = ()) -> DataFrame:
    """Less the mean, over the population deviation (at least EPS); dimensions in ``keep`` stay as they are."""
    wide = frames.select(F.posexplode(column).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    row = wide.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("b")).select(F.col("b.m").alias("m"), F.col("b.s").alias("s"))
    joined = frames.crossJoin(F.broadcast(row))
    each = F.transform(F.col(column), lambda x, i: F.when(i.isin(list(keep)), x).otherwise((x - F.get(F.col("m"), i)) / F.greatest(F.get(F.col("s"), i), F.lit(EPS))))
    return joined.withColumn(out, each).drop("m", "s")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column, eps: float = EPS) -> Column:
    """Over the length (at least eps): zero vectors stay zero."""
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(eps)))


def unit_interval(rows: DataFrame, column: str, out: str, low: float = 0.01, high: float = 0.99, eps: float = EPS, reverse: bool = False) -> DataFrame:
    """A scalar column between two of its quantiles, clipped to [0, 1]; ``reverse``: one less that. Nulls stay null."""
    return unit_intervals(rows, {column: out}, low, high, eps, reverse)


def unit_intervals(rows: DataFrame, columns: dict[str, str], low: float = 0.01, high: float = 0.99, eps: float = EPS, reverse: bool = False) -> DataFrame:
    """``unit_interval`` of several columns (each with its new name), from one pass over their values."""
    names = list(columns)
    wide = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("x")) for k, c in enumerate(names)])).alias("v")).select("v.c", "v.x")
    found = ordering.quantiles(wide, "x", (low, high), ["c"])
    row = found.agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("q0", "q1")))).alias("q_"))
    out = rows.crossJoin(F.broadcast(row))
    for k, (c, name) in enumerate(columns.items()):
        q = F.element_at("q_", F.lit(k))
        x = clip01((F.col(c) - q["q0"]) / F.greatest(q["q1"] - q["q0"], F.lit(eps)))
        out = out.withColumn(name, F.when(F.col(c).isNotNull(), 1 - x if reverse else x))
    return out.drop("q_")


def temporal_pool(clip_frames: DataFrame, column: str) -> DataFrame:
    """``sample_id, pooled``: per dimension mean, population deviation and maximum over the clip, one after another."""
    wide = clip_frames.select("sample_id", F.posexplode(column).alias("dim", "x")).groupBy("sample_id", "dim").agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max("x").alias("h"))
    rows = wide.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s", "h"))).alias("b"))
    return rows.select("sample_id", F.concat(F.col("b.m"), F.col("b.s"), F.col("b.h")).alias("pooled"))


def fragment_feature(clip_frames: DataFrame, column: str) -> DataFrame:
    """``sample_id, feature``: per dimension the sum over the clip, then last less first."""
    wide = clip_frames.select("sample_id", "frame_index", F.posexplode(column).alias("dim", "x")).groupBy("sample_id", "dim").agg(
        F.sum("x").alias("t"), (F.max_by("x", "frame_index") - F.min_by("x", "frame_index")).alias("d"))
    rows = wide.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("dim", "t", "d"))).alias("b"))
    return rows.select("sample_id", F.concat(F.col("b.t"), F.col("b.d")).alias("feature"))


def half_means(clip_frames: DataFrame, clips: DataFrame, column: str) -> DataFrame:
    """``sample_id, first_half, second_half``: normalised mean vectors of two halves that share the middle frame."""
    middle = F.expr("(start_step + end_step) div 2")
    rows = clip_frames.join(clips.select("sample_id", middle.alias("mid")), "sample_id")
    wide = rows.select("sample_id", "frame_index", "mid", F.posexplode(column).alias("dim", "x")).groupBy("sample_id", "dim").agg(
        F.avg(F.when(F.col("frame_index") <= F.col("mid"), F.col("x"))).alias("a"), F.avg(F.when(F.col("frame_index") >= F.col("mid"), F.col("x"))).alias("z"))
    got = wide.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("dim", "a", "z"))).alias("b"))
    return got.select("sample_id", l2_normalise(F.col("b.a")).alias("first_half"), l2_normalise(F.col("b.z")).alias("second_half"))
