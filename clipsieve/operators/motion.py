"""Motion and quality metrics of clips: ordered windows over the clip's frames, then one row a clip.

``clip_frames`` has ``sample_id, frame_index`` and the named columns. A metric
that is undefined is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import rotation_quaternion, quaternion_angle, wrapped_angle
from .normalize import EPS, clip01, distance, dot, l2_normalise, norm, unit_intervals
from .ordering import quantiles


def in_clip() -> WindowSpec:
    return W.partitionBy("sample_id").orderBy("frame_index")


def in_episode() -> WindowSpec:
    return W.partitionBy("episode_id").orderBy("frame_index")


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def raw_quality(clip_frames: DataFrame) -> DataFrame:
    """``action_smooth, state_transition, motion_efficiency``: mean step of action and of state, and net state change a step."""
    rows = clip_frames.withColumns({
        "da": distance(F.col("action"), F.lag("action").over(in_clip())), "ds": distance(F.col("state"), F.lag("state").over(in_clip()))})
    n = F.count(F.lit(1)) - 1
    net = distance(F.max_by("state", "frame_index"), F.min_by("state", "frame_index"))
    return rows.groupBy("sample_id").agg(
        F.coalesce(F.avg("da"), F.lit(0.0)).alias("action_smooth"), F.coalesce(F.avg("ds"), F.lit(0.0)).alias("state_transition"),
        F.when(n > 0, net / n).otherwise(0.0).alias("motion_efficiency"))


def quality(raw: DataFrame) -> DataFrame:
    """Adds ``quality``: 0.4 of smoothness (less action is smoother), 0.3 each of state transition and efficiency, all between quantiles."""
    raw = unit_intervals(raw, {c: f"{c}_unit" for c in ("action_smooth", "state_transition", "motion_efficiency")})
    score = 0.4 * (1 - F.col("action_smooth_unit")) + 0.3 * F.col("state_transition_unit") + 0.3 * F.col("motion_efficiency_unit")
    return raw.withColumn("quality", clip01(score))


def action_variation(frames: DataFrame, ahead: int = 5) -> DataFrame:
    """``variation`` of every frame: twice its action's step, plus the mean over dimensions of the variance of the next few actions."""
    step = F.coalesce(2 * distance(F.col("action"), F.lag("action").over(in_episode())), F.lit(0.0))
    width = frames.select(F.max(F.size("action"))).first()[0] or 1
    later = in_episode().rowsBetween(1, ahead)
    spread = sum((F.var_pop(F.get("action", F.lit(k))).over(later) for k in range(width)), F.lit(0.0)) / width
    return frames.withColumn("variation", step + F.when(F.count(F.lit(1)).over(later) >= 2, spread).otherwise(0.0))


def top_k_mean(rows: DataFrame, column: str, k: int = 3, by: str = "sample_id") -> DataFrame:
    """``by, top_mean``: mean of the k largest (all, if fewer)."""
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(column)))).filter(F.col("r") <= k)
    return ranked.groupBy(by).agg(F.avg(column).alias("top_mean"))


def visual_action_consistency(frames: DataFrame, visual: str = "state") -> DataFrame:
    """``consistency`` of every frame: visual step over action step; the first frame has the second's."""
    rows = frames.withColumn("c", distance(F.col(visual), F.lag(visual).over(in_episode())) / (distance(F.col("action"), F.lag("action").over(in_episode())) + EPS))
    return rows.withColumn("consistency", F.coalesce("c", F.lead("c").over(in_episode()))).drop("c")


def action_jumps(frames: DataFrame, skip: tuple[int, ...] = ()) -> DataFrame:
    """``jump`` of every frame but an episode's first: root mean square of the action's step, each dimension in units of its values' population deviation over all frames."""
    wide = frames.select("episode_id", "frame_index", F.posexplode("action").alias("dim", "x")).filter(~F.col("dim").isin(list(skip)) if skip else F.lit(True))
    scale = wide.groupBy("dim").agg(F.greatest(F.stddev_pop("x"), F.lit(EPS)).alias("s"))
    by = W.partitionBy("episode_id", "dim").orderBy("frame_index")
    steps = wide.withColumn("d", F.col("x") - F.lag("x").over(by)).filter("d IS NOT NULL")
    return steps.join(F.broadcast(scale), "dim").groupBy("episode_id", "frame_index").agg(F.sqrt(F.avg((F.col("d") / F.col("s")) ** 2)).alias("jump"))


def jump_rate(clips: DataFrame, jumps: DataFrame, threshold: float | None = None, at: float = 0.99) -> DataFrame:
    """``jump_rate`` and ``jump_score`` of clips: share of steps inside a clip beyond the threshold (default: a quantile of all jumps)."""
    limit = quantiles(jumps, "jump", (at,)).withColumnRenamed("q0", "limit") if threshold is None else jumps.limit(0).agg(F.lit(threshold).alias("limit"))
    steps = clips.filter("end_step > start_step").select("sample_id", "episode_id", F.explode(F.sequence(F.col("start_step") + 1, F.col("end_step"))).alias("frame_index"))
    rows = steps.join(jumps, ["episode_id", "frame_index"]).crossJoin(F.broadcast(limit))
    return rows.groupBy("sample_id").agg(F.avg((F.col("jump") > F.col("limit")).cast("double")).alias("jump_rate")).withColumn("jump_score", 1 - F.col("jump_rate"))


def dwell_ratio(clip_frames: DataFrame, speed: float, turn_speed: float, grip_speed: float | None, rotation: str = "vector",
                position: tuple[int, ...] = (0, 1, 2), orientation: tuple[int, ...] = (3, 4, 5), gripper: int = 7) -> DataFrame:
    """``dwell_ratio``: share of the clip's time in steps in which position, orientation and gripper are all slower than their limits.

    ``rotation``: how the state holds it, ``vector`` or ``euler``; the angle
    between two frames is that of their quaternions. ``grip_speed`` None: a
    gripper that is open or shut must not change at all.
    """
    turn = F.array(*[F.get("state", F.lit(k)) for k in orientation])
    rows = clip_frames.withColumn("q", rotation_quaternion(turn, rotation)).withColumns({
        "dt": F.col("timestamp") - F.lag("timestamp").over(in_clip()), "was": F.lag("state").over(in_clip()), "p": F.lag("q").over(in_clip())}).filter("dt > 0")
    at = lambda column, k: F.get(column, F.lit(k))
    moved = F.sqrt(sum(((at("state", k) - at("was", k)) ** 2 for k in position), F.lit(0.0)))
    still = (moved / F.col("dt") < speed) & (quaternion_angle(F.col("p"), F.col("q")) / F.col("dt") < turn_speed)
    gripped = F.abs(at("state", gripper) - at("was", gripper))
    still = still & ((gripped == 0) if grip_speed is None else (gripped / F.col("dt") < grip_speed))
    return rows.groupBy("sample_id").agg((F.sum(F.when(still, F.col("dt")).otherwise(0.0)) / F.sum("dt")).alias("dwell_ratio"))


def _timing(frames_: str, lo: str, mid: str, hi: str, least: int, rtol: float, atol: float) -> Column:
    """The first reason for which a clip's time steps are of no use, or null."""
    far = F.lit(atol) + F.lit(rtol) * F.abs(mid)
    return F.when(F.col(frames_) < least, "too_short").when(F.col(lo) <= 0, "non_increasing_time").when(
        (F.col(hi) - F.col(mid) > far) | (F.col(mid) - F.col(lo) > far), "non_uniform_time")


def jerk(clip_frames: DataFrame, position: str = "position", time: str = "timestamp", rtol: float = 1e-4, atol: float = 1e-8) -> DataFrame:
    """``jerk, reason``: mean length of the third difference over the cube of the median time step.

    Null with a reason for fewer than four frames (``too_short``), time that
    doesn't increase (``non_increasing_time``) or isn't even (``non_uniform_time``).
    """
    p = F.col(position)
    third = F.zip_with(
        F.zip_with(p, F.lag(p, 3).over(in_clip()), lambda x, y: x - y), F.zip_with(F.lag(p, 2).over(in_clip()), F.lag(p, 1).over(in_clip()), lambda x, y: 3 * (x - y)), lambda x, y: x + y)
    rows = clip_frames.withColumns({"dt": F.col(time) - F.lag(time).over(in_clip()), "d3": norm(third)})
    got = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.avg("d3").alias("d3"), F.percentile("dt", F.lit(0.5)).alias("mid"), F.min("dt").alias("lo"), F.max("dt").alias("hi"))
    reason = _timing("n", "lo", "mid", "hi", 4, rtol, atol)
    return got.select("sample_id", F.when(reason.isNull(), F.col("d3") / F.col("mid") ** 3).alias("jerk"), F.coalesce(reason, F.lit("")).alias("reason"))


def backtracking(clip_frames: DataFrame, position: str = "position", time: str = "timestamp", least: float = 1e-6, eta: float = 0.5,
                 rtol: float = 1e-4, atol: float = 1e-8) -> DataFrame:
    """``backtracks, pairs, rate, reason``: of the adjacent steps that are both longer than ``least``, those whose directions' cosine is below -eta.

    Null with a reason for fewer than three frames (``too_short``), uneven time
    as in ``jerk``, and clips without such a pair (``no_valid_comparisons``).
    """
    d = _minus(F.col(position), F.lag(position).over(in_clip()))
    rows = clip_frames.withColumns({"d": d, "dt": F.col(time) - F.lag(time).over(in_clip())}).withColumn("e", F.lag("d").over(in_clip()))
    valid = F.col("e").isNotNull() & (norm(F.col("d")) > least) & (norm(F.col("e")) > least)
    cosine = F.least(F.greatest(dot(F.col("d"), F.col("e")) / (norm(F.col("d")) * norm(F.col("e"))), F.lit(-1.0)), F.lit(1.0))
    got = rows.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("dt", F.lit(0.5)).alias("mid"), F.min("dt").alias("lo"), F.max("dt").alias("hi"),
        F.sum(F.when(valid, 1).otherwise(0)).cast("long").alias("pairs"), F.sum(F.when(valid, (cosine < -eta).cast("int")).otherwise(0)).cast("long").alias("backtracks"))
    timing = _timing("n", "lo", "mid", "hi", 3, rtol, atol)
    reason = F.coalesce(timing, F.when(F.col("pairs") == 0, "no_valid_comparisons"), F.lit(""))
    count = lambda c: F.when(timing.isNull(), F.col(c)).otherwise(0).alias(c)
    return got.select("sample_id", count("backtracks"), count("pairs"), F.when(reason == "", F.col("backtracks") / F.col("pairs")).alias("rate"), reason.alias("reason"))


JITTER = "ratio double, high_rms double, total_rms double, resolution double, reason string"


def jitter(clip_frames: DataFrame, cutoff: float, coarsest: float, floor: float = 0.0, position: str = "position", time: str = "timestamp", eps: float = 1e-12) -> DataFrame:
    """``sample_id, ratio, high_rms, total_rms, resolution, reason, score``: the share of a clip's velocity fluctuation above ``cutoff`` hertz.

    From the one-sided power spectrum of the velocity (mean taken off, periodic
    Hann window), summed over axes, without the constant part. A clip is of no
    use if it has fewer than three velocities (``too_short``), a frequency step
    beyond ``coarsest`` (``coarse_resolution``), no frequency on one side of the
    cutoff (``missing_band``) or no more fluctuation than ``floor``
    (``low_fluctuation``); then ``score`` (one less the ratio) is null. Uneven
    time, and a cutoff that is not below half the rate, are errors.
    """
    import numpy as np
    import pandas as pd

    def spectrum(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("frame_index")
        p, t = np.array(frame["p"].to_list(), float), frame["t"].to_numpy(float)
        row = {"sample_id": frame["sample_id"].iloc[0], "ratio": None, "high_rms": None, "total_rms": None, "resolution": None, "reason": "too_short"}
        n = len(p) - 1
        if n < 1:
            return pd.DataFrame([row])
        steps = np.diff(t)
        dt = float(np.median(steps))
        if (steps <= 0).any() or not np.allclose(steps, dt, rtol=1e-3, atol=1e-8):
            raise ValueError("the time of a clip is not even")
        if not 0 < cutoff < 0.5 / dt:
            raise ValueError("the cutoff must be below half the rate of frames")
        v = np.diff(p, axis=0) / dt
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
        power = (np.abs(np.fft.rfft((v - v.mean(0)) * window[:, None], axis=0)) ** 2).sum(1) * dt / (window**2).sum()
        power[1 : (n + 1) // 2] *= 2  # the middle frequency of an even number stands alone
        at = np.fft.rfftfreq(n, dt)
        high, low = at > cutoff, (at > 0) & (at <= cutoff)
        width = 1 / (dt * n)
        total, above = power[at > 0].sum() * width, power[high].sum() * width
        reason = "too_short" if n < 3 else "coarse_resolution" if width > coarsest else "missing_band" if not high.any() or not low.any() else "low_fluctuation" if total**0.5 <= floor else ""
        row |= {"ratio": float(np.clip(above / (total + eps), 0, 1)), "high_rms": float(above**0.5), "total_rms": float(total**0.5), "resolution": width, "reason": reason}
        return pd.DataFrame([row])

    rows = clip_frames.select("sample_id", "frame_index", F.col(position).alias("p"), F.col(time).alias("t"))
    found = rows.groupBy("sample_id").applyInPandas(spectrum, f"sample_id string, {JITTER}")
    return found.withColumn("score", F.when(F.col("reason") == "", 1 - F.col("ratio")))


def path_efficiency(clip_frames: DataFrame, position: str = "position", least: float = 1e-6) -> DataFrame:
    """``efficiency``: straight distance over path length; null for paths not longer than ``least``."""
    rows = clip_frames.withColumn("d", distance(F.col(position), F.lag(position).over(in_clip())))
    got = rows.groupBy("sample_id").agg(F.sum("d").alias("path"), distance(F.max_by(position, "frame_index"), F.min_by(position, "frame_index")).alias("net"))
    return got.select("sample_id", F.when(F.col("path") > least, F.col("net") / F.col("path")).alias("efficiency"))


def execution_deviation(clip_frames: DataFrame, position: str = "position", action: str = "motion", scale: float = 1.0) -> DataFrame:
    """``deviation``: mean distance between a step of the position and the action that asked for it."""
    asked = F.transform(F.col(action), lambda x: x * scale)
    rows = clip_frames.withColumn("d", distance(_minus(F.lead(position).over(in_clip()), F.col(position)), asked))
    return rows.groupBy("sample_id").agg(F.avg("d").alias("deviation"))


def gripper_states(frames: DataFrame, column: str, opened: float = 0.95, closed: float = 0.05) -> DataFrame:
    """``gripper`` +1 or -1: clear readings count, others take over the next clear one; at the end the last reading decides."""
    clear = F.when(F.col(column) > opened, 1.0).when(F.col(column) < closed, -1.0)
    ahead = in_episode().rowsBetween(0, W.unboundedFollowing)
    seed = F.when(F.last(column).over(in_episode().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) > 0.5, 1.0).otherwise(-1.0)
    return frames.withColumn("gripper", F.coalesce(F.first(clear, ignorenulls=True).over(ahead), seed))


#: Axis, token above the threshold, token below: fixed values of the two data sets' conventions.
MOVES = ((0, "forward", "backward"), (1, "left", "right"), (2, "up", "down"))
TURNS = ((3, "roll positive", "roll negative"), (4, "tilt up", "tilt down"), (5, "rotate counterclockwise", "rotate clockwise"), (7, "open gripper", "close gripper"))


def motion_label(delta: Column, thresholds: dict[int, float], default: float = 0.03, cyclic: tuple[int, ...] = (), flipped: tuple[int, ...] = ()) -> Column:
    """``move a b, tilt up`` from per-axis changes, strictly beyond their thresholds; ``stop`` if there are none.

    ``cyclic`` axes are angles: a change outside [-pi, pi) is wrapped. On
    ``flipped`` axes the two tokens change places.
    """
    def token(axis: int, above: str, below: str) -> Column:
        limit = thresholds.get(axis, default)
        x = F.get(delta, F.lit(axis))
        x = wrapped_angle(x) if axis in cyclic else x
        above, below = (below, above) if axis in flipped else (above, below)
        return F.when(x > limit, above).when(x < -limit, below)

    moves = F.concat_ws(" ", *[token(*m) for m in MOVES])
    label = F.concat_ws(", ", F.when(moves != "", F.concat(F.lit("move "), moves)), *[token(*t) for t in TURNS])
    return F.when(label == "", "stop").otherwise(label)


def motion_primitives(frames: DataFrame, state: str, horizon: int, thresholds: dict[int, float] | None = None, tail: str = "truncate",
                      cyclic: tuple[int, ...] = (), flipped: tuple[int, ...] = ()) -> DataFrame:
    """``label`` of every frame: its motion over the next ``horizon`` frames (see ``motion_label``).

    Frames too near the end are left out (``truncate``), compared with the last
    frame (``clip``), or take over the last full label (``pad_last``).
    """
    whole = in_episode().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    later = F.lead(state, horizon).over(in_episode())
    if tail == "clip":
        later = F.coalesce(later, F.last(state).over(whole))
    rows = frames.withColumn("later", later).withColumn("label", F.when(F.col("later").isNotNull(), motion_label(_minus(F.col("later"), F.col(state)), thresholds or {}, cyclic=cyclic, flipped=flipped)))
    if tail == "pad_last":
        return rows.withColumn("label", F.coalesce("label", F.last("label", ignorenulls=True).over(whole))).drop("later")
    return rows.filter("label IS NOT NULL").drop("later")


def atoms(label: Column) -> Column:
    """The atomic actions of a label: each move by itself, each turn; none for ``stop``."""
    parts = F.split(label, ", ")
    moves = F.transform(F.filter(F.split(F.regexp_replace(F.get(parts, F.lit(0)), "^move ", ""), " "), lambda x: x != ""), lambda x: F.concat(F.lit("move "), x))
    return F.when(label == "stop", F.array().cast("array<string>")).when(
        label.startswith("move "), F.concat(moves, F.slice(parts, 2, 99))).otherwise(parts)


def compose(atoms_: Column) -> Column:
    """The label of a set of atomic actions, in the canonical order that they already have."""
    moves = F.array_join(F.transform(F.filter(atoms_, lambda x: x.startswith("move ")), lambda x: F.substring(x, 6, 99)), " ")
    turns = F.filter(atoms_, lambda x: ~x.startswith("move "))
    label = F.concat_ws(", ", F.when(moves != "", F.concat(F.lit("move "), moves)), F.when(F.size(turns) > 0, F.array_join(turns, ", ")))
    return F.when(F.size(atoms_) == 0, "stop").otherwise(label)


def label_counts(labelled: DataFrame) -> DataFrame:
    """``label, count, proportion``."""
    counts = labelled.groupBy("label").count()
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "count", (F.col("count") / F.col("total")).alias("proportion"))


def frequent_labels(counts: DataFrame, least: float) -> DataFrame:
    """Labels with at least this proportion."""
    return counts.filter(F.col("proportion") >= least)


def _with_stop(counts: DataFrame) -> DataFrame:
    """``counts`` with a row for ``stop`` even if it never occurs."""
    none = counts.agg(F.max(F.col("label") == "stop").alias("there")).filter("there IS NULL OR NOT there").select(
        F.lit("stop").alias("label"), F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("proportion"))
    return counts.unionByName(none)


def _numbered(kept: DataFrame, *order: Column | str) -> DataFrame:
    """The labels of a catalogue, numbered in order; they are some hundred at most, so one task holds them."""
    return kept.select("label", "count", (F.row_number().over(W.orderBy(*order)) - 1).cast("long").alias("label_id"))


def label_catalog(counts: DataFrame, share: float = 0.005) -> DataFrame:
    """``label, count, label_id``: labels beyond the share, and ``stop`` in any case, numbered by count and label."""
    return _numbered(_with_stop(counts).filter((F.col("proportion") > share) | (F.col("label") == "stop")), F.desc("count"), "label")


def action_catalog(counts: DataFrame, least: int = 400, share: float = 0.005, stop_bucket: bool = True) -> DataFrame:
    """``label, count, label_id``: labels with at least max(least, ceil(share of all)) occurrences; ``stop`` comes last, however rare, or not at all.

    An error if other labels occur but none often enough.
    """
    total = counts.agg(F.sum("count").alias("total"))
    rows = _with_stop(counts).crossJoin(F.broadcast(total)).withColumn(
        "kept", (F.col("label") != "stop") & (F.col("count") >= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("total")))))
    moving = rows.filter("label != 'stop' AND count > 0").agg(F.count(F.lit(1)), F.sum(F.col("kept").cast("int"))).first()
    if moving[0] and not moving[1]:
        raise ValueError("no label but stop occurs often enough")
    return _numbered(rows.filter(F.col("kept") | (F.lit(stop_bucket) & (F.col("label") == "stop"))), F.col("label") == "stop", F.desc("count"), "label")


def retained_parents(counts: DataFrame, catalog: DataFrame, stop_bucket: bool = True) -> DataFrame:
    """``label, parent``: each label's retained labels whose atoms are among its own, the ones with the most atoms (all that tie).

    A label without any has the parent ``stop`` (none, without a stop bucket).
    The catalog has some hundred labels, each with at most seven atoms: it is sent to every task.
    """
    own = counts.select("label", atoms(F.col("label")).alias("own"))
    retained = catalog.filter("label != 'stop'").select(F.col("label").alias("parent"), atoms(F.col("label")).alias("theirs"))
    fits = own.join(F.broadcast(retained), F.size(F.array_except("theirs", "own")) == 0, "left")
    best = W.partitionBy("label").orderBy(F.desc(F.coalesce(F.size("theirs"), F.lit(-1))))
    got = fits.withColumn("r", F.rank().over(best)).filter("r = 1").select("label", "parent")
    return got.withColumn("parent", F.coalesce("parent", F.lit("stop"))) if stop_bucket else got.filter("parent IS NOT NULL")


def softened(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    """``label, target, weight``: a retained label keeps weight 1; others go to retained labels with one atom less.

    None: ``stop`` at 0.8. One: it at 0.8. Two: the commoner alone at 0.8 if more
    than four times as common, else both, in proportion, 1 together. With more,
    the two commonest count.
    """
    kept = catalog.select(F.col("label").alias("target"), F.col("count").alias("often"))
    mine = counts.select("label").join(F.broadcast(kept), F.col("label") == F.col("target"), "left")
    exact = mine.filter("target IS NOT NULL").select("label", "target", F.lit(1.0).alias("weight"))
    rest = mine.filter("target IS NULL").select("label", atoms(F.col("label")).alias("own"))
    without = F.transform(F.sequence(F.lit(1), F.size("own")), lambda k: compose(F.concat(F.slice("own", F.lit(1), k - 1), F.slice("own", k + 1, F.lit(99)))))
    fewer = rest.select("label", F.explode(F.array_distinct(without)).alias("target")).join(F.broadcast(kept), "target")
    ranked = fewer.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("often"), "target"))).filter("r <= 2")
    pairs = ranked.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("r", "target", "often"))).alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    alone = second.isNull() | (first["often"] > 4 * second["often"])
    share = lambda x: F.struct(x["target"].alias("target"), (x["often"] / (first["often"] + second["often"])).alias("weight"))
    soft = pairs.select("label", F.explode(F.when(alone, F.array(F.struct(first["target"].alias("target"), F.lit(0.8).alias("weight")))).otherwise(F.array(share(first), share(second)))).alias("x")).select("label", "x.*")
    none = rest.join(pairs.select("label"), "label", "left_anti").select("label", F.lit("stop").alias("target"), F.lit(0.8).alias("weight"))
    return exact.unionByName(soft).unionByName(none)


def fuse_reliability(rows: DataFrame, metrics: list[str], least: float = 0.05, out: str = "reliability") -> DataFrame:
    """Geometric mean of a row's metrics that are not null (1 without any), at least ``least`` and at most 1."""
    there = sum((F.col(m).isNotNull().cast("int") for m in metrics), F.lit(0))
    product = F.lit(1.0)
    for m in metrics:
        product = product * F.coalesce(F.col(m).cast("double"), F.lit(1.0))
    mean = F.when(there > 0, F.pow(product, 1.0 / F.greatest(there, F.lit(1)))).otherwise(1.0)
    return rows.withColumn(out, F.least(F.greatest(mean, F.lit(least)), F.lit(1.0)))


#: How much each part counts in a clip's reliability (exponents).
RELIABILITY = {"support": 0.5, "progress": 0.5, "smoothness": 0.25, "activity": 0.5}


def progress_reliability(clip_frames: DataFrame, support: DataFrame, visual: str, parts: tuple[str, ...] = tuple(RELIABILITY), grip_weight: float = 0.5,
                         visual_weight: float = 0.25, idle: float = 1e-4, least: float = 0.05) -> DataFrame:
    """``support, progress, smoothness, activity, reliability`` of clips from state, action and a visual feature a frame.

    ``support``: ``sample_id, support``. Progress: the end effector's net move (all
    state dimensions but the last) and the gripper's (the last), in units of their
    deviation over clips, and that of the unit visual feature. Smoothness: exp of
    the median second difference of the action without its gripper (the last
    dimension), over all clips' median. Activity: share of frames in which the
    action moves, or its gripper changes.
    """
    first_ = lambda v: F.slice(v, F.lit(1), F.size(v) - 1)
    grip = lambda v: F.element_at(v, F.lit(-1))
    move = clip_frames.withColumns({"move": first_(F.col("action")), "hold": grip(F.col("action"))})
    second = F.zip_with(_minus(F.col("move"), F.lag("move").over(in_clip())), _minus(F.lag("move").over(in_clip()), F.lag("move", 2).over(in_clip())), lambda x, y: x - y)
    still = (norm(F.col("move")) < idle) & (F.abs(F.coalesce(F.col("hold") - F.lag("hold").over(in_clip()), F.lit(0.0))) < idle)
    rows = move.withColumns({"j": norm(second), "still": still.cast("double")})
    first, last = F.min_by("state", "frame_index"), F.max_by("state", "frame_index")
    got = rows.groupBy("sample_id").agg(
        distance(first_(last), first_(first)).alias("ee"), F.abs(grip(last) - grip(first)).alias("g"), progress_of(clip_frames, visual).alias("seen"),
        F.coalesce(F.percentile("j", F.lit(0.5)), F.lit(0.0)).alias("jm"), F.avg("still").alias("noop"))
    over = got.agg(F.stddev_pop("ee").alias("se"), F.stddev_pop("g").alias("sg")).crossJoin(quantiles(got, "jm", (0.5,)).withColumnRenamed("q0", "mj"))
    p = F.col("ee") / (F.col("se") + EPS) + grip_weight * F.col("g") / (F.col("sg") + EPS) + visual_weight * F.col("seen")
    out = got.join(support, "sample_id").crossJoin(F.broadcast(over)).select(
        "sample_id", "support", (0.5 + 0.5 * (1 - F.exp(-p))).alias("progress"), F.exp(-F.col("jm") / (F.col("mj") + EPS)).alias("smoothness"), F.greatest(1 - F.col("noop"), F.lit(0.0)).alias("activity"))
    product = F.lit(1.0)
    for name in parts:
        product = product * F.pow(name, RELIABILITY[name])
    return out.withColumn("reliability", F.least(F.greatest(product, F.lit(least)), F.lit(1.0)))


def progress_of(frames: DataFrame, column: str) -> Column:
    """Distance between the normalised last and first vectors of a clip (an aggregate)."""
    return distance(l2_normalise(F.max_by(column, "frame_index")), l2_normalise(F.min_by(column, "frame_index")))
