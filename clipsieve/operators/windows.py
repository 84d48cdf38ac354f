"""Cutting episodes into windows. Starts and ends are frame numbers, both inclusive.

Every generator is an array expression of the episode's length that is exploded
in place, so cutting needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Clip length, anchors, prototype window and gap of the two known data profiles.
PROFILES = {
    "libero": {"clip": 15, "anchors": (0, 7, 14), "window": 8, "gap": 3},
    "bridge_v2": {"clip": 7, "anchors": (0, 3, 6), "window": 4, "gap": 2},
}

_NONE = "cast(array() as array<bigint>)"


def _starts(expression: str) -> Column:
    return F.expr(expression)


def _cut(episodes: DataFrame, starts: Column, length: int | None) -> DataFrame:
    """One row a start; a window of ``length`` frames (None: to the end of the episode) never passes the end."""
    cut = episodes.select("*", F.explode(starts).alias("start_step"))
    last = F.col("length") - 1
    end = last if length is None else F.least(F.col("start_step") + length - 1, last)
    return cut.withColumn("end_step", end.cast("long"))


def aligned_windows(episodes: DataFrame, chunk: int, stride: int) -> DataFrame:
    """Starts 0, stride, ...; the last window ends with the episode. A short episode is one window, an empty one none."""
    starts = _starts(f"""CASE WHEN length <= 0 THEN {_NONE} WHEN length <= {chunk} THEN array(0L)
        ELSE array_distinct(concat(sequence(0L, length - {chunk}, {stride}L), array(length - {chunk}))) END""")
    return _cut(episodes, starts, chunk)


def candidate_windows(episodes: DataFrame, chunk: int = 15, stride: int = 15) -> DataFrame:
    """Aligned windows of episodes that have a whole one."""
    return aligned_windows(episodes.filter(F.col("length") >= chunk), chunk, stride)


#: Number of reference windows by length, rounding half up.
_REFERENCE_COUNT = """CASE WHEN length < 15 THEN 0L WHEN length < 30 THEN 1L WHEN length <= 90 THEN (2 * length + 15) div 30
    WHEN length <= 180 THEN (2 * length + 30) div 60 + 3 ELSE (2 * length + 60) div 120 + 6 END"""


def reference_windows(episodes: DataFrame, chunk: int = 15) -> DataFrame:
    """A number of windows that grows slower for longer episodes, evenly placed, starts rounded half up."""
    counted = episodes.withColumn("n", F.expr(_REFERENCE_COUNT))
    starts = _starts(f"""CASE WHEN n <= 0 THEN {_NONE} WHEN n = 1 THEN array(0L)
        ELSE transform(sequence(0L, n - 1), i -> (2 * i * (length - {chunk}) + n - 1) div (2 * (n - 1))) END""")
    return _cut(counted, starts, chunk).drop("n")


def uniform_windows(episodes: DataFrame, chunk: int) -> DataFrame:
    """As few windows as cover the episode, with gaps that differ by one at most, shorter gaps first."""
    counted = episodes.filter(F.col("length") >= chunk).withColumn("gaps", F.expr(f"(length + {chunk} - 1) div {chunk} - 1"))
    starts = _starts(f"""CASE WHEN gaps <= 0 THEN array(0L) ELSE transform(sequence(0L, gaps), i ->
        i * ((length - {chunk}) div gaps) + greatest(0L, i - (gaps - (length - {chunk}) % gaps))) END""")
    return _cut(counted, starts, chunk).drop("gaps")


def trajectory_starts(episodes: DataFrame, window: int, gap: int) -> DataFrame:
    """Windows ``gap`` apart; a remainder is shared by the last two gaps, the larger part first."""
    span, rest = f"(length - {window})", f"((length - {window}) % {gap})"
    starts = _starts(f"""CASE WHEN length < {window} THEN {_NONE} WHEN {rest} = 0 THEN sequence(0L, {span}, {gap}L)
        WHEN {span} < {gap} THEN array(0L, {span})
        ELSE concat(sequence(0L, {span} - {rest} - {gap}, {gap}L),
                    array({span} - ({gap} + {rest}) div 2, {span})) END""")
    return _cut(episodes, starts, window)


def with_ids(windows: DataFrame, kind: str = "fragment") -> DataFrame:
    """Adds ``length`` and the clip's id: episode and both ends, six digits each."""
    return windows.withColumns({
        "length": (F.col("end_step") - F.col("start_step") + 1).cast("long"),
        "sample_id": F.format_string(f"ep%06d_{kind}_%06d_%06d", "episode_id", "start_step", "end_step"),
    })


def segments(episodes: DataFrame, modes: tuple[str, ...], chunk: int, stride: int) -> DataFrame:
    """Whole trajectories and/or aligned chunks of every episode, each mode once."""
    parts = []
    for mode in dict.fromkeys(modes):
        if mode == "trajectory":
            whole = _cut(episodes.filter("length > 0"), F.array(F.lit(0).cast("long")), None)
            parts.append(whole.withColumns({"kind": F.lit(mode), "sample_id": F.format_string("ep%06d_trajectory", "episode_id")}))
        elif mode == "chunk":
            cut = aligned_windows(episodes, chunk, stride)
            parts.append(cut.withColumns({"kind": F.lit(mode), "sample_id": F.format_string("ep%06d_chunk_%06d_%06d", "episode_id", "start_step", "end_step")}))
        else:
            raise ValueError(f"unknown segment mode: {mode}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contiguous_links(clips: DataFrame) -> DataFrame:
    """Adds ``previous_sample_id`` and ``next_sample_id`` of clips that meet this one exactly."""
    mine = clips.select("episode_id", "start_step", "end_step", "sample_id")
    before = mine.select("episode_id", (F.col("end_step") + 1).alias("start_step"), F.col("sample_id").alias("previous_sample_id"))
    after = mine.select("episode_id", (F.col("start_step") - 1).alias("end_step"), F.col("sample_id").alias("next_sample_id"))
    return clips.join(before, ["episode_id", "start_step"], "left").join(after, ["episode_id", "end_step"], "left")


def chronological_links(clips: DataFrame) -> DataFrame:
    """Adds the ids of the clips before and after in the episode, whether they meet or not."""
    order = W.partitionBy("episode_id").orderBy("start_step", "sample_id")
    return clips.withColumns({"previous_sample_id": F.lag("sample_id").over(order), "next_sample_id": F.lead("sample_id").over(order)})


def clip_frames(clips: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames of every clip: clip steps are exploded, so the join is on equal keys only."""
    steps = clips.select("sample_id", "episode_id", F.explode(F.sequence("start_step", "end_step")).alias("frame_index"))
    return steps.join(frames, ["episode_id", "frame_index"])


def action_windows(frames: DataFrame, horizon: int, pad: str = "repeat") -> DataFrame:
    """``actions`` (an array of ``horizon``) and ``mask`` for every frame.

    Past the end the last action repeats with mask 1 (``repeat``), or zeros stand
    with mask 0 (``zero``).
    """
    order = W.partitionBy("episode_id").orderBy("frame_index")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.transform("action", lambda x: F.lit(0.0))
    fill = F.last("action").over(whole) if pad == "repeat" else zero
    ahead = [F.lead("action", k).over(order) if k else F.col("action") for k in range(horizon)]
    there = [F.lit(1) if pad == "repeat" else F.lead(F.lit(1), k, 0).over(order) if k else F.lit(1) for k in range(horizon)]
    return frames.withColumns({"actions": F.array(*[F.coalesce(a, fill) for a in ahead]), "mask": F.array(*there)})


def history_windows(frames: DataFrame, horizon: int) -> DataFrame:
    """For every frame its predecessor's and its own action windows, with a flag if the former is real."""
    order = W.partitionBy("episode_id").orderBy("frame_index")
    rows = action_windows(frames, horizon, "repeat")
    return rows.withColumns({
        "history": F.array(F.coalesce(F.lag("actions").over(order), F.col("actions")), F.col("actions")),
        "history_mask": F.array(F.lag("actions").over(order).isNotNull(), F.lit(True)),
    })


def expand_fragments(fragments: DataFrame, episodes: DataFrame) -> DataFrame:
    """Distinct global frame numbers of inclusive fragments; an episode begins where those before it end."""
    at = global_offsets(episodes)
    return fragments.join(at.select("episode_id", "offset"), "episode_id").select(
        F.explode(F.sequence(F.col("offset") + F.col("start_step"), F.col("offset") + F.col("end_step"))).alias("global_index")).distinct()


def expand_trajectories(listed: DataFrame, episodes: DataFrame) -> DataFrame:
    """All frames of listed episodes in the list's order (``position``), repeats included."""
    return listed.join(episodes.select("episode_id", "length"), "episode_id").filter("length > 0").select(
        "position", "episode_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("frame_index"))


def global_offsets(episodes: DataFrame) -> DataFrame:
    """Adds ``offset``, the sum of the lengths of episodes with smaller ids.

    Ids are dealt to blocks of 4096; sums of blocks are added up first, so that
    no task orders more than a block's episodes or one row a block.
    """
    blocks = episodes.withColumn("block", F.expr("episode_id div 4096"))
    sums = blocks.groupBy("block").agg(F.sum("length").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("length").over(W.partitionBy("block").orderBy("episode_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.join(before.select("block", "before"), "block").withColumn("offset", F.col("before") + inside).drop("block", "before")


def uniform_sample_indices(episodes: DataFrame, most: int) -> DataFrame:
    """At most ``most`` evenly spread frames, rounded half to even, each once."""
    spread = F.expr(f"""CASE WHEN length <= 0 THEN {_NONE} WHEN length = 1 OR {most} = 1 THEN array(0L) ELSE
        array_distinct(transform(sequence(0L, least(length, {most}L) - 1), i -> cast(bround(cast(i * (length - 1) as double) / (least(length, {most}L) - 1)) as bigint))) END""")
    return episodes.select("episode_id", "length", F.explode(spread).alias("frame_index"))


def frame_episode(global_frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """The episode and frame of global frame numbers: as-of lookup in the episodes' offsets.

    Frame numbers and offsets meet in blocks of 4096 numbers, so the join is on
    equal keys with a range inside.
    """
    at = global_offsets(episodes).filter("length > 0").select("episode_id", "length", "offset",
        F.explode(F.sequence(F.expr("offset div 4096"), F.expr("(offset + length - 1) div 4096"))).alias("block"))
    asked = global_frames.withColumn("block", F.expr("global_index div 4096"))
    return asked.join(at, "block").filter("global_index BETWEEN offset AND offset + length - 1").select(
        "global_index", "episode_id", (F.col("global_index") - F.col("offset")).alias("frame_index"))
