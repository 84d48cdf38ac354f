"""Windows, ids, links and expansions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as w
from ..sources import tables
from .base import CLIPS, EPISODES, FRAMES, LENGTHS, query, rounded, thousandths

_CUT = "SELECT episode_id, length, start_step, least(start_step + {c} - 1, length - 1) AS end_step FROM ({inner})"
_ALIGNED = """SELECT episode_id, length, unnest(CASE WHEN length <= 0 THEN [] WHEN length <= {c} THEN [0]
    ELSE list_distinct(list_concat(range(0, length - {c} + 1, {s}), [length - {c}])) END) AS start_step FROM lengths"""


@query(f"WITH {LENGTHS} " + _CUT.format(c=8, inner=_ALIGNED.format(c=8, s=4)))
def aligned_windows(spark: SparkSession, sf: str) -> DataFrame:
    return w.aligned_windows(tables.lengths(spark, sf), 8, 4)


@query(f"WITH {LENGTHS} " + _CUT.format(c=15, inner=_ALIGNED.format(c=15, s=15) + " WHERE length >= 15"))
def candidate_windows(spark: SparkSession, sf: str) -> DataFrame:
    return w.candidate_windows(tables.lengths(spark, sf))


_COUNTED = """counted AS (SELECT *, CASE WHEN length < 15 THEN 0 WHEN length < 30 THEN 1 WHEN length <= 90 THEN (2 * length + 15) // 30
    WHEN length <= 180 THEN (2 * length + 30) // 60 + 3 ELSE (2 * length + 60) // 120 + 6 END AS n FROM lengths)"""


@query(f"WITH {LENGTHS}, {_COUNTED} " + _CUT.format(c=15, inner="""SELECT episode_id, length, unnest(CASE WHEN n = 0 THEN [] WHEN n = 1 THEN [0]
    ELSE list_transform(range(0, n), lambda i: (2 * i * (length - 15) + n - 1) // (2 * (n - 1))) END) AS start_step FROM counted"""))
def reference_windows(spark: SparkSession, sf: str) -> DataFrame:
    return w.reference_windows(tables.lengths(spark, sf))


@query(f"WITH {LENGTHS}, gapped AS (SELECT *, (length + 14) // 15 - 1 AS gaps FROM lengths WHERE length >= 15) " + _CUT.format(c=15, inner="""
    SELECT episode_id, length, unnest(CASE WHEN gaps = 0 THEN [0] ELSE list_transform(range(0, gaps + 1), lambda i:
        i * ((length - 15) // gaps) + greatest(0, i - (gaps - (length - 15) % gaps))) END) AS start_step FROM gapped"""))
def uniform_windows(spark: SparkSession, sf: str) -> DataFrame:
    return w.uniform_windows(tables.lengths(spark, sf), 15)


@query(f"WITH {LENGTHS}, spans AS (SELECT *, length - 8 AS span, (length - 8) % 3 AS rest FROM lengths WHERE length >= 8) " + _CUT.format(c=8, inner="""
    SELECT episode_id, length, unnest(CASE WHEN rest = 0 THEN range(0, span + 1, 3) WHEN span < 3 THEN [0, span]
        ELSE list_concat(range(0, span - rest - 3 + 1, 3), [span - (3 + rest) // 2, span]) END) AS start_step FROM spans"""))
def trajectory_starts(spark: SparkSession, sf: str) -> DataFrame:
    return w.trajectory_starts(tables.lengths(spark, sf), 8, 3)


@query(f"""WITH {LENGTHS}, cut AS ({_CUT.format(c=32, inner=_ALIGNED.format(c=32, s=16))})
    SELECT episode_id, 0 AS start_step, length - 1 AS end_step, 'trajectory' AS kind, format('ep{{:06d}}_trajectory', episode_id) AS sample_id FROM lengths WHERE length > 0
    UNION ALL SELECT episode_id, start_step, end_step, 'chunk', format('ep{{:06d}}_chunk_{{:06d}}_{{:06d}}', episode_id, start_step, end_step) FROM cut""")
def episode_segments(spark: SparkSession, sf: str) -> DataFrame:
    return w.segments(tables.lengths(spark, sf), ("trajectory", "chunk", "trajectory"), 32, 16).drop("length")


def clips(spark: SparkSession, sf: str) -> DataFrame:
    return w.with_ids(w.candidate_windows(tables.episodes(tables.frames(spark, sf))).select("episode_id", "length", "start_step", "end_step"))


@query(f"""WITH {CLIPS} SELECT c.sample_id, p.sample_id AS previous_sample_id, n.sample_id AS next_sample_id FROM clips c
    LEFT JOIN clips p ON p.episode_id = c.episode_id AND p.end_step + 1 = c.start_step LEFT JOIN clips n ON n.episode_id = c.episode_id AND n.start_step - 1 = c.end_step""")
def clip_links_contiguous(spark: SparkSession, sf: str) -> DataFrame:
    return w.contiguous_links(clips(spark, sf)).select("sample_id", "previous_sample_id", "next_sample_id")


@query(f"""WITH {CLIPS} SELECT sample_id, lag(sample_id) OVER e AS previous_sample_id, lead(sample_id) OVER e AS next_sample_id FROM clips
    WINDOW e AS (PARTITION BY episode_id ORDER BY start_step)""")
def clip_links_chronological(spark: SparkSession, sf: str) -> DataFrame:
    return w.chronological_links(clips(spark, sf)).select("sample_id", "previous_sample_id", "next_sample_id")


def _windows_sql(pad: str) -> str:
    fill, mask = ("last(action) OVER whole", "1") if pad == "repeat" else ("[0.0, 0.0]", "(lead(1, {k}) OVER e IS NOT NULL)::INT")
    actions = ", ".join(f"coalesce(lead(action, {k}) OVER e, {fill})" for k in range(4))
    masks = " || ".join(f"({mask.format(k=k)})::VARCHAR" for k in range(4))
    return f"""WITH {FRAMES}, w AS (SELECT episode_id, frame_index, flatten([{actions}]) AS a, {masks} AS mask FROM frames
        WINDOW e AS (PARTITION BY episode_id ORDER BY frame_index), whole AS (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT episode_id, frame_index, {thousandths('a')} AS actions, mask FROM w"""


def _windows(spark: SparkSession, sf: str, pad: str) -> DataFrame:
    rows = w.action_windows(tables.frames(spark, sf), 4, pad)
    return rounded(rows.select("episode_id", "frame_index", F.flatten("actions").alias("actions"), F.array_join(F.transform("mask", lambda x: x.cast("string")), "").alias("mask")))


@query(_windows_sql("repeat"))
def action_window_repeat_pad(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, "repeat")


@query(_windows_sql("zero"))
def action_window_zero_pad(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, "zero")


@query(f"""WITH {FRAMES}, w AS (SELECT episode_id, frame_index, flatten([action, coalesce(lead(action) OVER e, action)]) AS a FROM frames
    WINDOW e AS (PARTITION BY episode_id ORDER BY frame_index)), h AS (SELECT *, list_concat(coalesce(lag(a) OVER e, a), a) AS b, (lag(a) OVER e) IS NOT NULL AS m FROM w
    WINDOW e AS (PARTITION BY episode_id ORDER BY frame_index)) SELECT episode_id, frame_index, {thousandths('b')} AS history, m AS has_history FROM h""")
def action_history_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = w.history_windows(tables.frames(spark, sf), 2)
    return rounded(rows.select("episode_id", "frame_index", F.flatten(F.flatten("history")).alias("history"), F.col("history_mask")[0].alias("has_history")))


@query(f"""WITH {CLIPS}, o AS (SELECT episode_id, coalesce(sum(length) OVER (ORDER BY episode_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM episodes)
    SELECT DISTINCT (o + unnest(range(start_step, end_step + 1)))::BIGINT AS global_index FROM clips JOIN o USING (episode_id)""")
def expand_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return w.expand_fragments(clips(spark, sf), tables.episodes(tables.frames(spark, sf)))


@query(f"""WITH {EPISODES}, listed AS (SELECT o_orderkey AS position, o_custkey AS episode_id FROM orders)
    SELECT position, episode_id, unnest(range(0, length)) AS frame_index FROM listed JOIN episodes USING (episode_id)""")
def expand_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    listed = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("episode_id"))
    return w.expand_trajectories(listed, tables.episodes(tables.frames(spark, sf)))


@query(f"""WITH {LENGTHS} SELECT DISTINCT episode_id, length, unnest(CASE WHEN length <= 0 THEN [] WHEN length = 1 THEN [0]
    ELSE list_transform(range(0, least(length, 8)), lambda i: round_even(i * (length - 1) / (least(length, 8) - 1)::DOUBLE, 0)::BIGINT) END) AS frame_index FROM lengths""")
def uniform_sample_indices(spark: SparkSession, sf: str) -> DataFrame:
    return w.uniform_sample_indices(tables.lengths(spark, sf), 8)


@query(f"""WITH {EPISODES}, o AS (SELECT episode_id, length, coalesce(sum(length) OVER (ORDER BY episode_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM episodes)
    SELECT p_partkey AS global_index, episode_id, (p_partkey - o)::BIGINT AS frame_index FROM part JOIN o ON p_partkey >= o AND p_partkey < o + length""")
def frame_asof_episode(spark: SparkSession, sf: str) -> DataFrame:
    asked = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("global_index"))
    return w.frame_episode(asked, tables.episodes(tables.frames(spark, sf)))


@query(f"""WITH {CLIPS}, r AS (SELECT episode_id, length, CASE WHEN length < 15 THEN 0 WHEN length < 30 THEN 1 WHEN length <= 90 THEN (2 * length + 15) // 30 ELSE (2 * length + 30) // 60 + 3 END AS n FROM episodes),
    refs AS (SELECT episode_id, unnest(CASE WHEN n = 0 THEN [] WHEN n = 1 THEN [0] ELSE list_transform(range(0, n), lambda i: (2 * i * (length - 15) + n - 1) // (2 * (n - 1))) END) AS start_step FROM r)
    SELECT episode_id, start_step, bool_or(c) AS candidate, bool_or(NOT c) AS reference FROM
    (SELECT episode_id, start_step, true AS c FROM clips UNION ALL SELECT episode_id, start_step, false FROM refs) GROUP BY 1, 2""")
def candidate_reference_union(spark: SparkSession, sf: str) -> DataFrame:
    episodes = tables.episodes(tables.frames(spark, sf))
    cut = w.candidate_windows(episodes).select("episode_id", "start_step", F.lit(True).alias("c"))
    both = cut.unionByName(w.reference_windows(episodes).select("episode_id", "start_step", F.lit(False).alias("c")))
    return both.groupBy("episode_id", "start_step").agg(F.bool_or("c").alias("candidate"), F.bool_or(~F.col("c")).alias("reference"))
