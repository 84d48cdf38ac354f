"""Normalisers, pooling and motion metrics of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import motion as m
from ..operators import normalize as n
from ..operators import windows as w
from ..operators.stored import stored
from ..sources import tables
from .base import CLIPS, FRAMES, query, rounded, thousandths
from .window_queries import clips

_DIMS = "range(1, 4)"


def clip_frames(spark: SparkSession, sf: str) -> DataFrame:
    return w.clip_frames(clips(spark, sf), tables.frames(spark, sf))


def _fit(at: str) -> str:
    return f"fit AS (SELECT list(q ORDER BY i) AS q FROM (SELECT i, quantile_cont(state[i], {at}) AS q FROM frames, (SELECT unnest({_DIMS}) AS i) GROUP BY i))"


@query(f"WITH {FRAMES} SELECT i - 1 AS dim, round(quantile_cont(state[i], 0.01), 6) AS q0, round(quantile_cont(state[i], 0.99), 6) AS q1 FROM frames, (SELECT unnest({_DIMS})::INT AS i) GROUP BY i")
def robust_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(n.quantiles(tables.frames(spark, sf), "state", (0.01, 0.99)))


def _each(of: str, at: str = "[0.01, 0.99]") -> str:
    return f"""WITH {FRAMES}, {_fit(at)} SELECT episode_id, frame_index, {thousandths('s')} AS scaled FROM
        (SELECT episode_id, frame_index, [{', '.join(of.format(x=f'state[{i}]', a=f'q[{i}][1]', b=f'q[{i}][2]', c=f'q[{i}][3]') for i in (1, 2, 3))}] AS s FROM frames, fit)"""


def _shown(rows: DataFrame) -> DataFrame:
    return rounded(rows.select("episode_id", "frame_index", "scaled"))


@query(_each("least(greatest(({x} - {a}) / greatest({b} - {a}, 1e-8), 0), 1)"))
def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(n.robust_scale(tables.frames(spark, sf), "state", "scaled"))


@query(_each("({x} - {b}) / ({c} - {a} + 1e-8)", "[0.25, 0.5, 0.75]"))
def median_iqr_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(n.median_iqr(tables.frames(spark, sf), "state", "scaled"))


@query(_each("CASE WHEN {b} = {a} THEN 0 ELSE least(greatest(2 * ({x} - {a}) / ({b} - {a}) - 1, -1), 1) END"))
def quantile_minus1_1(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(n.quantile_unit(tables.frames(spark, sf), "state", "scaled"))


@query(f"WITH {FRAMES} SELECT episode_id, frame_index, {thousandths('state')} AS scaled FROM frames")
def quantile_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    frames = tables.frames(spark, sf)
    there = n.quantile_unit(frames, "state", "unit", clip=False)
    return _shown(n.quantile_restore(there, "unit", "scaled", frames, "state"))


@query(f"""WITH {FRAMES}, fit AS (SELECT avg(state[1]) AS a, stddev_pop(state[1]) AS b, avg(state[2]) AS c, stddev_pop(state[2]) AS d FROM frames)
    SELECT episode_id, frame_index, {thousandths('s')} AS scaled FROM (SELECT episode_id, frame_index, [(state[1] - a) / b, (state[2] - c) / d, state[3]] AS s FROM frames, fit)""")
def mean_std_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(n.standardise(tables.frames(spark, sf), "state", "scaled", keep=(2,)))


@query(f"""WITH {CLIPS}, p AS (SELECT sample_id, [avg(state[1]), avg(state[2]), avg(state[3]), stddev_pop(state[1]), stddev_pop(state[2]), stddev_pop(state[3]), max(state[1]), max(state[2]), max(state[3])] AS v
    FROM clip_frames GROUP BY sample_id) SELECT sample_id, {thousandths('v')} AS pooled FROM p""")
def temporal_pool(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(n.temporal_pool(clip_frames(spark, sf), "state"))


_FEATURE = "[sum(state[1]), sum(state[2]), sum(state[3]), " + ", ".join(f"arg_max(state[{i}], frame_index) - arg_min(state[{i}], frame_index)" for i in (1, 2, 3)) + "]"


@query(f"WITH {CLIPS}, p AS (SELECT sample_id, {_FEATURE} AS v FROM clip_frames GROUP BY sample_id) SELECT sample_id, {thousandths('v')} AS feature FROM p")
def fragment_feature(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(n.fragment_feature(clip_frames(spark, sf), "state"))


@query(f"""WITH {CLIPS}, p AS (SELECT sample_id, list_concat({_FEATURE}, [avg(action[1]), avg(action[2]), stddev_pop(action[1]), stddev_pop(action[2]), max(action[1]), max(action[2])]) AS v FROM clip_frames GROUP BY sample_id)
    SELECT sample_id, {thousandths('list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-8))')} AS feature FROM p""")
def fused_feature(spark: SparkSession, sf: str) -> DataFrame:
    rows = clip_frames(spark, sf)
    joined = n.fragment_feature(rows, "state").join(n.temporal_pool(rows, "action"), "sample_id")
    return rounded(joined.select("sample_id", n.l2_normalise(F.concat("feature", "pooled")).alias("feature")))


@query(f"""WITH {CLIPS}, p AS (SELECT sample_id, [avg(state[1]) FILTER (frame_index <= (start_step + end_step) // 2), avg(state[2]) FILTER (frame_index <= (start_step + end_step) // 2), avg(state[3]) FILTER (frame_index <= (start_step + end_step) // 2)] AS a,
    [avg(state[1]) FILTER (frame_index >= (start_step + end_step) // 2), avg(state[2]) FILTER (frame_index >= (start_step + end_step) // 2), avg(state[3]) FILTER (frame_index >= (start_step + end_step) // 2)] AS b FROM clip_frames GROUP BY sample_id)
    SELECT sample_id, {thousandths('list_transform(a, lambda x: x / greatest(sqrt(list_inner_product(a, a)), 1e-8))')} AS first_half, {thousandths('list_transform(b, lambda x: x / greatest(sqrt(list_inner_product(b, b)), 1e-8))')} AS second_half FROM p""")
def half_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(n.half_means(clip_frames(spark, sf), clips(spark, sf), "state"))


_RAW = """raw AS (SELECT sample_id, coalesce(avg(da), 0) AS action_smooth, coalesce(avg(ds), 0) AS state_transition, list_distance(arg_max(state, frame_index), arg_min(state, frame_index)) / 14 AS motion_efficiency
    FROM (SELECT *, list_distance(action, lag(action) OVER c) AS da, list_distance(state, lag(state) OVER c) AS ds FROM clip_frames WINDOW c AS (PARTITION BY sample_id ORDER BY frame_index)) GROUP BY sample_id)"""
_UNIT = "least(greatest(({x} - quantile_cont({x}, 0.01) OVER ()) / greatest(quantile_cont({x}, 0.99) OVER () - quantile_cont({x}, 0.01) OVER (), 1e-8), 0), 1)"
QUALITY = _RAW + f""", quality AS (SELECT sample_id, least(greatest(0.4 * (1 - {_UNIT.format(x='action_smooth')}) + 0.3 * {_UNIT.format(x='state_transition')} + 0.3 * {_UNIT.format(x='motion_efficiency')}, 0), 1) AS quality FROM raw)"""


@query(f"WITH {CLIPS}, {_RAW} SELECT sample_id, round(action_smooth, 6) AS action_smooth, round(state_transition, 6) AS state_transition, round(motion_efficiency, 6) AS motion_efficiency FROM raw")
def raw_quality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.raw_quality(clip_frames(spark, sf)))


@query(f"WITH {CLIPS}, {QUALITY} SELECT sample_id, round(quality, 6) AS quality, row_number() OVER (ORDER BY round(quality, 9) DESC, sample_id) AS place FROM quality")
def quality_ranked(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import selection

    scored = m.quality(m.raw_quality(clip_frames(spark, sf))).select("sample_id", F.round("quality", 9).alias("quality"), F.lit(15).alias("length"))
    return rounded(selection.ranked(scored, "quality").drop("length"))


@query(f"""WITH {FRAMES} SELECT episode_id, frame_index, round(coalesce(2 * list_distance(action, lag(action) OVER e), 0)
    + CASE WHEN count(*) OVER l >= 2 THEN (var_pop(action[1]) OVER l + var_pop(action[2]) OVER l) / 2 ELSE 0 END, 6) AS variation FROM frames
    WINDOW e AS (PARTITION BY episode_id ORDER BY frame_index), l AS (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def action_variation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.action_variation(tables.frames(spark, sf)).select("episode_id", "frame_index", "variation"))


_VARIATION = """variation AS (SELECT episode_id, frame_index, coalesce(2 * list_distance(action, lag(action) OVER e), 0)
    + CASE WHEN count(*) OVER l >= 2 THEN (var_pop(action[1]) OVER l + var_pop(action[2]) OVER l) / 2 ELSE 0 END AS v FROM frames
    WINDOW e AS (PARTITION BY episode_id ORDER BY frame_index), l AS (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""
_TOP = """top AS (SELECT sample_id, list_avg(list_slice(list(v ORDER BY v DESC), 1, 3)) AS t FROM clips c JOIN variation v ON v.episode_id = c.episode_id AND v.frame_index BETWEEN start_step AND end_step GROUP BY sample_id)"""


@query(f"WITH {CLIPS}, {_VARIATION}, {_TOP} SELECT sample_id, round(t, 6) AS top_mean FROM top")
def action_variation_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.top_k_mean(w.clip_frames(clips(spark, sf), m.action_variation(tables.frames(spark, sf))), "variation"))


@query(f"WITH {CLIPS}, {_VARIATION}, {_TOP} SELECT sample_id, round(1 - {_UNIT.format(x='t')}, 6) AS score FROM top")
def action_variation_score(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of the three largest, between quantiles, less of it being better."""
    top = m.top_k_mean(w.clip_frames(clips(spark, sf), m.action_variation(tables.frames(spark, sf))), "variation")
    return rounded(n.unit_interval(top, "top_mean", "score", reverse=True).select("sample_id", "score"))


@query(f"""WITH {FRAMES}, r AS (SELECT episode_id, frame_index, list_distance(state, lag(state) OVER e) / (list_distance(action, lag(action) OVER e) + 1e-8) AS c FROM frames WINDOW e AS (PARTITION BY episode_id ORDER BY frame_index))
    SELECT episode_id, frame_index, round(coalesce(c, lead(c) OVER (PARTITION BY episode_id ORDER BY frame_index)), 3) AS consistency FROM r""")
def visual_action_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.visual_action_consistency(tables.frames(spark, sf)).select("episode_id", "frame_index", "consistency"), 3)


@query(f"""WITH {CLIPS}, d AS (SELECT episode_id, frame_index, action[1] - lag(action[1]) OVER e AS x, action[2] - lag(action[2]) OVER e AS y FROM frames WINDOW e AS (PARTITION BY episode_id ORDER BY frame_index)),
    j AS (SELECT episode_id, frame_index, sqrt(((x / greatest(s, 1e-8)) ** 2 + (y / greatest(t, 1e-8)) ** 2) / 2) AS jump FROM d, (SELECT stddev_pop(action[1]) AS s, stddev_pop(action[2]) AS t FROM frames) WHERE x IS NOT NULL),
    r AS (SELECT sample_id, avg((jump > (SELECT quantile_cont(jump, 0.99) FROM j))::INT) AS rate FROM clips JOIN j ON j.episode_id = clips.episode_id AND j.frame_index > start_step AND j.frame_index <= end_step GROUP BY sample_id)
    SELECT sample_id, round(rate, 6) AS jump_rate, round(1 - rate, 6) AS jump_score FROM r""")
def jump_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.jump_rate(clips(spark, sf), m.action_jumps(tables.frames(spark, sf))))


#: The driver's three state columns as eight: position, a rotation vector, a constant, and a gripper between 0 and 1.
_EIGHT = "[state[1], state[2], state[3], state[1] / 50, state[2] / 50, state[3] / 12, 0, (state[2] > 50)::INT]"


def eight(rows: DataFrame) -> DataFrame:
    x = F.col("state")
    return rows.withColumn("state", F.array(x[0], x[1], x[2], x[0] / 50, x[1] / 50, x[2] / 12, F.lit(0.0), (x[1] > 50).cast("double")))


def _dwell(quaternion: str, grip: str) -> str:
    return f"""WITH {CLIPS}, e AS (SELECT sample_id, frame_index, "timestamp", {_EIGHT} AS s FROM clip_frames),
        r AS (SELECT *, sqrt(s[4] ** 2 + s[5] ** 2 + s[6] ** 2) AS a, s[4] / 2 AS x, s[5] / 2 AS y, s[6] / 2 AS z FROM e),
        q AS (SELECT *, {quaternion} AS q FROM r),
        d AS (SELECT sample_id, "timestamp" - lag("timestamp") OVER c AS dt, s, lag(s) OVER c AS was, q, lag(q) OVER c AS p FROM q WINDOW c AS (PARTITION BY sample_id ORDER BY frame_index)),
        t AS (SELECT *, list_distance(s[1:3], was[1:3]) AS moved, list_distance(q, p) AS apart, list_distance(q, list_transform(p, lambda v: -v)) AS along FROM d WHERE dt > 0)
        SELECT sample_id, round(sum(CASE WHEN moved / dt < 0.004 AND 4 * atan2(least(apart, along), greatest(apart, along)) / dt < 0.0002 AND {grip} THEN dt ELSE 0 END) / sum(dt), 6) AS dwell_ratio FROM t GROUP BY sample_id"""


@query(_dwell("CASE WHEN a = 0 THEN [1.0::DOUBLE, s[4] / 2, s[5] / 2, s[6] / 2] ELSE [cos(a / 2), s[4] * sin(a / 2) / a, s[5] * sin(a / 2) / a, s[6] * sin(a / 2) / a] END", "abs(s[8] - was[8]) / dt < 0.00005"))
def dwell_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.dwell_ratio(eight(clip_frames(spark, sf)), 0.004, 0.0002, 0.00005))


@query(_dwell("[cos(x) * cos(y) * cos(z) + sin(x) * sin(y) * sin(z), sin(x) * cos(y) * cos(z) - cos(x) * sin(y) * sin(z), cos(x) * sin(y) * cos(z) + sin(x) * cos(y) * sin(z), cos(x) * cos(y) * sin(z) - sin(x) * sin(y) * cos(z)]", "s[8] = was[8]"))
def dwell_ratio_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Euler angles, and a gripper that must not change."""
    return rounded(m.dwell_ratio(eight(clip_frames(spark, sf)), 0.004, 0.0002, None, "euler"))


def _paced(spark: SparkSession, sf: str) -> DataFrame:
    """Clip frames on the regular clock, with position and commanded motion."""
    return clip_frames(spark, sf).withColumns({"position": F.col("state"), "motion": F.concat("action", F.array(F.lit(0.0)))})


@query(f"""WITH {CLIPS}, t AS (SELECT sample_id, list_transform(range(1, 4), lambda i: state[i] - 3 * (lag(state, 1) OVER c)[i] + 3 * (lag(state, 2) OVER c)[i] - (lag(state, 3) OVER c)[i]) AS d, lag(state, 3) OVER c IS NOT NULL AS ok
    FROM clip_frames WINDOW c AS (PARTITION BY sample_id ORDER BY frame_index))
    SELECT sample_id, round(avg(sqrt(list_inner_product(d, d))) / 0.1 ** 3, 2) AS jerk, '' AS reason FROM t WHERE ok GROUP BY sample_id""")
def eef_jerk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.jerk(_paced(spark, sf), time="time10"), 2)


@query(f"WITH {CLIPS} SELECT sample_id, NULL::DOUBLE AS jerk, 'non_uniform_time' AS reason FROM clips")
def eef_jerk_real_time(spark: SparkSession, sf: str) -> DataFrame:
    return m.jerk(_paced(spark, sf))


@query(f"""WITH {CLIPS}, d AS (SELECT sample_id, frame_index, list_transform(range(1, 4), lambda i: state[i] - (lag(state) OVER c)[i]) AS d, lag(state) OVER c IS NOT NULL AS ok FROM clip_frames WINDOW c AS (PARTITION BY sample_id ORDER BY frame_index)),
    e AS (SELECT sample_id, d, lag(d) OVER (PARTITION BY sample_id ORDER BY frame_index) AS e FROM d WHERE ok),
    f AS (SELECT sample_id, sqrt(list_inner_product(d, d)) AS a, sqrt(list_inner_product(e, e)) AS b, list_inner_product(d, e) AS p FROM e WHERE e IS NOT NULL)
    SELECT sample_id, coalesce(sum((p / (a * b) < -0.5)::INT) FILTER (a > 30 AND b > 30), 0)::BIGINT AS backtracks, count(*) FILTER (a > 30 AND b > 30) AS pairs,
        round(avg((p / (a * b) < -0.5)::INT) FILTER (a > 30 AND b > 30), 6) AS rate, CASE WHEN count(*) FILTER (a > 30 AND b > 30) = 0 THEN 'no_valid_comparisons' ELSE '' END AS reason FROM f GROUP BY sample_id""")
def backtracking_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Steps count from a length of 30 on, so that some pairs are left out."""
    return rounded(m.backtracking(_paced(spark, sf), time="time10", least=30.0))


@query(f"WITH {CLIPS} SELECT sample_id, 0::BIGINT AS backtracks, 0::BIGINT AS pairs, NULL::DOUBLE AS rate, 'non_uniform_time' AS reason FROM clips")
def backtracking_rate_real_time(spark: SparkSession, sf: str) -> DataFrame:
    return m.backtracking(_paced(spark, sf))


@query(f"""WITH {CLIPS}, d AS (SELECT *, list_distance(state, lag(state) OVER (PARTITION BY sample_id ORDER BY frame_index)) AS d FROM clip_frames)
    SELECT sample_id, round(CASE WHEN sum(d) > 1e-6 THEN list_distance(arg_max(state, frame_index), arg_min(state, frame_index)) / sum(d) END, 6) AS efficiency FROM d GROUP BY sample_id""")
def path_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.path_efficiency(_paced(spark, sf)))


@query(f"""WITH {CLIPS}, d AS (SELECT sample_id, list_distance([n[1] - state[1], n[2] - state[2], n[3] - state[3]], [action[1] * 0.5, action[2] * 0.5, 0]) AS d FROM
    (SELECT *, lead(state) OVER (PARTITION BY sample_id ORDER BY frame_index) AS n FROM clip_frames) WHERE n IS NOT NULL)
    SELECT sample_id, round(avg(d), 6) AS deviation FROM d GROUP BY sample_id""")
def execution_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.execution_deviation(_paced(spark, sf), scale=0.5))


@query(f"""WITH {FRAMES}, g AS (SELECT episode_id, frame_index, state[2] / 100 AS g FROM frames)
    SELECT episode_id, frame_index, coalesce(first_value(CASE WHEN g > 0.95 THEN 1.0::DOUBLE WHEN g < 0.05 THEN -1.0::DOUBLE END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        CASE WHEN last_value(g) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) > 0.5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS gripper FROM g""")
def gripper_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    frames = tables.frames(spark, sf).select("episode_id", "frame_index", (F.col("state")[1] / 100).alias("g"))
    return m.gripper_states(frames, "g").drop("g")


#: Thresholds for the driver's numbers, which are no metres: value, k and hour stand for x, y and z.
_LIMITS = {0: 20.0, 1: 30.0, 2: 6.0}
_LABELS = """labels_ AS (SELECT episode_id, frame_index, CASE WHEN mv = '' THEN 'stop' ELSE 'move ' || mv END AS label FROM (SELECT episode_id, frame_index, concat_ws(' ',
    CASE WHEN d[1] > 20 THEN 'forward' WHEN d[1] < -20 THEN 'backward' END, CASE WHEN d[2] > 30 THEN 'left' WHEN d[2] < -30 THEN 'right' END, CASE WHEN d[3] > 6 THEN 'up' WHEN d[3] < -6 THEN 'down' END) AS mv
    FROM (SELECT episode_id, frame_index, [n[1] - state[1], n[2] - state[2], n[3] - state[3]] AS d FROM (SELECT *, lead(state, 7) OVER (PARTITION BY episode_id ORDER BY frame_index) AS n FROM frames) WHERE n IS NOT NULL)))"""
_COUNTS = _LABELS + ", counts AS (SELECT label, count(*) AS count, count(*) / sum(count(*)) OVER () AS proportion FROM labels_ GROUP BY label)"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return m.motion_primitives(tables.frames(spark, sf), "state", 7, _LIMITS)


@query(f"WITH {FRAMES}, {_LABELS} SELECT * FROM labels_")
def motion_primitives(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("episode_id", "frame_index", "label")


@query(f"WITH {FRAMES}, {_COUNTS} SELECT label, count, round(proportion, 6) AS proportion FROM counts")
def primitive_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.label_counts(_labelled(spark, sf)))


@query(f"WITH {FRAMES}, {_COUNTS} SELECT label, count, round(proportion, 6) AS proportion FROM counts WHERE proportion >= 0.05")
def frequent_primitives(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.frequent_labels(m.label_counts(_labelled(spark, sf)), 0.05))


_STOPPED = "stopped AS (SELECT * FROM counts UNION ALL SELECT 'stop', 0, 0 WHERE NOT EXISTS (SELECT 1 FROM counts WHERE label = 'stop'))"


@query(f"WITH {FRAMES}, {_COUNTS}, {_STOPPED} SELECT label, count, row_number() OVER (ORDER BY count DESC, label) - 1 AS label_id FROM stopped WHERE proportion > 0.02 OR label = 'stop'")
def primitive_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return m.label_catalog(m.label_counts(_labelled(spark, sf)), 0.02)


_ACTIONS = "actions AS (SELECT label, count, row_number() OVER (ORDER BY label = 'stop', count DESC, label) - 1 AS label_id FROM stopped WHERE label = 'stop' OR count >= greatest(20, ceil(0.05 * (SELECT sum(count) FROM counts))))"


def _actions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts = m.label_counts(_labelled(spark, sf))
    return counts, m.action_catalog(counts, 20, 0.05)


@query(f"WITH {FRAMES}, {_COUNTS}, {_STOPPED}, {_ACTIONS} SELECT * FROM actions")
def action_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return _actions(spark, sf)[1]


_ATOMS = "list_filter(string_split(regexp_replace(label, '^move ', ''), ' '), lambda x: x != '' AND x != 'stop')"


@query(f"""WITH {FRAMES}, {_COUNTS}, {_STOPPED}, {_ACTIONS}, a AS (SELECT label, {_ATOMS} AS own FROM counts), c AS (SELECT label, {_ATOMS} AS own FROM actions WHERE label != 'stop'),
    fits AS (SELECT a.label, c.label AS parent, len(c.own) AS k FROM a JOIN c ON list_has_all(a.own, c.own))
    SELECT label, parent FROM fits QUALIFY rank() OVER (PARTITION BY label ORDER BY k DESC) = 1 UNION ALL SELECT label, 'stop' FROM a WHERE label NOT IN (SELECT label FROM fits)""")
def retained_parents(spark: SparkSession, sf: str) -> DataFrame:
    return m.retained_parents(*_actions(spark, sf))


@query(f"""WITH {FRAMES}, {_COUNTS}, {_STOPPED}, kept AS (SELECT * FROM stopped WHERE proportion > 0.02 OR label = 'stop'), a AS (SELECT label, {_ATOMS} AS own FROM counts WHERE label NOT IN (SELECT label FROM kept)),
    parts AS (SELECT DISTINCT label, CASE WHEN len(own) = 1 THEN 'stop' ELSE 'move ' || array_to_string(list_concat(own[1:i - 1], own[i + 1:]), ' ') END AS target FROM a, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= len(own)),
    found AS (SELECT p.label, target, k.count, row_number() OVER w AS r, lead(k.count) OVER w AS later, lag(k.count) OVER w AS earlier FROM parts p JOIN kept k ON k.label = target WINDOW w AS (PARTITION BY p.label ORDER BY k.count DESC, target))
    SELECT label, label AS target, 1.0::DOUBLE AS weight FROM counts WHERE label IN (SELECT label FROM kept)
    UNION ALL SELECT label, target, CASE WHEN r = 1 AND (later IS NULL OR count > 4 * later) THEN 0.8::DOUBLE WHEN r = 1 THEN round(count / (count + later), 6) ELSE round(count / (count + earlier), 6) END FROM found WHERE r = 1 OR r = 2 AND earlier <= 4 * count
    UNION ALL SELECT label, 'stop', 0.8::DOUBLE FROM a WHERE label NOT IN (SELECT label FROM found)""")
def softened_primitives(spark: SparkSession, sf: str) -> DataFrame:
    counts = m.label_counts(_labelled(spark, sf))
    return rounded(m.softened(counts, m.label_catalog(counts, 0.02)))


_TURNED = """WITH {frames}, e AS (SELECT episode_id, frame_index, {eight} AS s FROM frames), n AS (SELECT episode_id, frame_index, s, lead(s, 4) OVER (PARTITION BY episode_id ORDER BY frame_index) AS n FROM e),
    d AS (SELECT episode_id, frame_index, list_transform(range(1, 9), lambda i: n[i] - s[i]) AS d FROM n WHERE n IS NOT NULL),
    t AS (SELECT episode_id, frame_index, d, CASE WHEN d[4] >= -pi() AND d[4] < pi() THEN d[4] ELSE d[4] - 2 * pi() * floor((d[4] + pi()) / (2 * pi())) END AS a, CASE WHEN d[6] >= -pi() AND d[6] < pi() THEN d[6] ELSE d[6] - 2 * pi() * floor((d[6] + pi()) / (2 * pi())) END AS c FROM d),
    l AS (SELECT episode_id, frame_index, concat_ws(' ', CASE WHEN d[1] > 20 THEN 'forward' WHEN d[1] < -20 THEN 'backward' END, CASE WHEN d[2] > 30 THEN 'left' WHEN d[2] < -30 THEN 'right' END, CASE WHEN d[3] > 6 THEN 'up' WHEN d[3] < -6 THEN 'down' END) AS mv,
        concat_ws(', ', CASE WHEN a > 0.8 THEN 'roll positive' WHEN a < -0.8 THEN 'roll negative' END, CASE WHEN d[5] > 0.8 THEN 'tilt down' WHEN d[5] < -0.8 THEN 'tilt up' END,
            CASE WHEN c > 0.8 THEN 'rotate counterclockwise' WHEN c < -0.8 THEN 'rotate clockwise' END, CASE WHEN d[8] > 0.8 THEN 'open gripper' WHEN d[8] < -0.8 THEN 'close gripper' END) AS tn FROM t)
    SELECT episode_id, frame_index, CASE WHEN mv = '' AND tn = '' THEN 'stop' WHEN mv = '' THEN tn WHEN tn = '' THEN 'move ' || mv ELSE 'move ' || mv || ', ' || tn END AS label FROM l"""


@query(_TURNED.format(frames=FRAMES, eight=_EIGHT))
def cyclic_primitives(spark: SparkSession, sf: str) -> DataFrame:
    """All seven axes: angles wrapped on two of them, the tokens of a third exchanged."""
    limits = _LIMITS | {3: 0.8, 4: 0.8, 5: 0.8, 7: 0.8}
    return m.motion_primitives(eight(tables.frames(spark, sf)), "state", 4, limits, cyclic=(3, 5), flipped=(4,)).select("episode_id", "frame_index", "label")


_PADDED = f"""WITH {FRAMES}, {_LABELS}, f AS (SELECT f.episode_id, f.frame_index, l.label FROM frames f LEFT JOIN labels_ l USING (episode_id, frame_index))
    SELECT episode_id, frame_index, coalesce(label, last_value(label IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS label FROM f"""


@query(_PADDED)
def padded_primitives(spark: SparkSession, sf: str) -> DataFrame:
    return m.motion_primitives(tables.frames(spark, sf), "state", 7, _LIMITS, "pad_last").select("episode_id", "frame_index", "label")


@query(_PADDED.replace("lead(state, 7) OVER (PARTITION BY episode_id ORDER BY frame_index)", "coalesce(lead(state, 7) OVER (PARTITION BY episode_id ORDER BY frame_index), last_value(state) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"))
def clipped_primitives(spark: SparkSession, sf: str) -> DataFrame:
    return m.motion_primitives(tables.frames(spark, sf), "state", 7, _LIMITS, "clip").select("episode_id", "frame_index", "label")


#: Clips' mean action as their embedding.
_EMBEDDED = """embedded AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS id, [avg(action[1]), avg(action[2])] AS v FROM clip_frames GROUP BY sample_id),
    near AS (SELECT id, list_slice(list(d ORDER BY d), 1, 10) AS d FROM (SELECT a.id, list_distance(a.v, b.v) AS d FROM embedded a JOIN embedded b ON a.id != b.id) GROUP BY id),
    supported AS (SELECT e.sample_id, exp(-list_max(d) / (median(list_max(d)) OVER () + 1e-8)) AS support FROM near JOIN embedded e USING (id))"""


def clip_support(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import similarity

    rows = clip_frames(spark, sf).groupBy("sample_id").agg(F.array(F.avg(F.col("action")[0]), F.avg(F.col("action")[1])).alias("vec"))
    rows = stored(rows.withColumn("id", F.xxhash64("sample_id")))
    return similarity.support(rows, 10).join(rows.select("id", "sample_id"), "id").select("sample_id", "support")


@query(f"""WITH {CLIPS}, {_EMBEDDED}, s AS (SELECT *, action[1] - 2 * lag(action[1]) OVER c + lag(action[1], 2) OVER c AS j, coalesce(action[2] - lag(action[2]) OVER c, 0) AS g FROM clip_frames WINDOW c AS (PARTITION BY sample_id ORDER BY frame_index)),
    per AS (SELECT sample_id, arg_min(state, frame_index) AS a, arg_max(state, frame_index) AS b, coalesce(median(abs(j)), 0) AS jm, avg((abs(action[1]) < 0.01 AND abs(g) < 0.01)::INT) AS noop FROM s GROUP BY sample_id),
    parts AS (SELECT sample_id, list_distance(a[1:2], b[1:2]) AS ee, abs(b[3] - a[3]) AS g, jm, noop,
        list_distance(list_transform(a, lambda x: x / greatest(sqrt(list_inner_product(a, a)), 1e-8)), list_transform(b, lambda x: x / greatest(sqrt(list_inner_product(b, b)), 1e-8))) AS seen FROM per),
    done AS (SELECT sample_id, support, 0.5 + 0.5 * (1 - exp(-(ee / (stddev_pop(ee) OVER () + 1e-8) + 0.5 * g / (stddev_pop(g) OVER () + 1e-8) + 0.25 * seen))) AS progress, exp(-jm / (median(jm) OVER () + 1e-8)) AS smoothness, 1 - noop AS activity FROM parts JOIN supported USING (sample_id))
    SELECT sample_id, round(support, 6) AS support, round(progress, 6) AS progress, round(smoothness, 6) AS smoothness, round(activity, 6) AS activity,
        round(least(greatest(sqrt(support) * sqrt(progress) * smoothness ** 0.25 * sqrt(activity), 0.05), 1), 6) AS reliability FROM done""")
def progress_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """The state as the visual feature; an action below 0.01 does nothing."""
    return rounded(m.progress_reliability(clip_frames(spark, sf), clip_support(spark, sf), "state", idle=0.01))


@query(f"""WITH {CLIPS}, d AS (SELECT *, list_distance(state, lag(state) OVER (PARTITION BY sample_id ORDER BY frame_index)) AS d FROM clip_frames),
    a AS (SELECT sample_id, CASE WHEN sum(d) > 300 THEN list_distance(arg_max(state, frame_index), arg_min(state, frame_index)) / sum(d) END AS x, avg((d < 50)::INT) AS y FROM d GROUP BY sample_id)
    SELECT sample_id, round(least(greatest(CASE WHEN x IS NULL THEN y ELSE sqrt(x * y) END, 0.05), 1), 6) AS reliability FROM a""")
def fused_reliability(spark: SparkSession, sf: str) -> DataFrame:
    rows = _paced(spark, sf)
    steps = rows.withColumn("d", n.distance(F.col("state"), F.lag("state").over(m.in_clip())))
    calm = steps.groupBy("sample_id").agg(F.avg((F.col("d") < 50).cast("double")).alias("calm"))
    joined = m.path_efficiency(rows, least=300.0).join(calm, "sample_id")
    return rounded(m.fuse_reliability(joined, ["efficiency", "calm"]).select("sample_id", "reliability"))
