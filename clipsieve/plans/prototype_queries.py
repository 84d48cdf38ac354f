"""Prototypes, diagnostics, rotations, joins of runs and settings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregates as a
from ..operators import motion as m
from ..operators import projection as j
from ..operators import prototypes as p
from ..sources import tables
from .base import CLIPS, FRAMES, VECTORS, query, rounded, thousandths
from .motion_queries import _ACTIONS, _ATOMS, _COUNTS, _EIGHT, _STOPPED, _actions, _labelled, clip_frames, eight
from .score_queries import vectors
from .window_queries import clips


@query(f"WITH {FRAMES}, {_COUNTS} SELECT label, least(count, least(30, greatest(10, floor(4 * log2(count) - 30))))::BIGINT AS centres FROM counts")
def centre_counts(spark: SparkSession, sf: str) -> DataFrame:
    return m.label_counts(_labelled(spark, sf)).select("label", p.centre_count(F.col("count")).alias("centres"))


_PARENTS = f"""{_ACTIONS}, own AS (SELECT label, count, {_ATOMS} AS own FROM counts), kept AS (SELECT label, {_ATOMS} AS theirs FROM actions WHERE label != 'stop'),
    fits AS (SELECT o.label, k.label AS parent, len(k.theirs) AS size FROM own o JOIN kept k ON list_has_all(o.own, k.theirs)),
    parents AS (SELECT label, parent, size FROM fits QUALIFY rank() OVER (PARTITION BY label ORDER BY size DESC) = 1)"""


@query(f"WITH {FRAMES}, {_COUNTS}, {_STOPPED}, {_PARENTS} SELECT label, parent, round(CASE WHEN label = parent THEN 1 ELSE 0.5 + 0.5 * size / len((SELECT own FROM own o WHERE o.label = parents.label)) END, 6) AS weight FROM parents UNION ALL SELECT label, 'stop', CASE WHEN label = 'stop' THEN 1 ELSE 0.5 END FROM own WHERE label NOT IN (SELECT label FROM fits)")
def retention_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = m.retained_parents(*_actions(spark, sf))
    return rounded(rows.withColumn("weight", p.retention_weight(F.col("label"), F.col("parent"))))


@query(f"""WITH {FRAMES}, {_COUNTS}, {_STOPPED}, {_PARENTS}, best AS (SELECT label, max(size) AS size FROM parents GROUP BY label),
    r AS (SELECT o.label, o.count, len(o.own) AS n, o.label IN (SELECT label FROM kept) AS kept, coalesce(b.size, 0) AS size FROM own o LEFT JOIN best b ON b.label = o.label)
    SELECT sum(count)::BIGINT AS windows, count(*) AS labels, sum(kept::INT)::BIGINT AS retained, round(sum(count) FILTER (kept) / sum(count), 6) AS exact,
        round(coalesce(sum(count) FILTER (label != 'stop' AND NOT kept AND size > 0), 0) / sum(count), 6) AS by_parent, round(coalesce(sum(count) FILTER (label != 'stop' AND size = 0), 0) / sum(count), 6) AS no_parent,
        round(coalesce(sum(count) FILTER (label = 'stop'), 0) / sum(count), 6) AS stop, round(sum(count * size / n) FILTER (label != 'stop') / sum(count), 6) AS kept_actions,
        round(sum(count * size) FILTER (label != 'stop') / sum(count * n) FILTER (label != 'stop'), 6) AS kept_atoms, (SELECT sum(least(count, least(30, greatest(10, floor(4 * log2(count) - 30)))))::BIGINT FROM actions WHERE count > 0) AS leaves FROM r""")
def label_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(p.label_diagnostics(*_actions(spark, sf)))


_SOFT = f"""kept AS (SELECT *, row_number() OVER (ORDER BY count DESC, label) - 1 AS label_id FROM stopped WHERE proportion > 0.02 OR label = 'stop'), a AS (SELECT label, {_ATOMS} AS own FROM counts WHERE label NOT IN (SELECT label FROM kept)),
    parts AS (SELECT DISTINCT label, CASE WHEN len(own) = 1 THEN 'stop' ELSE 'move ' || array_to_string(list_concat(own[1:i - 1], own[i + 1:]), ' ') END AS target FROM a, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= len(own)),
    found AS (SELECT p.label, target, k.count, row_number() OVER w AS r, lead(k.count) OVER w AS later, lag(k.count) OVER w AS earlier FROM parts p JOIN kept k ON k.label = target WINDOW w AS (PARTITION BY p.label ORDER BY k.count DESC, target)),
    soft AS (SELECT label, label AS target, 1.0::DOUBLE AS weight FROM counts WHERE label IN (SELECT label FROM kept)
        UNION ALL SELECT label, target, CASE WHEN r = 1 AND (later IS NULL OR count > 4 * later) THEN 0.8 WHEN r = 1 THEN count / (count + later) ELSE count / (count + earlier) END FROM found WHERE r = 1 OR r = 2 AND earlier <= 4 * count
        UNION ALL SELECT label, 'stop', 0.8 FROM a WHERE label NOT IN (SELECT label FROM found))"""


@query(f"""WITH {CLIPS}, {_COUNTS}, {_STOPPED}, {_SOFT}, merged AS (SELECT sample_id, target, max(weight) AS weight FROM clips c JOIN labels_ l ON l.episode_id = c.episode_id AND l.frame_index IN (start_step, start_step + 7) JOIN soft USING (label) GROUP BY 1, 2)
    SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY m.weight DESC, k.count DESC, target) - 1)::INT AS slot, target AS label, label_id, round(m.weight, 6) AS weight FROM merged m JOIN kept k ON k.label = target""")
def anchored_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    """A clip's labels from its first to its eighth frame, and from there to its last."""
    labelled = _labelled(spark, sf)
    counts = m.label_counts(labelled)
    anchors = clips(spark, sf).select("sample_id", "episode_id", F.explode(F.array("start_step", F.col("start_step") + 7)).alias("frame_index"))
    return rounded(p.anchored_prototypes(anchors.join(labelled.select("episode_id", "frame_index", "label"), ["episode_id", "frame_index"]).select("sample_id", "label"), counts, m.label_catalog(counts, 0.02)))


_HALVES = """halves AS (SELECT sample_id, h, sample_id || '/' || h AS half, arg_min(event_type, frame_index) AS action, [avg(state[1]), avg(state[2]), avg(state[3])] AS vec
        FROM (SELECT *, (frame_index > start_step + 7)::INT AS h FROM clip_frames) GROUP BY sample_id, h),
    leaves AS (SELECT action, (row_number() OVER (ORDER BY action, k) - 1)::BIGINT AS leaf, [20.0 + 30 * k, 70.0 - 20 * k, 6.0 + 5 * k] AS centre FROM (SELECT DISTINCT event_type AS action FROM events), (SELECT unnest([0, 1, 2]) AS k)),
    near AS (SELECT half, sample_id, action, leaf, list_distance(vec, centre::DOUBLE[]) AS distance FROM halves JOIN leaves USING (action) QUALIFY row_number() OVER (PARTITION BY half ORDER BY distance, leaf) = 1),
    bounds AS (SELECT action, quantile_cont(distance, 0.1) AS low, quantile_cont(distance, 0.9) AS high FROM near GROUP BY action)"""


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = clip_frames(spark, sf).join(clips(spark, sf).select("sample_id", F.col("start_step").alias("first")), "sample_id").withColumn("h", (F.col("frame_index") > F.col("first") + 7).cast("int"))
    # summed in the frames' order: a half as near to two leaves as can be must not change sides with the order in which a shuffle brings its frames
    mean = p.ordered_mean("state", "frame_index", 3)
    halves = rows.groupBy("sample_id", "h").agg(F.min_by("event_type", "frame_index").alias("action"), mean.alias("vec")).withColumn("half", F.concat_ws("/", "sample_id", "h"))
    every = tables.table(spark, sf, "events").select(F.col("event_type").alias("action")).distinct().agg(F.array_sort(F.collect_list("action")).alias("names")).select(F.posexplode("names").alias("k", "action"))
    j_ = F.posexplode(F.array(*[F.array(F.lit(20.0 + 30 * k), F.lit(70.0 - 20 * k), F.lit(6.0 + 5 * k)) for k in range(3)])).alias("i", "centre")
    return halves, every.select("action", "k", j_).select("action", (F.col("k") * 3 + F.col("i")).cast("long").alias("leaf"), "centre")


@query(f"WITH {CLIPS}, {_HALVES} SELECT half, leaf, round(distance, 6) AS distance FROM near")
def nearest_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(p.nearest_leaf(*_halves(spark, sf)).select("half", "leaf", "distance"))


@query(f"WITH {CLIPS}, {_HALVES} SELECT action, round(low, 6) AS low, round(high, 6) AS high FROM bounds")
def distance_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(p.distance_bounds(p.nearest_leaf(*_halves(spark, sf))))


@query(f"WITH {CLIPS}, {_HALVES} SELECT action, leaf, count(*) AS mass, round(avg(distance), 6) AS mean_distance FROM near GROUP BY action, leaf")
def centre_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(p.centre_statistics(p.nearest_leaf(*_halves(spark, sf))))


@query(f"""WITH {CLIPS}, {_HALVES}, weighed AS (SELECT sample_id, leaf, CASE WHEN high = low THEN 1 ELSE least(greatest(1 - 0.7 * (distance - low) / (high - low), 0.3), 1) END AS w FROM near JOIN bounds USING (action))
    SELECT sample_id, leaf, round((max(w) + CASE WHEN count(*) > 1 THEN 0.5 * min(w) ELSE 0 END)::DOUBLE, 3) AS weight FROM weighed GROUP BY 1, 2""")
def merged_leaves(spark: SparkSession, sf: str) -> DataFrame:
    near = p.nearest_leaf(*_halves(spark, sf))
    weighed = near.join(F.broadcast(p.distance_bounds(near)), "action").withColumn("weight", p.distance_confidence(F.col("distance"), F.col("low"), F.col("high")))
    return p.merge_halves(weighed, "double").select("sample_id", "leaf", F.round("weight", 3).alias("weight"))


@query(f"""WITH {FRAMES}, x AS (SELECT episode_id, frame_index, {_EIGHT} AS s FROM frames), t AS (SELECT *, cos(s[4]) AS cx, sin(s[4]) AS sx, cos(s[5]) AS cy, sin(s[5]) AS sy, cos(s[6]) AS cz, sin(s[6]) AS sz FROM x),
    r AS (SELECT *, acos(least(greatest((cz * cy + sz * sy * sx + cz * cx + cy * cx - 1) / 2, -1), 1)) AS ang FROM t)
    SELECT episode_id, frame_index, round(ang, 4) AS angle, round(CASE WHEN ang < 3 AND ang > 0.01 THEN ang / (2 * sin(ang)) * (cy * sx - (cz * sy * cx * 0 + sz * sy * cx - cz * sx)) END, 4) AS x,
        round(CASE WHEN ang < 3 AND ang > 0.01 THEN ang / (2 * sin(ang)) * (cz * sy * cx + sz * sx + sy) END, 4) AS y, round(CASE WHEN ang < 3 AND ang > 0.01 THEN ang / (2 * sin(ang)) * (sz * cy - (cz * sy * sx - sz * cx)) END, 4) AS z,
        CASE WHEN s[8] > 0.5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS gripper FROM r""")
def environment_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Euler angles to rotation vectors; near half a turn the axis has two signs, so there only the angle is shown."""
    rows = eight(tables.frames(spark, sf)).withColumn("act", F.concat(F.slice("state", 1, 6), F.array(F.col("state")[7])))
    got = rows.select("episode_id", "frame_index", scalar.environment_action(F.col("act")).alias("e"), scalar.euler_trace_angle(F.slice("act", 4, 3)).alias("traced"))
    turn = lambda k: F.col("e")[3 + k]
    angle = F.sqrt(turn(0) * turn(0) + turn(1) * turn(1) + turn(2) * turn(2))
    # a turn of 0.01 or 3 itself falls to the side of the cut to which the matrix's trace rounds it
    shown = lambda k: F.round(F.when((F.col("traced") < 3) & (F.col("traced") > 0.01), turn(k)), 4)
    return got.select("episode_id", "frame_index", F.round(angle, 4).alias("angle"), shown(0).alias("x"), shown(1).alias("y"), shown(2).alias("z"), F.col("e")[6].alias("gripper"))


@query(f"""WITH {VECTORS}, d AS (SELECT v.id, c.id AS prototype, -(list_distance(v.vec, c.vec) ** 2) / 0.5 AS l FROM vectors v, vectors c WHERE c.id < 6),
    s AS (SELECT id, prototype, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM d), q AS (SELECT id, prototype, e / sum(e) OVER (PARTITION BY id) AS w FROM s)
    SELECT id, prototype, round(w, 6) AS weight FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, prototype) <= 3""")
def soft_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    """Six vectors as centres (they are a fitted model's otherwise, and bounded)."""
    rows = vectors(spark, sf)
    centres = np.array([r["vec"] for r in rows.filter("id < 6").orderBy("id").collect()])
    return rounded(j.soft_prototypes(rows, "vec", centres, ["id"], temperature=0.5))


@query(f"""WITH {FRAMES}, w AS (SELECT episode_id, frame_index AS start_step, [avg(state[1]) OVER e, avg(state[2]) OVER e, avg(state[3]) OVER e] AS v, count(*) OVER e AS n FROM frames WINDOW e AS (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
    SELECT episode_id, start_step, {thousandths('list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-8))')} AS mean FROM w WHERE n = 8""")
def window_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(j.window_means(tables.frames(spark, sf), "state", 3, 8))


@query(f"""WITH {CLIPS}, e AS (SELECT sample_id, arg_min(state, frame_index) AS a, arg_max(state, frame_index) AS b FROM clip_frames GROUP BY sample_id)
    SELECT sample_id, round(list_distance(list_transform(a, lambda x: x / greatest(sqrt(list_inner_product(a, a)), 1e-8)), list_transform(b, lambda x: x / greatest(sqrt(list_inner_product(b, b)), 1e-8))), 6) AS progress FROM e""")
def visual_progress(spark: SparkSession, sf: str) -> DataFrame:
    rows = clip_frames(spark, sf)
    return rounded(rows.groupBy("sample_id").agg(m.progress_of(rows, "state").alias("progress")))


@query("SELECT count(*) AS source, sum((trim(t) != '')::INT)::BIGINT AS indexed, sum((trim(t) = '')::INT)::BIGINT AS excluded FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS t FROM customer)")
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return a.dataset_summary(tables.table(spark, sf, "customer").select(F.when(key % 7 == 0, " ").when(key % 11 == 0, "").otherwise(F.col("c_mktsegment")).alias("task_name")))


_RUNS = "results AS (SELECT o_custkey AS candidate, o_orderpriority AS task, avg(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_orderstatus = 'F')::INT END) AS rate FROM orders GROUP BY 1, 2)"


@query(f"WITH {_RUNS}, f AS (SELECT candidate, count(DISTINCT task) FILTER (rate IS NOT NULL) AS n FROM results GROUP BY 1) SELECT c_custkey AS candidate, coalesce(n, 0) AS finished, CASE WHEN coalesce(n, 0) >= 4 THEN 'complete' WHEN n > 0 THEN 'partial' ELSE 'not_started' END AS status FROM customer LEFT JOIN f ON candidate = c_custkey")
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    orders = tables.table(spark, sf, "orders")
    rate = F.avg(F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F").cast("double")))
    results = orders.groupBy(F.col("o_custkey").alias("candidate"), F.col("o_orderpriority").alias("task")).agg(rate.alias("rate"))
    return a.run_status(tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate")), results, 4)


@query("""WITH r AS (SELECT n_nationkey AS run, n_regionkey AS task, n_nationkey % 3 AS horizon, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS seeds FROM nation),
    b AS (SELECT r_regionkey AS task, r_regionkey % 3 AS horizon, CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END AS seeds FROM region)
    SELECT run, task, field FROM (SELECT run, r.task, 'horizon' AS field FROM r JOIN b USING (task) WHERE r.horizon IS DISTINCT FROM b.horizon UNION ALL SELECT run, r.task, 'seeds' FROM r JOIN b USING (task) WHERE r.seeds IS DISTINCT FROM b.seeds)""")
def protocol_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    runs = tables.table(spark, sf, "nation").select(key.alias("run"), region.alias("task"), (key % 3).alias("horizon"), F.when(key % 4 != 0, region).alias("seeds"))
    of = F.col("r_regionkey")
    base = tables.table(spark, sf, "region").select(of.alias("task"), (of % 3).alias("horizon"), F.when(of != 0, of).alias("seeds"))
    return a.protocol_mismatches(runs, base, ["horizon", "seeds"])


@query("""SELECT coalesce(m.position, w.position) AS position, CASE WHEN m.position IS NULL THEN 'not in the manifest' WHEN w.position IS NULL THEN 'no weights' ELSE 'differs' END AS problem
    FROM (SELECT s_suppkey AS position, s_acctbal::DOUBLE AS x FROM supplier WHERE s_suppkey % 9 != 0) m FULL JOIN (SELECT s_suppkey AS position, s_acctbal::DOUBLE + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS x FROM supplier WHERE s_suppkey % 8 != 0) w ON m.position = w.position
    WHERE m.position IS NULL OR w.position IS NULL OR abs(m.x - w.x) > 0.5""")
def manifest_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_acctbal").cast("double").alias("x"))
    return a.manifest_mismatches(rows.filter("position % 9 != 0"), rows.filter("position % 8 != 0").withColumn("x", F.col("x") + F.when(F.col("position") % 5 == 0, 1.0).otherwise(0.0)), ["x"])


@query("""WITH s AS (SELECT DISTINCT o_orderpriority AS selection, o_custkey AS sample_id FROM orders WHERE o_orderkey % 3 = 0) SELECT a.selection AS a, b.selection AS b, count(*) AS common FROM s a JOIN s b ON a.sample_id = b.sample_id AND a.selection < b.selection GROUP BY 1, 2""")
def selection_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return a.overlap(tables.table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderpriority").alias("selection"), F.col("o_custkey").alias("sample_id")))


@query("""SELECT l_suppkey AS run, 0.9 * avg(l_extendedprice::DOUBLE) FILTER (l_linenumber > 1) + 0.1 * avg(l_extendedprice::DOUBLE) FILTER (l_linenumber = 1) <= 0.95 * 36000 AS faster, round(0.9 * avg(l_extendedprice::DOUBLE) FILTER (l_linenumber > 1) + 0.1 * avg(l_extendedprice::DOUBLE) FILTER (l_linenumber = 1), 4) AS seconds FROM lineitem GROUP BY 1""")
def phase_speeds(spark: SparkSession, sf: str) -> DataFrame:
    """Nine parts of one phase and one of the other, against a base of 36,000."""
    price, first = F.col("l_extendedprice").cast("double"), F.col("l_linenumber") == 1
    rows = tables.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(a.phase_mix(F.avg(F.when(~first, price)), F.avg(F.when(first, price))).alias("seconds"))
    return rows.select("run", a.is_faster(F.col("seconds"), F.lit(36000.0)).alias("faster"), F.round("seconds", 4).alias("seconds"))


@query(f"""WITH {CLIPS}, d AS (SELECT *, list_distance(state, lag(state) OVER (PARTITION BY sample_id ORDER BY frame_index)) AS d FROM clip_frames), e AS (SELECT sample_id, CASE WHEN sum(d) > 500 THEN list_distance(arg_max(state, frame_index), arg_min(state, frame_index)) / sum(d) END AS x FROM d GROUP BY sample_id)
    SELECT CASE WHEN x IS NULL THEN 'still' ELSE '' END AS reason, count(*) AS n, round(avg(x), 6) AS mean FROM e GROUP BY 1""")
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = m.path_efficiency(clip_frames(spark, sf).withColumn("position", F.col("state")), least=500.0)
    return rounded(a.metric_summary(rows.withColumn("reason", F.when(F.col("efficiency").isNull(), "still").otherwise("")), "efficiency", "reason"))
