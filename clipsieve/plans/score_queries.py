"""Similarity scores over ``embeddings`` (label as task), summaries and success rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..operators import normalize as n
from ..operators import similarity as s
from ..operators.stored import stored
from ..sources import tables
from .base import CLIPS, FRAMES, VECTORS, query, rounded, thousandths
from .motion_queries import _UNIT, QUALITY, clip_frames

SIGMA = 1.5


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


@query(f"WITH {VECTORS} SELECT id, {thousandths('list_transform(vec, lambda x: x / greatest(sqrt(list_inner_product(vec, vec)), 1e-8))')} AS unit FROM vectors")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors(spark, sf).select("id", n.l2_normalise(F.col("vec")).alias("unit")))


_AFFINITY = f"affinity AS (SELECT v.id, avg(exp(-(list_distance(v.vec, r.vec) ** 2) / (2 * {SIGMA} ** 2))) AS affinity FROM vectors v, vectors r WHERE r.label < 3 GROUP BY v.id)"


@query(f"WITH {VECTORS}, {_AFFINITY} SELECT id, round(affinity, 6) AS affinity FROM affinity")
def rbf_affinity(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return rounded(s.mean_affinity(rows, rows.filter("label < 3"), SIGMA))


@query(f"WITH {VECTORS}, {_AFFINITY} SELECT id, round({_UNIT.format(x='affinity')}, 6) AS coverage FROM affinity")
def sqcn_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return rounded(n.unit_interval(s.mean_affinity(rows, rows.filter("label < 3"), SIGMA), "affinity", "coverage").drop("affinity"))


@query(f"""WITH {VECTORS}, k AS (SELECT a.label < 3 AS x, b.label < 3 AS y, exp(-(list_distance(a.vec, b.vec) ** 2) / (2 * {SIGMA} ** 2)) AS k FROM vectors a, vectors b)
    SELECT round(greatest(avg(k) + avg(k) FILTER (x AND y) - 2 * avg(k) FILTER (y), 0), 6) AS mmd2 FROM k""")
def coverage_mmd(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return rounded(s.mmd_squared(rows, rows.filter("label < 3"), SIGMA))


@query(f"""WITH {VECTORS}, k AS (SELECT a.id, avg(exp(-(list_distance(a.vec, b.vec) ** 2) / (2 * {SIGMA} ** 2))) AS k FROM vectors a, vectors b GROUP BY a.id)
    SELECT id, round(exp(-greatest((SELECT avg(k) FROM k) + 1 - 2 * k, 0)), 6) AS coverage FROM k""")
def tdus_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return rounded(s.single_coverage(rows, rows, SIGMA))


_KNN = "knn AS (SELECT id, list_slice(list(d ORDER BY d), 1, 20) AS d FROM (SELECT a.id, list_distance(a.vec, b.vec) AS d FROM vectors a JOIN vectors b ON a.id != b.id) GROUP BY id)"


@query(f"WITH {VECTORS}, {_KNN}, raw AS (SELECT id, list_avg(d) AS r FROM knn) SELECT id, round(r, 6) AS novelty_raw, round({_UNIT.format(x='r')}, 6) AS novelty FROM raw")
def knn_novelty(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.novelty(vectors(spark, sf)))


@query(f"WITH {VECTORS}, {_KNN}, far AS (SELECT id, d[10] AS f FROM knn) SELECT id, round(exp(-f / (median(f) OVER () + 1e-8)), 6) AS support FROM far")
def knn_support_exponential(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.support(vectors(spark, sf), 10))


@query(f"WITH {VECTORS}, {_KNN}, far AS (SELECT id, d[1:10] AS d, median(d[10]) OVER () AS f FROM knn) SELECT id, round((len(list_filter(d, lambda x: x <= f)) + 1) / 11, 6) AS support FROM far")
def knn_support_radius(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.support(vectors(spark, sf), 10, "radius"))


@query(f"""WITH {VECTORS} SELECT a.id, round(1 - avg((list_cosine_similarity(a.vec, b.vec) + 1) / 2), 6) AS diversity FROM vectors a JOIN vectors b ON a.id != b.id GROUP BY a.id""")
def sample_diversity(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return rounded(s.diversity(rows, rows))


@query(f"WITH {VECTORS} SELECT round(1 - avg((list_cosine_similarity(a.vec, b.vec) + 1) / 2), 6) AS diversity FROM vectors a JOIN vectors b ON a.id < b.id AND a.label = 4 AND b.label = 4")
def subset_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.subset_diversity(vectors(spark, sf).filter("label = 4")))


#: A clip's embedding: means of its state columns, brought to one scale.
_CLIP_VECTORS = "clip_vectors AS (SELECT sample_id, [avg(state[1]) / 100, avg(state[2]) / 100, avg(state[3]) / 24] AS vec FROM clip_frames GROUP BY sample_id)"
CLIP_SIGMA = 0.2


def clip_vectors(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda k: F.avg(F.col("state")[k])
    rows = clip_frames(spark, sf).groupBy("sample_id").agg(F.array(mean(0) / 100, mean(1) / 100, mean(2) / 24).alias("vec"))
    return rows.withColumn("id", F.xxhash64("sample_id"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """``sample_id, length, quality, coverage, diversity, novelty``: motion quality joined with the scores of the clips' embeddings.

    Coverage is the mean affinity to all clips between quantiles, novelty the mean
    distance to the twenty nearest, diversity one less the mean scaled cosine.
    """
    from ..operators import motion as m

    rows = stored(clip_vectors(spark, sf))
    coverage = n.unit_interval(stored(s.mean_affinity(rows, rows, CLIP_SIGMA)), "affinity", "coverage").select("id", "coverage")
    found = coverage.join(s.novelty(rows).select("id", "novelty"), "id").join(s.diversity(rows, rows), "id").join(rows.select("id", "sample_id"), "id").drop("id")
    return m.quality(stored(m.raw_quality(clip_frames(spark, sf)))).select("sample_id", "quality", F.lit(15).alias("length")).join(found, "sample_id")


_SCORES = f"""WITH {CLIPS}, {QUALITY}, {_CLIP_VECTORS},
    pairs AS (SELECT a.sample_id, a.sample_id = b.sample_id AS own, list_distance(a.vec, b.vec) AS d, list_cosine_similarity(a.vec, b.vec) AS c FROM clip_vectors a, clip_vectors b),
    embedded AS (SELECT sample_id, avg(exp(-(d ** 2) / (2 * {CLIP_SIGMA} ** 2))) AS affinity, 1 - avg((c + 1) / 2) FILTER (NOT own) AS diversity, list_avg(list_slice(list(d ORDER BY d) FILTER (NOT own), 1, 20)) AS far FROM pairs GROUP BY sample_id),
    scores AS (SELECT q.sample_id, quality, {_UNIT.format(x='affinity')} AS coverage, {_UNIT.format(x='far')} AS novelty, diversity FROM quality q JOIN embedded USING (sample_id))"""


@query(_SCORES + " SELECT sample_id, round(least(greatest(0.8 * quality + 0.1 * coverage + 0.1 * novelty, 0), 1), 6) AS sqcn FROM scores")
def sqcn_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.combined(scores(spark, sf), {"quality": 0.8, "coverage": 0.1, "novelty": 0.1}, "sqcn").select("sample_id", "sqcn"))


TDUS = {"quality": 0.4, "coverage": 0.2, "diversity": 0.2, "novelty": 0.2}


@query(_SCORES + " SELECT sample_id, round(least(greatest(0.4 * quality + 0.2 * coverage + 0.2 * diversity + 0.2 * novelty, 0), 1), 6) AS tdus FROM scores")
def tdus_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.combined(scores(spark, sf), TDUS, "tdus").select("sample_id", "tdus"))


@query(f"WITH {FRAMES} SELECT (i - 1)::INT AS dim, count(*) AS n, round(avg(state[i]), 6) AS mean, round(stddev_pop(state[i]), 6) AS std, round(min(state[i]), 6) AS min, round(max(state[i]), 6) AS max FROM frames, (SELECT unnest(range(1, 4)) AS i) GROUP BY i")
def running_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(a.moments(tables.frames(spark, sf), "state"))


@query(f"""WITH {FRAMES}, d AS (SELECT [n[1] - state[1], n[2] - state[2], n[3] - state[3]] AS d FROM (SELECT *, lead(state) OVER (PARTITION BY episode_id ORDER BY frame_index) AS n FROM frames) WHERE n IS NOT NULL)
    SELECT (i - 1)::INT AS dim, round(avg((abs(d[i]) > 20)::INT), 6) AS beyond, round(avg((d[i] > 20)::INT), 6) AS above, round(avg((d[i] < -20)::INT), 6) AS below,
    round(quantile_cont(abs(d[i]), 0.5), 6) AS q50, round(quantile_cont(abs(d[i]), 0.9), 6) AS q90, round(quantile_cont(abs(d[i]), 0.99), 6) AS q99 FROM d, (SELECT unnest(range(1, 4)) AS i) GROUP BY i""")
def axis_statistics(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = tables.frames(spark, sf).withColumn("n", F.lead("state").over(W.partitionBy("episode_id").orderBy("frame_index"))).filter("n IS NOT NULL")
    return rounded(a.axis_statistics(rows.select(F.zip_with("n", "state", lambda x, y: x - y).alias("d")), "d", 20.0))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as evaluation episodes: task = priority, seed = key mod 3, a success if the order is filled."""
    orders = tables.table(spark, sf, "orders")
    return orders.select(F.col("o_orderpriority").alias("task"), (F.col("o_orderkey") % 3).alias("seed"), (F.col("o_orderstatus") == "F").alias("success"), (F.col("o_custkey") % 7).alias("experiment"))


_RESULTS = "results AS (SELECT o_orderpriority AS task, o_orderkey % 3 AS seed, o_orderstatus = 'F' AS success, o_custkey % 7 AS experiment FROM orders)"


@query(f"WITH {_RESULTS} SELECT task, seed, count(*) AS episodes, sum(success::INT)::BIGINT AS successes, (count(*) - sum(success::INT))::BIGINT AS failures, round(avg(success::INT), 6) AS rate FROM results GROUP BY GROUPING SETS ((), (task), (seed))")
def success_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(a.success_rates(results(spark, sf)))


@query(f"""WITH {_RESULTS}, tasks AS (SELECT DISTINCT o_orderpriority AS task FROM orders UNION ALL SELECT r_name FROM region)
    SELECT task, (SELECT count(*) FROM results r WHERE r.task = tasks.task) AS episodes, (SELECT round(avg(success::INT), 6) FROM results r WHERE r.task = tasks.task) AS rate FROM tasks""")
def success_by_listed_task(spark: SparkSession, sf: str) -> DataFrame:
    rows = results(spark, sf)
    tasks = rows.select("task").distinct().unionByName(tables.table(spark, sf, "region").select(F.col("r_name").alias("task")))
    return rounded(a.rates_of_all_tasks(rows, tasks))


_RATES = _RESULTS + ", rates AS (SELECT experiment, task, avg(success::INT) AS rate FROM results GROUP BY ALL)"


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).groupBy("experiment", "task").agg(F.avg(F.col("success").cast("double")).alias("rate"))


@query(f"WITH {_RATES}, m AS (SELECT experiment, avg(rate) AS mean_rate FROM rates GROUP BY experiment HAVING count(*) = 5) SELECT experiment, round(mean_rate, 6) AS mean_rate, row_number() OVER (ORDER BY mean_rate DESC, experiment) AS place FROM m")
def experiment_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(a.experiment_means(_rates(spark, sf), 5))


@query(f"WITH {_RATES} SELECT r.experiment, round(avg(least(greatest(r.rate / b.rate, 0), 1.05)), 6) AS score FROM rates r JOIN rates b ON b.experiment = 0 AND b.task = r.task GROUP BY r.experiment")
def equal_task_score(spark: SparkSession, sf: str) -> DataFrame:
    rates = _rates(spark, sf)
    return rounded(a.equal_task_score(rates, rates.filter("experiment = 0"), 1.05))


#: Every supplier's lines as a run; every fifth run lacks its expected step, every seventh may lack its warm-up boundary.
_METRICS = """metrics AS (SELECT l_suppkey AS run, l_orderkey AS step, l_linenumber * 10000000 + l_extendedprice AS "row", l_extendedprice::DOUBLE AS step_seconds, l_discount::DOUBLE AS wait FROM lineitem),
    settings AS (SELECT run, (min(step) + CASE WHEN run % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS warmup, (max(step) + CASE WHEN run % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS expected FROM metrics GROUP BY run)"""


@query(f"""WITH {_METRICS}, last AS (SELECT run, step, arg_max(step_seconds, "row") AS a, arg_max(wait, "row") AS b FROM metrics GROUP BY run, step),
    known AS (SELECT s.*, CASE WHEN NOT EXISTS (SELECT 1 FROM last l WHERE l.run = s.run AND l.step = expected) THEN 'incomplete' WHEN warmup > 0 AND NOT EXISTS (SELECT 1 FROM last l WHERE l.run = s.run AND l.step = warmup) THEN 'no_warmup_boundary' ELSE '' END AS problem FROM settings s),
    spans AS (SELECT l.*, l.step - coalesce(lag(l.step) OVER (PARTITION BY l.run ORDER BY l.step), warmup) AS span FROM last l JOIN settings s ON s.run = l.run AND l.step > warmup AND l.step <= expected),
    means AS (SELECT run, sum(a * span) / sum(span) AS a, sum(b * span) / sum(span) AS b, sum(span)::BIGINT AS n FROM spans GROUP BY run)
    SELECT k.run, CASE WHEN problem = '' THEN round(a, 4) END AS step_seconds, CASE WHEN problem = '' THEN round(b, 4) END AS wait, CASE WHEN problem = '' THEN round(1024 / a, 4) END AS samples_per_second, CASE WHEN problem = '' THEN n END AS measured_steps, problem
    FROM known k LEFT JOIN means m ON m.run = k.run""")
def span_weighted_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("step"), (F.col("l_linenumber") * 10_000_000 + F.col("l_extendedprice")).alias("row"), F.col("l_extendedprice").cast("double").alias("step_seconds"), F.col("l_discount").cast("double").alias("wait"))
    settings = rows.groupBy("run").agg((F.min("step") + F.when(F.col("run") % 7 == 0, 1).otherwise(0)).alias("warmup"), (F.max("step") + F.when(F.col("run") % 5 == 0, 1).otherwise(0)).alias("expected"))
    return rounded(a.span_weighted(rows, settings, ("step_seconds", "wait"), "step_seconds", 1024), 4)


@query(_SCORES + ", t AS (SELECT substr(sample_id, 8, 1) AS kind, * FROM scores), c AS (SELECT kind, avg(quality) AS quality, avg(coverage) AS coverage, avg(novelty) AS novelty FROM t GROUP BY kind) SELECT kind, component, round(mean, 6) AS mean FROM (UNPIVOT c ON quality, coverage, novelty INTO NAME component VALUE mean)")
def component_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf).withColumn("kind", F.substring("sample_id", 8, 1))
    return rounded(a.component_means(rows, "kind", ("quality", "coverage", "novelty")))


@query("""WITH t AS (SELECT unnest(['stack', 'carrot', 'spoon']) AS task, unnest([0, 1, 2]) AS i), s AS (SELECT unnest([4, 0, 2]) AS seed, unnest([0, 1, 2]) AS j)
    SELECT i * 72 + j * 24 + o AS plan_index, task, seed, o::INT AS object_id, (i * 72 + j * 24 + o) % 4 AS shard FROM t, s, (SELECT unnest(range(0, 24)) AS o)""")
def episode_plan_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks and seeds in the order of the settings, not sorted."""
    return a.episode_plan(spark, ["stack", "carrot", "spoon"], [4, 0, 2], list(range(24)), 4)


@query("""WITH e AS (SELECT DISTINCT o_custkey AS k FROM orders), g AS (SELECT user_id AS k, count(*) AS c FROM events GROUP BY 1)
    SELECT k, 'missing' AS problem FROM e WHERE k NOT IN (SELECT k FROM g) UNION ALL SELECT k, 'unexpected' FROM g WHERE k NOT IN (SELECT k FROM e) UNION ALL SELECT k, 'repeated' FROM g WHERE c > 1""")
def except_coverage(spark: SparkSession, sf: str) -> DataFrame:
    expected = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return a.shard_gaps(expected, tables.table(spark, sf, "events").select(F.col("user_id").alias("k")), ["k"])


@query("""SELECT o_orderkey, (CASE WHEN h >= 9223372036854775808 THEN h - 9223372036854775808 ELSE h END)::BIGINT AS inference_seed FROM
    (SELECT o_orderkey, ('0x' || substr(sha256('octo-simpler-episode-v1' || chr(0) || o_orderpriority || chr(0) || (o_orderkey % 3) || chr(0) || o_custkey), 1, 16))::UBIGINT AS h FROM orders)""")
def inference_seeds(spark: SparkSession, sf: str) -> DataFrame:
    orders = tables.table(spark, sf, "orders")
    return orders.select("o_orderkey", a.inference_seed(F.col("o_orderpriority"), F.col("o_orderkey") % 3, F.col("o_custkey")).alias("inference_seed"))
