"""Summaries: moments, success rates, weighted metrics, plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import quantiles


def moments(frames: DataFrame, column: str) -> DataFrame:
    """``dim, n, mean, std, min, max`` of each dimension (population deviation); partial sums merge on the way."""
    wide = frames.select(F.posexplode(column).alias("dim", "x"))
    return wide.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def axis_statistics(deltas: DataFrame, column: str, threshold: float) -> DataFrame:
    """Per axis the shares of changes beyond the threshold (either way, up, down) and quantiles of their size."""
    wide = deltas.select(F.posexplode(column).alias("dim", "x"))
    share = lambda c: F.avg(c.cast("double"))
    shares = wide.groupBy("dim").agg(share(F.abs("x") > threshold).alias("beyond"), share(F.col("x") > threshold).alias("above"), share(F.col("x") < -threshold).alias("below"))
    q = quantiles(wide.withColumn("x", F.abs("x")), "x", (0.5, 0.9, 0.99), ["dim"]).withColumnsRenamed({"q0": "q50", "q1": "q90", "q2": "q99"})
    return shares.join(q, "dim")


def success_rates(results: DataFrame, sets: tuple[str, ...] = ("task", "seed")) -> DataFrame:
    """``task, seed, episodes, successes, failures, rate`` overall, by task and by seed (grouping sets)."""
    grouped = results.groupingSets([[], *[[F.col(s)] for s in sets]], *[F.col(s) for s in sets])
    ok = F.sum(F.col("success").cast("long"))
    return grouped.agg(F.count(F.lit(1)).alias("episodes"), ok.alias("successes"), (F.count(F.lit(1)) - ok).alias("failures"), (ok / F.count(F.lit(1))).alias("rate"))


def rates_of_all_tasks(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """``task, episodes, rate`` of every listed task; without episodes the rate is null."""
    got = results.groupBy("task").agg(F.count(F.lit(1)).alias("episodes"), F.avg(F.col("success").cast("double")).alias("rate"))
    return tasks.join(got, "task", "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))


def experiment_means(rates: DataFrame, tasks: int) -> DataFrame:
    """``experiment, mean_rate, place``: unweighted mean over exactly ``tasks`` valid tasks; others are left out."""
    got = rates.groupBy("experiment").agg(F.avg("rate").alias("mean_rate"), F.count("rate").alias("n"), F.count(F.lit(1)).alias("m")).filter((F.col("n") == tasks) & (F.col("m") == tasks))
    return got.select("experiment", "mean_rate", F.row_number().over(W.orderBy(F.desc("mean_rate"), "experiment")).cast("long").alias("place"))


def equal_task_score(rates: DataFrame, base: DataFrame, most: float) -> DataFrame:
    """``experiment, score``: mean over tasks of rate over the base's rate, clipped to [0, most]."""
    joined = rates.join(base.select("task", F.col("rate").alias("base")), "task")
    return joined.groupBy("experiment").agg(F.avg(F.least(F.greatest(F.col("rate") / F.col("base"), F.lit(0.0)), F.lit(most))).alias("score"))


def span_weighted(metrics: DataFrame, settings: DataFrame, columns: tuple[str, ...], time: str, batch: int) -> DataFrame:
    """``run``, a mean of each column weighted by the steps since the row before, ``samples_per_second``, ``measured_steps`` and ``problem``.

    ``metrics``: ``run, step, row`` and the columns; ``settings``: ``run, warmup,
    expected``. The last row of a step wins; rows without ``time`` don't count.
    The first measured span begins at the warm-up. A run without its expected
    step (``incomplete``) or without a row at its warm-up boundary
    (``no_warmup_boundary``) has no means.
    """
    last = metrics.filter(F.col(time).isNotNull()).groupBy("run", "step").agg(F.max_by(F.struct(*columns), "row").alias("m")).select("run", "step", "m.*")
    rows = settings.join(last, "run", "left")
    bounds = rows.groupBy("run").agg(F.max((F.col("step") == F.col("expected")).cast("int")).alias("done"), F.max((F.col("step") == F.col("warmup")).cast("int")).alias("warm"))
    measured = rows.filter("step > warmup AND step <= expected")
    span = F.col("step") - F.coalesce(F.lag("step").over(W.partitionBy("run").orderBy("step")), F.col("warmup"))
    means = measured.withColumn("span", span).groupBy("run").agg(*[(F.sum(F.col(c) * F.col("span")) / F.sum("span")).alias(c) for c in columns], F.sum("span").alias("measured_steps"))
    problem = F.when(F.coalesce("done", F.lit(0)) == 0, "incomplete").when((F.col("warmup") > 0) & (F.coalesce("warm", F.lit(0)) == 0), "no_warmup_boundary").otherwise("")
    joined = settings.join(bounds, "run").join(means, "run", "left").withColumn("problem", problem)
    fine = lambda c: F.when(F.col("problem") == "", c)
    return joined.select("run", *[fine(F.col(c)).alias(c) for c in columns], fine(batch / F.col(time)).alias("samples_per_second"), fine(F.col("measured_steps")).alias("measured_steps"), "problem")


def phase_mix(slow: Column, fast: Column) -> Column:
    """Nine parts of one phase and one of the other."""
    return 0.9 * slow + 0.1 * fast


def is_faster(candidate: Column, base: Column, least: float = 0.05) -> Column:
    return candidate <= (1 - least) * base


def component_means(scores: DataFrame, by: str, columns: tuple[str, ...]) -> DataFrame:
    """``by, component, mean``: long form of the columns' means."""
    means = scores.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])
    return means.unpivot([by], list(columns), "component", "mean")


def metric_summary(rows: DataFrame, metric: str, reason: str) -> DataFrame:
    """``reason, n, mean``: counts of a metric's reasons to be undefined, and its mean where it is not (reason empty)."""
    return rows.groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"))


def episode_plan(spark: SparkSession, tasks: Sequence[str], seeds: Sequence[int], objects: Sequence[int], shards: int) -> DataFrame:
    """``plan_index, task, seed, object_id, shard``: every task with every seed and object, numbered in the order of the settings and dealt to shards in turn."""
    of = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    k, n = F.col("id"), len(objects)
    return spark.range(len(tasks) * len(seeds) * n).select(
        k.alias("plan_index"), of(tasks, F.floor(k / (len(seeds) * n))).alias("task"), of(seeds, F.floor(k / n) % len(seeds)).alias("seed"), of(objects, k % n).alias("object_id"), (k % shards).alias("shard"))


def shard_gaps(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, problem``: rows that are missing, unexpected or repeated in what the shards returned."""
    counted = actual.groupBy(*keys).count()
    return (expected.join(counted, keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
            .unionByName(counted.join(expected, keys, "left_anti").select(*keys, F.lit("unexpected").alias("problem")))
            .unionByName(counted.filter("count > 1").select(*keys, F.lit("repeated").alias("problem"))))


#: Fixed value: what the seed's payload begins with.
SEED_PREFIX = "octo-simpler-episode-v1"


def inference_seed(task: Column, seed: Column, object_id: Column) -> Column:
    """The first eight bytes of a SHA-256 of a fixed prefix and the three, NUL between, less the sign bit."""
    digest = F.sha2(F.concat_ws("\0", F.lit(SEED_PREFIX), task, seed.cast("string"), object_id.cast("string")), 256)
    head = F.lpad(F.conv(F.conv(F.substring(digest, 1, 1), 16, 10).cast("int").bitwiseAND(7).cast("string"), 10, 16), 1, "0")
    return F.conv(F.concat(head, F.substring(digest, 2, 15)), 16, 10).cast("long")


def dataset_summary(episodes: DataFrame, task: str = "task_name") -> DataFrame:
    """One row, ``source, indexed, excluded``: episodes, those with a task that is not blank, and the rest."""
    good = F.coalesce(F.trim(task) != "", F.lit(False))
    return episodes.agg(F.count(F.lit(1)).alias("source"), F.sum(good.cast("long")).alias("indexed"), F.sum((~good).cast("long")).alias("excluded"))


def run_status(candidates: DataFrame, results: DataFrame, tasks: int) -> DataFrame:
    """``candidate, finished, status``: complete, partial or not_started, by the distinct tasks with a result."""
    found = results.filter("rate IS NOT NULL").groupBy("candidate").agg(F.countDistinct("task").alias("finished"))
    rows = candidates.join(found, "candidate", "left").withColumn("finished", F.coalesce("finished", F.lit(0)).cast("long"))
    return rows.withColumn("status", F.when(F.col("finished") >= tasks, "complete").when(F.col("finished") > 0, "partial").otherwise("not_started"))


def protocol_mismatches(runs: DataFrame, baseline: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``run, task, field``: settings in which a run differs from the baseline's of the same task; nulls are equal to each other."""
    pairs = runs.join(baseline.select("task", *[F.col(f).alias(f"base_{f}") for f in fields]), "task")
    differ = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"base_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return pairs.select("run", "task", F.explode(differ).alias("field"))


def manifest_mismatches(manifest: DataFrame, weights: DataFrame, columns: Sequence[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """``position, problem``: places at which manifest and weights do not hold the same numbers, or only one has a row."""
    both = manifest.select("position", F.struct(*columns).alias("a")).join(weights.select("position", F.struct(*columns).alias("b")), "position", "full")
    far = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > atol + rtol * F.abs(F.col(f"b.{c}")) for c in columns]
    some = far[0]
    for f in far[1:]:
        some = some | f
    problem = F.when(F.col("a").isNull(), "not in the manifest").when(F.col("b").isNull(), "no weights").when(some, "differs")
    return both.select("position", problem.alias("problem")).filter("problem IS NOT NULL")


def overlap(selections: DataFrame) -> DataFrame:
    """``a, b, common``: the number of samples that two selections share, for each pair that shares any.

    A sample is in few selections; their pairs are made from its list of them.
    """
    lists = selections.select("selection", "sample_id").distinct().groupBy("sample_id").agg(F.array_sort(F.collect_list("selection")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("common"))
