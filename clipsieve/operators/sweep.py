"""Weight sweeps: fitted scores of candidate weights, their ranks, a score table for each row of weights, states of runs, and reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import clip01
from .ordering import numbered
from .selection import bounded_simplex, features, percent_budget, ridge

#: How far weights may lie outside the support's box.
SLACK = 1e-12


def response(weights: str, fitted: Sequence[float], quadratic: bool) -> Column:
    """A response surface (see ``selection.fit_response``) as an expression over an array column of weights."""
    at = lambda k: F.get(F.col(weights), F.lit(k))
    coefficients = [float(w) for w in fitted]
    n = len(coefficients) - 1
    if quadratic:
        n = next(k for k in range(1, n + 1) if k + k * (k + 1) // 2 == n)
    terms = [at(k) for k in range(n)] + ([at(i) * at(j) for i in range(n) for j in range(i, n)] if quadratic else [])
    return sum((F.lit(w) * term for w, term in zip(coefficients[1:], terms, strict=True)), F.lit(coefficients[0]))


def in_support(weights: str, low: Sequence[float], high: Sequence[float]) -> Column:
    """Whether every weight lies within its bounds."""
    inside = [F.get(F.col(weights), F.lit(k)).between(float(a) - SLACK, float(b) + SLACK) for k, (a, b) in enumerate(zip(low, high, strict=True))]
    return F.coalesce(F.reduce(F.array(*inside), F.lit(True), lambda a, x: a & x), F.lit(False))


def ranked_candidates(candidates: DataFrame, predicted: Column, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """``candidates`` (``line, weights, observed``, unique lines) with ``predicted, residual, supported, rank``: the largest prediction first, ties to the smaller line."""
    rows = candidates.withColumn("predicted", predicted)
    rows = rows.withColumns({"residual": F.col("observed") - F.col("predicted"), "supported": in_support("weights", low, high)})
    return numbered(rows, -F.col("predicted"), F.col("line"), name="rank")


def best_candidate(ranked: DataFrame, observed: bool = False, supported: bool = False, unfinished: bool = False) -> DataFrame:
    """The best row, if any, by prediction or by ``observed`` result; only ``supported`` ones or those of ``unfinished`` runs, if asked."""
    rows = ranked.filter("observed IS NOT NULL") if observed else ranked
    rows = rows.filter("supported") if supported else rows
    rows = rows.filter("status != 'complete'") if unfinished else rows
    return rows.orderBy(F.desc("observed" if observed else "predicted"), "line").limit(1)


def stability(weights: np.ndarray, results: np.ndarray, candidates: np.ndarray, alpha: float, quadratic: bool, low: Sequence[float], high: Sequence[float]) -> tuple[dict[int, int], np.ndarray]:
    """How often each candidate within the bounds is the best when one run is left out, and the best weights of each fit.

    Runs are few (a row each); ties go to the earlier candidate.
    """
    inside = np.flatnonzero(((candidates >= np.asarray(low) - SLACK) & (candidates <= np.asarray(high) + SLACK)).all(1))
    if not len(inside):
        raise ValueError("no candidate lies within the bounds")
    n, columns, often, best = weights.shape[1], features(candidates[inside], quadratic), dict[int, int](), []
    for out in range(len(results)):
        fitted = ridge(features(np.delete(weights, out, 0), quadratic), np.delete(results, out), alpha)
        winner = int(inside[int(np.argmax(fitted[0] + columns @ fitted[1:]))])
        often[winner] = often.get(winner, 0) + 1
        curve = np.zeros((n, n))
        if quadratic:
            for w, (i, j) in zip(fitted[1 + n :], ((i, j) for i in range(n) for j in range(i, n)), strict=True):
                curve[i, j] += w
                curve[j, i] += w
        best.append(bounded_simplex(fitted[1 : 1 + n], curve, low, high))
    return dict(sorted(often.items())), np.array(best)


def sweep_scores(scores: DataFrame, components: Sequence[str], sweep: Sequence[Sequence[float]], percent: str | float) -> DataFrame:
    """``model_id, sample_id, score, place``: for each row of weights the best ``percent`` of all scores, weighted and cut to [0, 1].

    Rows of weights are literals, so each score meets them in one array that is
    exploded in place; the ranks of a model are made in parts (``ordering.numbered``).
    """
    if any(len(w) != len(components) for w in sweep):
        raise ValueError("every row of weights must have a weight for each component")
    total = lambda w: clip01(sum((F.lit(float(x)) * F.col(c) for x, c in zip(w, components, strict=True)), F.lit(0.0)))
    models = F.explode(F.array(*[F.struct(F.lit(f"model-{k:03d}").alias("model_id"), F.round(total(w), 9).alias("score")) for k, w in enumerate(sweep, 1)]))
    rows = scores.select("sample_id", models.alias("m")).select("m.model_id", "sample_id", "m.score")
    return numbered(rows, -F.col("score"), F.col("sample_id"), by=["model_id"]).filter(F.col("place") <= percent_budget(scores.count(), percent))


def run_action(entries: Column, step: Column, target: int) -> Column:
    """``new`` for a run without output, ``skip`` for one whose checkpoint is at the target, else ``resume``."""
    return F.when(F.coalesce(entries, F.lit(0)) == 0, "new").when(F.coalesce(step, F.lit(0)) >= target, "skip").otherwise("resume")


def success_report(results: DataFrame, settings: Sequence) -> DataFrame:
    """``seed, place, episodes, successes, rate``: all results (null seed, place 0), and those of each seed in the order of ``settings``.

    Seeds without results have a row with a null rate; results of other seeds are an error.
    """
    order = F.array(*[F.lit(s) for s in settings])
    sums = results.groupingSets([["seed"], []], "seed").agg(F.grouping("seed").alias("whole"), F.count(F.lit(1)).alias("episodes"), F.coalesce(F.sum(F.col("success").cast("long")), F.lit(0)).alias("successes"))
    sums = sums.withColumn("place", F.when(F.col("whole") == 1, 0).otherwise(F.array_position(order, F.col("seed"))))
    sums = sums.withColumn("place", F.when((F.col("whole") == 0) & (F.coalesce("place", F.lit(0)) == 0), F.raise_error(F.lit("a result has a seed outside the settings")).cast("long")).otherwise(F.col("place")))
    named = results.sparkSession.range(1).select(F.posexplode(F.concat(F.array(F.lit(None).cast(results.schema["seed"].dataType)), order)).alias("place", "seed"))
    joined = named.join(F.broadcast(sums.drop("seed")), "place", "left")  # a row for each setting
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("seed", F.col("place").cast("int").alias("place"), count("episodes"), count("successes"), (F.col("successes") / F.nullif("episodes", F.lit(0))).alias("rate"))
