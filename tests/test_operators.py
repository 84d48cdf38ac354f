"""Operators against small tables with known results."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clipsieve.operators import aggregates, graph, motion, normalize, selection, similarity, windows


def lengths(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "episode_id long, length long")


def starts(df):
    out = {}
    for r in df.orderBy("episode_id", "start_step").collect():
        out.setdefault(r["episode_id"], []).append(r["start_step"])
    return out


@pytest.mark.parametrize(("chunk", "stride", "length", "expected"), [(8, 4, 5, [0]), (15, 15, 40, [0, 15, 25]), (32, 16, 100, [0, 16, 32, 48, 64, 68]), (8, 4, 0, None)])
def test_aligned_windows(spark, chunk, stride, length, expected):
    assert starts(windows.aligned_windows(lengths(spark, length), chunk, stride)).get(0) == expected


def test_candidate_windows(spark):
    assert starts(windows.candidate_windows(lengths(spark, 14, 58))) == {1: [0, 15, 30, 43]}


def test_reference_windows(spark):
    got = starts(windows.reference_windows(lengths(spark, 14, 15, 29, 30, 90, 91, 180, 181)))
    assert [len(got.get(k, [])) for k in range(8)] == [0, 1, 1, 2, 6, 6, 9, 9]
    assert got[5] == [0, 15, 30, 46, 61, 76]


def test_uniform_windows(spark):
    got = starts(windows.uniform_windows(lengths(spark, 15, 16, 31, 46, 14), 15))
    assert got == {0: [0], 1: [0, 1], 2: [0, 8, 16], 3: [0, 10, 20, 31]}


def test_trajectory_starts(spark):
    eight = {8: [0], 9: [0, 1], 10: [0, 2], 11: [0, 3], 12: [0, 2, 4], 13: [0, 3, 5], 14: [0, 3, 6], 15: [0, 3, 5, 7]}
    got = starts(windows.trajectory_starts(lengths(spark, *eight), 8, 3))
    assert list(got.values()) == list(eight.values())
    four = {7: [0, 2, 3], 9: [0, 2, 4, 5], 11: [0, 2, 4, 6, 7]}
    assert list(starts(windows.trajectory_starts(lengths(spark, *four), 4, 2)).values()) == list(four.values())


def test_links(spark):
    clips = windows.with_ids(windows.candidate_windows(lengths(spark, 40)).select("episode_id", "start_step", "end_step"))
    near = {r["start_step"]: (r["previous_sample_id"], r["next_sample_id"]) for r in windows.contiguous_links(clips).collect()}
    assert near[0][1] == "ep000000_fragment_000015_000029" and near[15][1] is None
    assert {r["start_step"]: r["next_sample_id"] for r in windows.chronological_links(clips).collect()}[15] == "ep000000_fragment_000025_000039"


def test_fragments_overlap_once(spark):
    fragments = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (0, 1, 1)], "episode_id long, start_step long, end_step long")
    got = windows.expand_fragments(fragments, lengths(spark, 5, 4))
    assert sorted(r[0] for r in got.collect()) == [1, 5, 6, 7, 8]


def vectors(spark, *points):
    return spark.createDataFrame([(i, [float(x) for x in (p if isinstance(p, (list, tuple)) else [p])]) for i, p in enumerate(points)], "id long, vec array<double>")


@pytest.mark.parametrize(("points", "k", "expected"), [
    ([0, 1, 2, 4, 20], 2, [1, 1, 1, 2 / 3, 1 / 3]), ([0, 1, 3, 10], 1, [1, 1, 0.5, 0.5]), ([0, 0, 0, 0, 10], 2, [1, 1, 1, 1, 1 / 3]), ([0, 10], 10, [1, 1]), ([0], 10, [1])])
def test_radius_support(spark, points, k, expected):
    got = similarity.support(vectors(spark, *points), k, "radius").orderBy("id").collect()
    assert [r["support"] for r in got] == pytest.approx(expected)


def test_exponential_support(spark):
    d = np.array([2, 1, 2, 3, 18.0])
    got = similarity.support(vectors(spark, 0, 1, 2, 4, 20), 2).orderBy("id").collect()
    assert [r["support"] for r in got] == pytest.approx(list(np.exp(-d / (np.median(d) + 1e-8))))


def test_subset_diversity_is_pairwise_mean(spark):
    x = np.random.default_rng(1).normal(size=(7, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(u[i] @ u[j] + 1) / 2 for i in range(7) for j in range(i)]
    assert similarity.subset_diversity(vectors(spark, *map(list, x))).first()[0] == pytest.approx(1 - np.mean(pairs))
    assert similarity.subset_diversity(vectors(spark, [1, 0])).first()[0] == 0


def track(spark, points, times=None):
    times = times or list(range(len(points)))
    return spark.createDataFrame([("c", k, [float(x) for x in p], float(t)) for k, (p, t) in enumerate(zip(points, times, strict=True))], "sample_id string, frame_index long, position array<double>, timestamp double")


def test_jerk(spark):
    points = [(t**3, 2 * t**3, 2 * t**3) for t in range(8)]
    assert motion.jerk(track(spark, points)).first()["jerk"] == pytest.approx(18)
    assert motion.jerk(track(spark, points, [3 * t for t in range(8)])).first()["jerk"] == pytest.approx(18 / 27)
    for times, reason in (([0, 1, 2], "too_short"), ([0, 1, 1, 2], "non_increasing_time"), ([0, 1, 2, 4], "non_uniform_time")):
        row = motion.jerk(track(spark, [(0, 0, 0)] * len(times), times)).first()
        assert (row["jerk"], row["reason"]) == (None, reason)


def test_path_efficiency(spark):
    of = lambda xs: motion.path_efficiency(track(spark, [(x, 0) for x in xs])).first()[1]
    assert of([0, 1, 2]) == pytest.approx(1)
    assert of([0, 0.125, 0.1, 0.2]) == pytest.approx(0.8)
    assert of([0, 1, 0]) == pytest.approx(0)
    assert of([1, 1, 1]) is None


def test_primitives(spark):
    cases = [({}, "stop"), ({1: 0.04}, "move left"), ({0: 0.04, 1: -0.04, 2: -0.04}, "move forward right down"), ({2: 0.04, 7: 0.04}, "move up, open gripper"),
             ({1: 0.04, 5: 0.04}, "move left, rotate counterclockwise"), ({7: -0.04}, "close gripper"), ({4: 0.04}, "tilt up"), ({0: 0.03, 1: -0.03}, "stop")]
    rows = [([d.get(k, 0.0) for k in range(8)], want) for d, want in cases]
    got = spark.createDataFrame(rows, "delta array<double>, want string").select("want", motion.motion_label(F.col("delta"), {}).alias("got"))
    assert all(r["got"] == r["want"] for r in got.collect())
    back = got.select("got", motion.compose(motion.atoms(F.col("got"))).alias("again"))
    assert all(r["got"] == r["again"] for r in back.collect())


def test_fusion_without_some_metrics(spark):
    rows = spark.createDataFrame([(0.81, None), (0.64, 0.25), (None, None)], "jump double, path double")
    got = [r["reliability"] for r in motion.fuse_reliability(rows, ["jump", "path"], 0.0).collect()]
    assert got == pytest.approx([0.81, 0.4, 1.0])


def test_unit_interval_of_constant_column(spark):
    rows = spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double")
    assert [r["y"] for r in normalize.unit_interval(rows, "x", "y").collect()] == [0.0, 0.0, None]


def test_zero_vector_stays_zero(spark):
    assert vectors(spark, [0, 0]).select(normalize.l2_normalise(F.col("vec"))).first()[0] == [0, 0]


def test_quotas():
    assert selection.allocate_quotas({0: 6, 1: 3, 2: 1}, 5, 1) == {0: 2, 1: 2, 2: 1}
    with pytest.raises(ValueError):
        selection.allocate_quotas({0: 1}, 2, 0)


def test_budgets():
    assert selection.percent_budget(46705, "10") == 4671 == selection.percent_budget(46705, 10, decimal=False)
    assert selection.ratio_budget(5, 0.5) == 3
    with pytest.raises(ValueError):
        selection.ratio_budget(5, 0.0)


def test_top_k_breaks_ties(spark):
    rows = spark.createDataFrame([("a", 0.7, 2), ("b", 0.6, 1), ("c", 0.8, 1), ("d", 0.7, 1)], "sample_id string, tdus double, length long")
    assert [r[0] for r in selection.top_k(rows, "tdus", 3).collect()] == ["c", "d", "a"]
    assert selection.top_k(rows, "tdus", 0).count() == 0


def test_greedy_budget_against_full_recomputation():
    rng = np.random.default_rng(3)
    n, budget, weights, sigma = 14, 30, (0.3, 0.3, 0.2, 0.2), 1.0
    x = rng.normal(size=(n, 3))
    clips = pd.DataFrame({"sample_id": [f"s{i:02d}" for i in range(n)], "length": rng.integers(2, 9, n), "quality": rng.random(n), "novelty": rng.random(n), "score": rng.random(n)})
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * sigma**2))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def utility(s):
        mmd = max(kernel.mean() + kernel[np.ix_(s, s)].mean() - 2 * kernel[:, s].mean(), 0)
        pairs = [(unit[i] @ unit[j] + 1) / 2 for k, i in enumerate(s) for j in s[:k]]
        part = clips.iloc[s]
        return weights[0] * (part.length * part.quality).sum() / budget + weights[1] * math.exp(-mmd) + weights[2] * (1 - np.mean(pairs) if pairs else 0) + weights[3] * (part.length * part.novelty).sum() / budget

    chosen, now, left = [], 0.0, budget
    while True:
        options = [(-(utility([*chosen, k]) - now) / clips.length[k], -clips.score[k], clips.length[k], clips.sample_id[k], k) for k in range(n) if k not in chosen and clips.length[k] <= left]
        if not options or min(options)[0] >= 0:
            break
        k = min(options)[-1]
        chosen.append(k)
        now, left = utility(chosen), left - clips.length[k]
    assert selection.greedy_budget(clips, x, budget, weights, sigma) == [f"s{k:02d}" for k in chosen]


def test_coverage_seed_ties(spark):
    given = spark.createDataFrame([(1, "p", 0.5), (2, "p", 0.5), (3, "q", 0.1), (2, "q", 0.05)], "node long, prototype string, weight double")
    nodes = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "node long, reliability double")
    assert sorted(r[0] for r in graph.coverage_seed(given, nodes).collect()) == [1, 3]


def test_span_weighted_last_row_wins(spark):
    rows = spark.createDataFrame([(1, 0, 0, 9.0), (1, 10, 0, 5.0), (1, 10, 1, 1.0), (1, 40, 0, 3.0)], "run long, step long, row long, s double")
    settings = spark.createDataFrame([(1, 0, 40)], "run long, warmup long, expected long")
    assert aggregates.span_weighted(rows, settings, ("s",), "s", 1).first()["s"] == pytest.approx((10 * 1 + 30 * 3) / 40)


def test_response_surface_recovers_a_plane():
    rng = np.random.default_rng(0)
    x = rng.dirichlet([1, 1, 1, 1], 20)[:, :3]
    y = 1 + x @ [2.0, -1.0, 0.5]
    best = selection.fit_response(x, y)
    assert not best["quadratic"] and best["loo_rmse"] < 1e-4
