"""Branches, fitted centres, range search, sweeps and epochs against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.operators import batches, branches, prototypes, selection, similarity, sweep


def small(seed=4, n=12, m=4, quotas=None):
    rng = np.random.default_rng(seed)
    mass = rng.uniform(size=(n, m)) * (rng.uniform(size=(n, m)) < 0.6)
    transition, together = (rng.dirichlet(np.ones(m * m)).reshape(m, m) for _ in range(2))
    edges = np.array([(k, k + 1) for k in range(n - 1) if k % 4 != 3])
    return branches.Graph(mass, rng.uniform(0.1, 1, n), rng.dirichlet(np.ones(m)), transition, together, edges, [(0, 1, 0.5), (2, 7, 0.9), (3, 5, 0.2)],
                          rng.normal(size=(n, 3)), [k // 4 for k in range(n)], [k % 3 for k in range(n)] if quotas else None, quotas)


def value(g, rows):
    """The objective from scratch."""
    rows, m = list(rows), g.mass.shape[1]
    cover = g.mass[rows].max(0) if rows else np.zeros(m)
    counts = sum((np.outer(g.mass[a], g.mass[b]) for a, b in g.edges if a in rows and b in rows), np.zeros((m, m)))
    whole = sum(np.outer(g.mass[a], g.mass[b]) for a, b in g.edges)
    pair = np.sqrt(np.outer(cover, cover))
    r = sum(p for a, b, p in g.alike if a in rows and b in rows) / sum(p for *_, p in g.alike)
    return 4 * g.rarity @ cover + ((1.2 * g.transition + 0.5 * g.together) * pair).sum() + 2 * (g.transition * np.log1p(counts) / (np.log1p(whole) + 1e-8)).sum() - 2 * r


@pytest.mark.parametrize("quotas", [None, {0: 2, 1: 1, 2: 2}])
def test_pooled_greedy_with_a_pool_of_all_is_greedy(quotas):
    g = small(quotas=quotas)
    got = branches.pooled_greedy(g, 5)
    rows = []
    for k in got.rows:
        open_ = [x for x in range(12) if x not in rows and (quotas is None or sum(g.tasks[y] == g.tasks[x] for y in rows) < quotas[g.tasks[x]])]
        assert value(g, [*rows, k]) == pytest.approx(max(value(g, [*rows, x]) for x in open_))
        rows.append(k)
    assert got.value == pytest.approx(value(g, rows)) and got.redundancy >= 0
    assert got.rows == selection.full_greedy(g.mass, g.rarity, g.transition, g.together, g.edges, g.alike, 5, g.tasks, quotas)[0]
    tight = branches.pooled_greedy(g, 5, seed=1, best=2, residual=1, drawn=1)
    assert len(set(tight.rows)) == 5 and tight.value == pytest.approx(value(g, tight.rows))


def test_greedy_errors():
    with pytest.raises(ValueError):
        branches.pooled_greedy(small(), 13)
    with pytest.raises(ValueError):
        branches.pooled_greedy(small(quotas={0: 2, 1: 1, 2: 2}), 4)
    with pytest.raises(ValueError):
        branches.pooled_greedy(small(quotas={0: 2, 1: 1, 2: 2}), 5, start=(1, 4))


def test_seed_pairs():
    g = small(n=16)
    pairs = branches.seed_pairs(g, branches=5, most_alike=0.8)
    assert 1 <= len(pairs) <= 5
    both = [np.concatenate([g.vectors[a], g.vectors[b]]) for a, b in pairs]
    assert all(x @ y / np.linalg.norm(x) / np.linalg.norm(y) < 0.8 for x, y in itertools.combinations(both, 2))
    edges = {tuple(e) for e in g.edges.tolist()}
    assert all(p in edges or g.episodes[p[0]] != g.episodes[p[1]] for p in pairs)
    # without a limit on similarity or number, every pair comes, the best first
    every = branches.seed_pairs(g, branches=10_000, kept=10_000, most_alike=2.0)
    values = [value(g, p) for p in every]
    assert edges <= set(every) | {p[::-1] for p in every} and values == sorted(values, reverse=True)
    assert branches.seed_pairs(small(quotas={0: 0, 1: 0, 2: 0})) == []


def test_swaps_improve_and_stop_at_a_local_best():
    g = small()
    start = branches.Chosen(g, [0, 1, 2])
    found, swaps = branches.swapped(start, rounds=50)
    assert swaps and found.value > start.value and found.value == pytest.approx(value(g, found.rows))
    options = [[*found.rows[:i], k, *found.rows[i + 1 :]] for i in range(3) for k in range(12) if k not in found.rows]
    assert found.value >= max(value(g, o) for o in options) - 1e-9
    first, once = branches.swapped(start, rounds=1)
    assert len(once) == 1 and first.value == pytest.approx(max(value(g, [*[x for x in (0, 1, 2) if x != a], k]) for a in (0, 1, 2) for k in range(3, 12)))


def test_best_branch(spark):
    g = small(n=16)
    found = branches.best_branch(spark, g, 4, branches=4)
    assert found["objective"].is_monotonic_decreasing and set(found["branch"]) == set(range(len(found))) and len(found) > 1
    for row in found.itertuples():
        assert row.objective == pytest.approx(value(g, row.chosen)) and len(set(row.chosen)) == 4
    assert found["objective"][0] >= branches.pooled_greedy(g, 4).value - 1e-9
    with pytest.raises(ValueError):
        branches.best_branch(spark, g, 4, most_rows=3)


def test_fit_centres(spark):
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(6, 3)) * 20
    x = [(k % 2, middles[k % 6] + rng.normal(size=3)) for k in range(600)]
    rows = spark.createDataFrame([(a, [float(v) for v in vec]) for a, vec in x], "action long, vec array<double>").repartition(3)
    counts = spark.createDataFrame([(0, 3), (1, 3)], "action long, k long")
    got = prototypes.fit_centres(rows, counts, sample=60).collect()
    assert [(r["action"], r["leaf"]) for r in got] == [(a, c) for a in (0, 1) for c in range(3)]
    for action in (0, 1):
        points = np.array([v for a, v in x if a == action])
        centres = np.array([r["centre"] for r in got if r["action"] == action])
        own = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        assert np.allclose(centres, [points[own == c].mean(0) for c in range(3)])
        assert sorted(map(tuple, centres.round(0))) == sorted(tuple(points[[i for i in range(300) if (2 * i + action) % 6 == k]].mean(0).round(0)) for k in range(6) if k % 2 == action)
    # one more round is the plain one; few equal rows; no rows
    table = [(r["action"], r["leaf"], r["centre"]) for r in got]
    assert np.allclose([r[2] for r in prototypes._refined(rows, table)], [r["centre"] for r in got])
    same = spark.createDataFrame([(5, [1.0, 2.0])] * 4, "action long, vec array<double>")
    assert {tuple(r["centre"]) for r in prototypes.fit_centres(same).collect()} == {(1.0, 2.0)}
    assert prototypes.fit_centres(rows.limit(0)).count() == 0


def test_penalties(spark):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(40, 5)), rng.uniform(size=40)
    x[7] = x[3]
    x[9] = 0
    rows = spark.createDataFrame([(k, [float(v) for v in x[k]], float(q[k])) for k in range(40)], "id long, vec array<double>, reliability double")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    chosen = [k for k in range(40) if k % 3 == 0]
    want = {k: sum(q[k] * q[o] * (unit[k] @ unit[o] - 0.4) / 0.6 for o in chosen if o != k and unit[k] @ unit[o] >= 0.4) / 2 for k in range(40)}
    got = {r["id"]: r["penalty"] for r in similarity.penalties(rows, rows.filter("id % 3 = 0"), 0.4, 2.0).collect()}
    assert got == pytest.approx(want) and got[9] == 0
    pairs = {(r["id"], r["other"]) for r in similarity.within(rows, rows.filter("id % 3 = 0"), 0.4).collect()}
    assert pairs == {(k, o) for k in range(40) for o in chosen if o != k and unit[k] @ unit[o] >= 0.4} and (7, 3) in pairs
    assert {r["penalty"] for r in similarity.penalties(rows, rows.limit(0), 0.4).collect()} == {0.0}


def test_response_and_stability(spark):
    rng = np.random.default_rng(2)
    weights = rng.dirichlet(np.ones(3), 12)
    for quadratic in (False, True):
        columns = selection.features(weights, quadratic)
        fitted = selection.ridge(columns, rng.normal(size=12), 0.1)
        rows = spark.createDataFrame([(k, [float(v) for v in w]) for k, w in enumerate(weights)], "line long, weights array<double>")
        got = [r[0] for r in rows.orderBy("line").select(sweep.response("weights", fitted, quadratic)).collect()]
        assert got == pytest.approx(list(fitted[0] + columns @ fitted[1:]))
    results = weights @ [3.0, 1.0, 2.0]
    often, best = sweep.stability(weights, results, weights, 1e-6, False, [0, 0, 0], [1, 1, 1])
    assert sum(often.values()) == 12 and max(often, key=often.get) == int(np.argmax(results)) and np.allclose(best, [1, 0, 0])
    with pytest.raises(ValueError):
        sweep.stability(weights, results, weights, 1.0, False, [2, 2, 2], [3, 3, 3])


def test_report_states_and_supports(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, None)], "seed long, success boolean")
    got = [tuple(r) for r in sweep.success_report(rows, [2, 1, 5]).orderBy("place").collect()]
    assert got == [(None, 0, 3, 1, pytest.approx(1 / 3)), (2, 1, 1, 0, 0.0), (1, 2, 2, 1, 0.5), (5, 3, 0, 0, None)]
    with pytest.raises(Exception, match="outside the settings"):
        sweep.success_report(rows, [1]).collect()
    runs = spark.createDataFrame([(0, None), (3, 10), (3, 4), (3, None)], "n int, step int")
    assert [r[0] for r in runs.select(sweep.run_action(F.col("n"), F.col("step"), 10)).collect()] == ["new", "skip", "resume", "resume"]
    box = spark.createDataFrame([([0.1, 0.5],), ([0.1, 0.9],), ([0.1],)], "w array<double>")
    assert [r[0] for r in box.select(sweep.in_support("w", [0, 0], [1, 0.5])).collect()] == [True, False, False]


def test_epoch_frames(spark):
    lengths = {e: 3 + e * 7 % 11 for e in range(13)}
    rows = spark.createDataFrame(list(lengths.items()), "episode_id long, length long")
    got = batches.epoch_frames(rows, 3, 4, 1, 0).toPandas()
    whole = batches.epoch_batches(rows, 3, 4, 1, 0).toPandas()
    assert whole["frames"].sum() == sum(lengths.values()) and whole["episodes"].tolist().count(4) == 2
    assert len(got) == 3 * 4 * (whole["frames"].min() // 4) and not got.duplicated(["episode_id", "frame_index"]).any()
    assert all(sorted(s) == [0, 1, 2, 3] for _, s in got.groupby(["rank", "batch"])["slot"])
    assert (got["frame_index"] < got["episode_id"].map(lengths)).all() and got.groupby("episode_id")["rank"].nunique().max() == 1
    assert batches.epoch_frames(rows.limit(2), 3, 4, 1, 0).count() == 0
