"""Projections, prototypes, spectra, sequential selection and strict scans against plain versions and known numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.functions import scalar
from clipsieve.operators import aggregates, graph, motion, ordering, projection, prototypes, selection, similarity
from clipsieve.sources import scores


def frame(spark, x):
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def test_components(spark):
    x = np.random.default_rng(0).normal(size=(200, 6)) @ np.random.default_rng(1).normal(size=(6, 6)) + 1000.0
    x[:, 5] = 3.0
    fitted = projection.fit_components(frame(spark, x).repartition(5), "vec", 4)
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-8, 1.0, x.std(0))
    _, values, right = np.linalg.svd(z, full_matrices=False)
    assert fitted.scale[5] == 1.0 and fitted.explained == pytest.approx(values[:4] ** 2 / (values**2).sum())
    assert np.abs((fitted.components * right[:4]).sum(1)) == pytest.approx(np.ones(4))
    got = np.array([r["p"] for r in projection.project(frame(spark, x), "vec", "p", fitted, 8, ["id"]).orderBy("id").collect()])
    assert got.shape == (200, 8) and np.abs(got[:, :4]) == pytest.approx(np.abs(z @ right[:4].T), abs=1e-6) and not got[:, 4:].any()
    unit = [r["p"] for r in projection.project(frame(spark, x), "vec", "p", fitted, 4, ["id"], unit=True).collect()]
    assert np.linalg.norm(unit, axis=1) == pytest.approx(np.ones(200))
    with pytest.raises(ValueError):
        projection.fit_components(frame(spark, []), "vec", 2)


def test_relation_features(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{c}", t, rng.normal(size=5).tolist(), rng.normal(size=3).tolist(), rng.normal(size=2).tolist()) for c in range(3) for t in range(9)]
    frames = spark.createDataFrame(rows, "sample_id string, frame_index long, v array<double>, s array<double>, a array<double>").repartition(4)
    got = {r["sample_id"]: r["relation"] for r in projection.relation_features(frames, "v", "s", "a", size=4).collect()}
    draws = np.random.default_rng(42)
    matrices = [draws.standard_normal((w, 4)) / 2.0 for w in (5, 3, 2)]
    for c in range(3):
        mine = [r for r in rows if r[0] == f"c{c}"]
        seen = {}
        for k, name in enumerate(("visual", "state", "action")):
            x = np.array([r[2 + k] for r in mine])
            x = x / np.linalg.norm(x, axis=1, keepdims=True) if name == "visual" else x
            seen[name] = x @ matrices[k]
        for name in ("visual", "state", "action"):
            seen[f"delta_{name}"] = np.array([b - a for a, b in zip(seen[name], seen[name][1:])])
        want = [v for x in seen.values() for v in (*x.mean(0), *x.std(0), *(x[-1] - x[0]))]
        for a, b in projection.RELATIONS:
            n = min(len(seen[a]), len(seen[b]))
            for lag in (0, 1, 2, 4):
                want += np.mean([seen[a][t] * seen[b][t + lag] for t in range(n - lag)], axis=0).tolist()
        assert got[f"c{c}"] == pytest.approx(want)


def test_jitter(spark):
    """Against a plain Fourier sum; a pure tone is all above or all below the cutoff."""
    dt, n = 0.1, 24
    t = np.arange(n + 1) * dt
    clips = {"noise": np.random.default_rng(1).normal(size=(n + 1, 3)).cumsum(0), "slow": np.stack([np.sin(2 * np.pi * 0.5 * t)] * 3, 1), "still": np.zeros((n + 1, 3)), "short": np.zeros((3, 3)), "odd": np.random.default_rng(3).normal(size=(16, 3))}
    rows = [(name, k, p.tolist(), float(t[k])) for name, x in clips.items() for k, p in enumerate(x)]
    got = {r["sample_id"]: r for r in motion.jitter(spark.createDataFrame(rows, "sample_id string, frame_index long, position array<double>, timestamp double"), 1.9, 1.0).collect()}
    for name in ("noise", "odd"):
        v = np.diff(clips[name], axis=0) / dt
        m = len(v)
        v = (v - v.mean(0)) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m))[:, None]
        window = ((0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)) ** 2).sum()
        power = {}
        for k in range(m):
            f = k / (m * dt) if k <= m / 2 else (m - k) / (m * dt)
            e = np.abs((v * np.exp(-2j * np.pi * k * np.arange(m) / m)[:, None]).sum(0)) ** 2
            power[round(f, 9)] = power.get(round(f, 9), 0.0) + e.sum() * dt / window / (m * dt)
        total, high = sum(p for f, p in power.items() if f > 0), sum(p for f, p in power.items() if f > 1.9)
        assert (got[name]["ratio"], got[name]["total_rms"], got[name]["reason"]) == (pytest.approx(high / total), pytest.approx(total**0.5), "")
        assert got[name]["score"] == pytest.approx(1 - high / total)
    assert got["slow"]["ratio"] < 0.05 and got["still"]["reason"] == "low_fluctuation" and got["short"]["reason"] == "too_short" and got["still"]["score"] is None
    with pytest.raises(Exception, match="cutoff"):
        motion.jitter(spark.createDataFrame(rows[:5], "sample_id string, frame_index long, position array<double>, timestamp double"), 5.0, 1.0).collect()


def test_counts_and_confidence(spark):
    counts = [3, 9, 10, 400, 2048, 4096, 8192, 16384, 32768, 1_000_000]
    got = spark.createDataFrame([(k, n) for k, n in enumerate(counts)], "k int, n long").select("k", prototypes.centre_count(F.col("n")).alias("c")).orderBy("k").collect()
    assert [r["c"] for r in got] == [3, 9, 10, 10, 14, 18, 22, 26, 30, 30]
    bounds = prototypes.distance_bounds(spark.createDataFrame([("a", float(d)) for d in range(11)], "action string, distance double")).first()
    assert (bounds["low"], bounds["high"]) == (1.0, 9.0)
    rows = spark.createDataFrame([(float(d), 1.0, 9.0) for d in (0, 1, 5, 9, 10)] + [(4.0, 2.0, 2.0)], "d double, low double, high double")
    assert [r[0] for r in rows.select(prototypes.distance_confidence(F.col("d"), F.col("low"), F.col("high"))).collect()] == pytest.approx([1, 1, 0.65, 0.3, 0.3, 1])
    halves = spark.createDataFrame([("x", 3, 0.8), ("x", 3, 0.4), ("y", 3, 0.8), ("y", 4, 0.4)], "sample_id string, leaf long, weight double")
    assert sorted((r["sample_id"], r["leaf"], round(r["weight"], 6), r["slot"]) for r in prototypes.merge_halves(halves).collect()) == [("x", 3, 1.0, 0), ("y", 3, 0.8, 0), ("y", 4, 0.4, 1)]
    good = {c: y for c, y, _, _ in prototypes.ACCEPTANCE}
    assert prototypes.deviations(good) == [] and prototypes.deviations(good | {"stop": 0.25, "leaves": 1}) == ["leaves", "stop"]


def labels(spark, counts):
    total = sum(counts.values())
    return spark.createDataFrame([(x, n, n / total) for x, n in counts.items()], "label string, count long, proportion double")


def test_catalogues_and_parents(spark):
    counts = labels(spark, {"move left": 500, "move up": 450, "move left up": 20, "tilt up": 5})
    catalog = motion.action_catalog(counts, 400, 0.005)
    assert [r["label"] for r in catalog.orderBy("label_id").collect()] == ["move left", "move up", "stop"]
    parents = sorted((r["label"], r["parent"]) for r in motion.retained_parents(counts, catalog).collect())
    assert parents == [("move left", "move left"), ("move left up", "move left"), ("move left up", "move up"), ("move up", "move up"), ("tilt up", "stop")]
    assert motion.action_catalog(counts, 400, 0.005, stop_bucket=False).filter("label = 'stop'").count() == 0
    assert "stop" in [r["label"] for r in motion.label_catalog(counts, 0.1).collect()]
    with pytest.raises(ValueError):
        motion.action_catalog(counts, 10_000)
    soft = {(r["label"], r["target"]): r["weight"] for r in motion.softened(counts, motion.label_catalog(counts, 0.1)).collect()}
    assert soft["move left up", "move left"] == pytest.approx(500 / 950) and soft["move left up", "move up"] == pytest.approx(450 / 950) and soft["tilt up", "stop"] == 0.8
    rare = labels(spark, {"move left": 900, "move up": 100, "move left up": 1})
    assert {(r["target"], r["weight"]) for r in motion.softened(rare, motion.label_catalog(rare, 0.01)).filter("label = 'move left up'").collect()} == {("move left", 0.8)}


def track(spark, points, times=None):
    times = times or list(range(len(points)))
    return spark.createDataFrame([("c", k, [float(x) for x in p], float(t)) for k, (p, t) in enumerate(zip(points, times, strict=True))], "sample_id string, frame_index long, position array<double>, timestamp double")


def test_backtracking_counts_valid_pairs(spark):
    row = motion.backtracking(track(spark, [(0,), (1,), (0,), (0,), (1,), (2,)])).first()
    assert (row["backtracks"], row["pairs"], row["rate"], row["reason"]) == (1, 2, 0.5, "")
    for points, times, reason in (([(0,), (1,)], None, "too_short"), ([(0,), (1,), (2,)], [0, 1, 1], "non_increasing_time"), ([(0,), (1,), (2,)], [0, 1, 3], "non_uniform_time"), ([(0,), (0,), (1,)], None, "no_valid_comparisons")):
        row = motion.backtracking(track(spark, points, times)).first()
        assert (row["rate"], row["pairs"], row["reason"]) == (None, 0, reason)


def test_jumps_are_scaled_by_values(spark):
    actions = [[0.0], [0.0], [4.0], [4.0]]
    rows = spark.createDataFrame([(0, k, a) for k, a in enumerate(actions)], "episode_id long, frame_index long, action array<double>")
    assert [r["jump"] for r in motion.action_jumps(rows).orderBy("frame_index").collect()] == pytest.approx([0.0, 2.0, 0.0])


def test_rotations(spark):
    rng = np.random.default_rng(5)
    turns = [*rng.uniform(-1.5, 1.5, (20, 3)).tolist(), [0.0, 0.0, 0.0], [0.3, math.pi / 2, 0.0]]

    def matrix(r, p, y):
        rx = np.array([[1, 0, 0], [0, math.cos(r), -math.sin(r)], [0, math.sin(r), math.cos(r)]])
        ry = np.array([[math.cos(p), 0, math.sin(p)], [0, 1, 0], [-math.sin(p), 0, math.cos(p)]])
        rz = np.array([[math.cos(y), -math.sin(y), 0], [math.sin(y), math.cos(y), 0], [0, 0, 1]])
        return rz @ ry @ rx

    def spin(v):
        angle = np.linalg.norm(v)
        if not angle:
            return np.eye(3)
        k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / angle
        return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k

    rows = spark.createDataFrame([(k, t, [1.0, 2.0, 3.0, *t, 0.6 if k % 2 else 0.5]) for k, t in enumerate(turns)], "k int, e array<double>, a array<double>")
    q = scalar.rotation_quaternion(F.col("e"), "euler")
    got = rows.withColumn("q", q).select("k", "q", scalar.environment_action(F.col("a")).alias("act")).withColumn("back", scalar.quaternion_euler(F.col("q"))).withColumn(
        "again", scalar.quaternion_angle(F.col("q"), scalar.rotation_quaternion(F.slice("act", 4, 3)))).orderBy("k").collect()
    for t, r in zip(turns, got, strict=True):
        assert np.allclose(spin(np.array(r["act"][3:6])), matrix(*t), atol=1e-7) and r["again"] == pytest.approx(0, abs=1e-6)
        assert r["act"][:3] == [1.0, 2.0, 3.0] and r["act"][6] == (1.0 if r["k"] % 2 else -1.0)
        assert np.allclose(matrix(*r["back"]), matrix(*t), atol=1e-6)
    assert scalar.number_tag(12.5) == "12p5" and scalar.number_tag(10.0) == "10"


def test_diverse_fragments():
    """With few rows all others are candidates: every choice is the best score less the penalty from all that is chosen."""
    rng = np.random.default_rng(7)
    n, size = 150, 130
    score, x, ids = rng.uniform(size=n), rng.normal(size=(n, 4)), [f"s{k:03d}" for k in rng.permutation(n)]
    got = selection.diverse_fragments(score, x, ids, size, seed=3)
    order = sorted(range(n), key=lambda k: (-score[k], ids[k]))
    sigma = np.mean([np.linalg.norm(x[a] - x[b]) for i, a in enumerate(order[:100]) for b in order[:i]])
    chosen = order[:100]
    assert got["row"].tolist()[:100] == chosen

    def adjusted(k):
        near = sorted(((-math.exp(-np.sum((x[k] - x[c]) ** 2) / (2 * sigma**2)), ids[c], c) for c in chosen))[:5]
        return score[k] - sum(-s * score[c] for s, _, c in near) / len(near)

    for row, value in zip(got["row"].tolist()[100:], got["adjusted"].tolist()[100:], strict=True):
        best = min((k for k in range(n) if k not in chosen), key=lambda k: (-adjusted(k), -score[k], ids[k]))
        assert row == best and value == pytest.approx(adjusted(best))
        chosen.append(best)
    big = selection.diverse_fragments(rng.uniform(size=600), rng.normal(size=(600, 3)), [str(k) for k in range(600)], 300, seed=1)
    again = selection.diverse_fragments(np.random.default_rng(0).uniform(size=600), x := rng.normal(size=(600, 3)), [str(k) for k in range(600)], 300, seed=1)
    assert len(set(big["row"])) == 300 == len(set(again["row"]))
    with pytest.raises(ValueError):
        selection.diverse_fragments(score, np.zeros((n, 1)), ids, 99, seed=0)


def test_diverse_stage(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(f"s{k}", float(v)) for k, v in enumerate(rng.uniform(size=240))], "sample_id string, q double")
    points = spark.createDataFrame([(f"s{k}", rng.normal(size=3).tolist()) for k in range(240)], "sample_id string, vec array<double>")
    got = selection.diverse_stage(rows, points, "q", 50, seed=2)
    assert got.count() == 120 == got.select("sample_id").distinct().count() and got.join(rows, "sample_id").count() == 120
    with pytest.raises(ValueError):
        selection.diverse_stage(rows, points.limit(100), "q", 50, seed=2)
    with pytest.raises(ValueError):
        selection.diverse_stage(rows, points, "q", 50, seed=2, most_rows=100)


def test_full_greedy(spark):
    """Each choice against the objective recomputed by the distributed operator's plain form."""
    rng = np.random.default_rng(4)
    n, m = 12, 4
    mass = rng.uniform(size=(n, m)) * (rng.uniform(size=(n, m)) < 0.6)
    transition, together = rng.dirichlet(np.ones(m * m)).reshape(m, m), rng.dirichlet(np.ones(m * m)).reshape(m, m)
    rarity = rng.dirichlet(np.ones(m))
    edges = np.array([(k, k + 1) for k in range(n - 1) if k % 4 != 3])
    penalties = [(0, 1, 0.5), (2, 7, 0.9), (3, 5, 0.2)]
    tasks, quotas = [k % 3 for k in range(n)], {0: 2, 1: 2, 2: 2}

    def value(rows):
        cover = mass[rows].max(0) if rows else np.zeros(m)
        counts = sum((np.outer(mass[a], mass[b]) for a, b in edges if a in rows and b in rows), np.zeros((m, m)))
        whole = sum(np.outer(mass[a], mass[b]) for a, b in edges)
        pair = np.sqrt(np.outer(cover, cover))
        r = sum(p for a, b, p in penalties if a in rows and b in rows) / 1.6
        return 4 * rarity @ cover + 1.2 * (transition * pair).sum() + 0.5 * (together * pair).sum() + 2 * (transition * np.log1p(counts) / (np.log1p(whole) + 1e-8)).sum() - 2 * r

    got, values = selection.full_greedy(mass, rarity, transition, together, edges, penalties, 6, tasks, quotas)
    rows, left = [], dict(quotas)
    for k, v in zip(got, values, strict=True):
        options = [x for x in range(n) if x not in rows and left[tasks[x]]]
        assert value([*rows, k]) == pytest.approx(max(value([*rows, x]) for x in options)) == pytest.approx(v)
        rows.append(k)
        left[tasks[k]] -= 1
    seeded, _ = selection.full_greedy(mass, rarity, transition, together, edges, penalties, 3, start=[9])
    assert seeded[0] == 9 and len(seeded) == 3


def test_bounded_simplex():
    rng = np.random.default_rng(0)
    grid = [np.array([a, b, c, 1 - a - b - c]) for a in np.arange(0, 1.001, 0.05) for b in np.arange(0, 1.001 - a, 0.05) for c in np.arange(0, 1.001 - a - b, 0.05)]
    for _ in range(20):
        g, h = rng.normal(size=4), rng.normal(size=(4, 4))
        h = h + h.T
        low, high = np.array([0.1, 0.0, 0.05, 0.0]), np.array([0.6, 0.5, 0.7, 0.4])
        w = selection.bounded_simplex(g, h, low, high)
        value = lambda v: g @ v + v @ h @ v / 2
        assert w.sum() == pytest.approx(1) and (w >= low - 1e-9).all() and (w <= high + 1e-9).all()
        assert value(w) >= max(value(v) for v in grid if (v >= low - 1e-9).all() and (v <= high + 1e-9).all()) - 1e-9
    with pytest.raises(ValueError):
        selection.bounded_simplex(np.zeros(2), np.zeros((2, 2)), [0.6, 0.6], [1, 1])


def test_nested_errors():
    rng = np.random.default_rng(0)
    x = rng.dirichlet(np.ones(3), 9)[:, :2]
    y = 1 + x @ [2.0, -1.0]
    assert np.abs(selection.nested_errors(x, y, [1e-6, 1.0])).max() < 1e-3


def test_interleaved():
    assert selection.interleaved([4, 2, 1]) == [0, 1, 2, 0, 1, 0, 0] and selection.interleaved([0, 2]) == [1, 1]


def test_splits_and_demos(spark):
    episodes = spark.range(400).withColumnRenamed("id", "episode_id")
    train, held = selection.split_episodes(episodes, percent=10)
    assert train.count() + held.count() == 400 and 10 < held.count() < 80 and train.join(held, "episode_id").count() == 0
    with pytest.raises(ValueError):
        selection.split_episodes(episodes.limit(3), percent=1)
    chosen = selection.target_demos([f"demo_{k}" for k in range(9)], "a task", 5)
    assert len(set(chosen)) == 5 and chosen == selection.target_demos([f"demo_{k}" for k in reversed(range(9))], "a task", 5)
    with pytest.raises(ValueError):
        selection.target_demos(["x"], "a task", 2)


@pytest.mark.parametrize("groups", [False, True])
def test_numbered_is_a_global_order(spark, groups):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(s), f"r{k:04d}") for k, (g, s) in enumerate(zip(rng.integers(0, 3, 700), rng.integers(0, 5, 700), strict=True))]
    df = spark.createDataFrame(rows, "g long, s double, id string").repartition(7)
    got = ordering.numbered(df, -F.col("s"), F.col("id"), by=["g"] if groups else ()).collect()
    for g in {0, 1, 2} if groups else {None}:
        mine = sorted((r for r in got if g is None or r["g"] == g), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1)) and [(-r["s"], r["id"]) for r in mine] == sorted((-r["s"], r["id"]) for r in mine)
    assert ordering.numbered(df.limit(0), F.col("s"), F.col("id")).count() == 0


def test_median_sigma_and_reference(spark):
    x = np.random.default_rng(1).normal(size=(60, 3))
    want = np.median([np.linalg.norm(a - b) for k, a in enumerate(x) for b in x[:k]])
    assert similarity.median_sigma(frame(spark, x)) == pytest.approx(want, rel=0.05) and similarity.median_sigma(frame(spark, x[:1])) == 1.0
    assert similarity.reference_sample(frame(spark, x), 10).count() == 10


def test_product_edges(spark):
    nodes = spark.createDataFrame([(k, f"s{k}", 0, 15 * k, 15 * k + 14, r) for k, r in enumerate((0.5, 0.8, 0.4, 1.0))], "node long, sample_id string, episode_id long, start_step long, end_step long, reliability double")
    assert [r["weight"] for r in graph.sequence_edges(nodes).orderBy("source").collect()] == pytest.approx([0.5, 0.4, 0.4])
    assert [r["weight"] for r in graph.sequence_edges(nodes, product=True).orderBy("source").collect()] == pytest.approx([0.4, 0.32, 0.4])
    assert sorted(round(r["weight"], 6) for r in graph.cooccurrence_edges(nodes, 3).collect()) == [0.2, 0.5, 0.8]


def test_span_weighted(spark):
    rows = [(1, s, s, float(s), 0.5) for s in (10, 20, 40)] + [(1, 40, 99, 100.0, 0.5), (2, 20, 1, 1.0, 0.1), (3, 15, 1, 2.0, 0.0), (3, 40, 2, 4.0, 0.0)]
    settings = spark.createDataFrame([(1, 10, 40), (2, 0, 40), (3, 10, 40)], "run long, warmup long, expected long")
    got = {r["run"]: r for r in aggregates.span_weighted(spark.createDataFrame(rows, "run long, step long, row long, seconds double, wait double"), settings, ("seconds", "wait"), "seconds", 8).collect()}
    assert got[1]["seconds"] == pytest.approx((20 * 10 + 100 * 20) / 30) and got[1]["measured_steps"] == 30 and got[1]["problem"] == ""
    assert (got[2]["problem"], got[3]["problem"], got[3]["seconds"]) == ("incomplete", "no_warmup_boundary", None)


def written(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_strict_scores(spark, tmp_path):
    good = written(tmp_path, "a.csv", "sample_id,length,score,note\n a ,15,0.5,x\nb,15,1.0,007\n")
    rows = scores.read_scores(spark, good, "score", ("sample_id", "length"))
    assert sorted((r["sample_id"], r["score"], r["note"]) for r in rows.collect()) == [("a", 0.5, "x"), ("b", 1.0, "007")]
    for text in ("sample_id,score\na,0.5\n", "sample_id,length,score\n", "sample_id,length,score\n,1,0.5\n", "sample_id,length,score\na,1,1.5\n", "sample_id,length,score\na,1,x\n", "sample_id,length,score\na,1,0.5\na,1,0.5\n"):
        with pytest.raises(scores.SourceError):
            scores.read_scores(spark, written(tmp_path, "b.csv", text), "score", ("sample_id", "length"))
    with pytest.raises(scores.SourceError):
        scores.read_scores(spark, good, "score", ("sample_id",), forbidden=("note",))
    ranking = "sample_id,length,score,place\nb,15,1.0,1\na,15,0.5,2\n"
    assert scores.read_ranking(spark, written(tmp_path, "r.csv", ranking), "score").count() == 2
    with pytest.raises(scores.SourceError):
        scores.read_ranking(spark, written(tmp_path, "r2.csv", ranking.replace(",1\n", ",3\n")), "score")
    again = scores.rescored(spark.createDataFrame([("a", "0.5", "1.0", "old")], "id string, q string, c string, t string"), {"q": 0.8, "c": 0.1}, "t").first()
    assert again["t"] == pytest.approx(0.5) and again["q"] == "0.5"


def test_strict_fragments(spark, tmp_path):
    episodes = spark.createDataFrame([(1, 20), (2, 10)], "episode_id long, length long")
    line = '{"episode_id": %s, "start_step": %s, "end_step": %s}\n'
    assert scores.read_fragments(spark, written(tmp_path, "f.jsonl", line % (1, 0, 14) + line % (2, 3, 9)), episodes).count() == 2
    for bad in (line % (3, 0, 1), line % (1, 5, 4), line % (1, 0, 20), line % (1, "true", 3), line % (1, 0.5, 3), '{"episode_id": 1}\n', line % (1, 0, 1) * 2):
        with pytest.raises(scores.SourceError):
            scores.read_fragments(spark, written(tmp_path, "g.jsonl", bad), episodes)
    chosen = spark.createDataFrame([(1, 0, 14, 1, 0.5), (2, 0, 9, 2, 0.25)], "episode_id long, start_step long, end_step long, selection_order long, score double")
    scores.write_selection(chosen, str(tmp_path / "out"), {"percent": 10})
    rows, manifest = scores.read_selection(spark, str(tmp_path / "out"), episodes)
    assert rows.count() == 2 == manifest["selected"] and manifest["parameters"] == {"percent": 10}
    weights = scores.weight_rows(spark, written(tmp_path, "w.jsonl", '{"q": 0.5, "c": 0.5}\n{"q": 1.0, "c": 0.0}\n'), ["q", "c"])
    assert weights.count() == 2
    with pytest.raises(scores.SourceError):
        scores.weight_rows(spark, written(tmp_path, "w2.jsonl", '{"q": 0.5, "c": 0.6}\n'), ["q", "c"])


def test_aligned_vectors(spark):
    table = spark.createDataFrame([("a", 0.5), ("b", 0.6)], "sample_id string, score double")
    points = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 1.0])], "sample_id string, vec array<double>")
    assert scores.aligned(table, points, 2).count() == 2
    for bad in (points.limit(1), points.unionByName(points.withColumn("sample_id", F.concat("sample_id", F.lit("x")))), points.withColumn("vec", F.array(F.lit(float("nan")), F.lit(1.0)))):
        with pytest.raises(scores.SourceError):
            scores.aligned(table, bad, 2)
    with pytest.raises(scores.SourceError):
        scores.aligned(table, points, 3)


def test_overlap_and_status(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 2), ("z", 9)], "selection string, sample_id long")
    assert [tuple(r) for r in aggregates.overlap(rows).collect()] == [("x", "y", 1)]
