"""Cases that once gave wrong rows, or more work than a table's size warrants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.operators import prototypes
from clipsieve.plans import registry

duckdb = pytest.importorskip("duckdb")


def events(path, rows):
    """``events`` of (user, value, k, hour) rows, in order of time."""
    con = duckdb.connect()
    con.execute("CREATE TABLE t (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    for n, (user, value, k, hour) in enumerate(rows):
        con.execute(f"INSERT INTO t VALUES ({n}, TIMESTAMP '2024-01-01 {hour:02d}:00:00' + to_minutes({n}) * 1440, {user}, 'view', {value}, '{{\"k\": {k}}}')")
    con.execute(f"COPY t TO '{path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return con


def test_turns_at_the_cut(spark, tmp_path):
    con = events(tmp_path, [(n % 2, v, 0, 0) for n, v in enumerate((0.5, 150.0, 0.49, 0.51, 149.99, 150.01, 0.0))])
    got = registry.QUERIES["environment_actions"](spark, str(tmp_path)).toPandas().sort_values(["episode_id", "frame_index"])
    want = con.sql(registry.ORACLES["environment_actions"]).df().sort_values(["episode_id", "frame_index"])
    for c in want.columns:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9)


def test_ordered_mean(spark):
    """Sums don't depend on the order in which rows come."""
    rows = [(2, [1.0]), (1, [-1e16]), (0, [1e16])]
    assert spark.createDataFrame(rows, "at long, v array<double>").coalesce(1).agg(prototypes.ordered_mean("v", "at", 1).alias("m")).first()["m"] == [1 / 3]


def test_merged_weight_is_not_shortened(spark):
    rows = spark.createDataFrame([("a", 1, 0.7125)], "sample_id string, leaf long, weight double")
    assert prototypes.merge_halves(rows, "double").select(F.round("weight", 3)).first()[0] == 0.713


@pytest.mark.parametrize("width", [1, 2, 3])
def test_short_vectors_without_all_pairs(spark, monkeypatch, width):
    """Kernel means and nearest distances agree with all pairs, with copies, outliers and near copies among the points."""
    from clipsieve.operators import lowdim, similarity

    monkeypatch.setattr(lowdim, "PAIRS", 1)
    monkeypatch.setattr(lowdim, "LEAF", 20)
    monkeypatch.setattr(similarity, "_blocks", None)  # no pairs of blocks may be met
    rng = np.random.default_rng(width)
    x = rng.normal(0.5, 0.15, (300, width))
    x[50:90], x[90:95], x[100] = x[3], x[4] + 1e-15, 2.5
    rows = spark.createDataFrame([(n, [float(c) for c in v]) for n, v in enumerate(x)], "id long, vec array<double>")
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = similarity.mean_affinity(rows, rows.filter("id < 200"), 0.2).toPandas().sort_values("id")
    np.testing.assert_allclose(got["affinity"], np.exp(-(apart[:, :200] ** 2) / 0.08).mean(1), atol=1e-12)
    np.fill_diagonal(apart, np.inf)
    got = similarity.nearest_values(rows, 20).toPandas().sort_values("id")
    np.testing.assert_allclose(np.array(got["values"].to_list()), np.sort(apart, axis=1)[:, :20], atol=1e-13)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = (unit @ unit.T + 1) / 2
    got = similarity.diversity(rows, rows).toPandas().sort_values("id")
    np.testing.assert_allclose(got["diversity"], 1 - (cosine.sum(1) - 1) / 299, atol=1e-12)


@pytest.mark.parametrize("pool", [1, 7, 500])
def test_covering_selection_in_passes(spark, pool):
    """Small pools give the choices of the plain rule, with ties among copies and quotas."""
    import pandas as pd

    from clipsieve.operators import selection

    rng = np.random.default_rng(3)
    mass = np.round(rng.random((120, 4)) * (rng.random((120, 4)) < 0.5), 1)
    mass[60:] = mass[:60]
    table = pd.DataFrame({"node": rng.permutation(120), "task": np.arange(120) % 3})
    rows = spark.createDataFrame([(int(n), int(t), [float(x) for x in m]) for n, t, m in zip(table["node"], table["task"], mass)], "node long, task long, mass array<double>")
    rare = 1 / np.sqrt(mass.sum(0) + 1e-8)
    for quotas in (None, {0: 4, 1: 3, 2: 5}):
        assert selection.covering_selection(rows, range(4), 12, quotas, pool) == selection.exact_greedy(table, mass, rare / rare.sum(), 12, quotas)


def test_budget_selection_in_passes(spark):
    import pandas as pd

    from clipsieve.operators import selection

    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    clips = pd.DataFrame({"sample_id": [f"s{i:02d}" for i in range(90)], "length": rng.integers(2, 9, 90), "quality": rng.random(90), "novelty": rng.random(90), "score": rng.random(90)})
    rows = spark.createDataFrame(clips.assign(vec=x.tolist()).to_dict("records"), "sample_id string, length long, quality double, novelty double, score double, vec array<double>")
    assert selection.budget_selection(rows, 40, (0.4, 0.2, 0.2, 0.2), 1.5) == selection.greedy_budget(clips, x, 40, (0.4, 0.2, 0.2, 0.2), 1.5)


def test_parts_of_a_search_give_a_query_its_k_best_once(spark, monkeypatch):
    """However many leaves of a bundle a query visits, a part of it gives the query k rows at most."""
    from clipsieve.llm import neighbours
    from clipsieve.llm.common import Scratch

    monkeypatch.setattr(neighbours, "BUNDLES", 1)
    monkeypatch.setattr(neighbours, "LEAF_SHARE", 0.8)
    x = np.random.default_rng(4).normal(size=(400, 6))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    met = []
    monkeypatch.setattr(neighbours, "_meet", lambda *a, f=neighbours._meet: met.append(a) or f(*a))
    got = neighbours.search(frame, Scratch(spark, "t8d"), k=3, recall=1.0)
    assert met[0][3] > 4  # leaves visited
    found = got._jdf.queryExecution()
    assert got.count() == 20 * 3
    names = found.executedPlan().toString()
    assert "bundle" in names and "[leaf" not in names.split("FlatMapCoGroupsInArrow")[1].split("\n")[0]


def test_branches_of_many_rows(spark):
    """More rows than 20,000 are chosen from, to the last one."""
    from clipsieve.operators import branches

    n = 20_100
    mass = np.zeros((n, 2))
    mass[n - 1], mass[n - 2] = (1.0, 0.0), (0.0, 0.9)
    graph = branches.Graph(mass, np.ones(n), np.array([0.5, 0.5]), np.zeros((2, 2)), np.zeros((2, 2)), np.zeros((0, 2), int), [], mass, list(range(n)))
    found = branches.best_branch(spark, graph, 2, 1, rounds=0)
    assert found["chosen"].iloc[0] == [n - 1, n - 2]


@pytest.mark.parametrize("quotas", [None, {0: 3, 1: 2, 2: 4}])
def test_branches_in_passes(spark, monkeypatch, quotas):
    """Pairs, choices and exchanges over stored tables are those on the whole graph, with ties among copies, and the driver meets few of the rows."""
    from clipsieve.operators import branch_passes, branches

    monkeypatch.setattr(branch_passes, "BLOCK", 16)
    rng = np.random.default_rng(7)
    n, m = 900, 4
    mass = np.round(rng.uniform(size=(n, m)) * (rng.uniform(size=(n, m)) < 0.6), 1)
    mass[600:] = mass[:300]
    trust = rng.integers(1, 20, n) / 20
    edges = [(k, k + 1) for k in range(n - 1) if k % 5 != 4] + [(9, 4), (9, 4)]
    alike = [(int(a), int(z), float(p)) for a, z, p in zip(rng.integers(0, 450, 200), rng.integers(450, n, 200), rng.uniform(size=200)) if (a, z) != (0, 0)]
    transition, together, rarity = rng.dirichlet(np.ones(m * m)).reshape(m, m), rng.dirichlet(np.ones(m * m)).reshape(m, m), rng.dirichlet(np.ones(m))
    vectors, tasks = rng.normal(size=(n, 3)), [k % 3 for k in range(n)]
    whole = branches.Graph(mass, trust, rarity, transition, together, np.array(edges), alike, vectors, [k // 5 for k in range(n)], tasks if quotas else None, quotas)

    rows = spark.createDataFrame([(10 * k, k // 5, tasks[k], float(trust[k]), mass[k].tolist(), vectors[k].tolist()) for k in rng.permutation(n).tolist()], "node long, episode_id long, task long, reliability double, mass array<double>, vec array<double>")
    ends = spark.createDataFrame([(10 * a, 10 * z) for a, z in edges], "source long, target long")
    pairs = spark.createDataFrame([(10 * a, 10 * z, p) for a, z, p in alike], "source long, target long, penalty double")
    seen = branch_passes.Seen(rarity, transition, together, quotas=quotas)
    tables = branch_passes.Tables(rows, ends, pairs, seen, m)
    np.testing.assert_allclose(seen.walks, whole.walks)
    got = branch_passes.greedy(tables, 9, [()], 3, 8, 2, 5)
    assert got[0].rows == branches.pooled_greedy(whole, 9, (), 3, 8, 2, 5).rows
    assert len(seen.mass) < n / 2
    starts = [(), *tables.seed_pairs(3, kept=20)]
    assert starts[1:] == branches.seed_pairs(whole, 3, kept=20) and len(starts) > 2
    got = branch_passes.greedy(tables, 9, starts, 3, 8, 2, 5)
    want = [branches.pooled_greedy(whole, 9, start, 3 + x, 8, 2, 5) for x, start in enumerate(starts)]
    assert [s.rows for s in got] == [s.rows for s in want]
    got, want = branch_passes.refine(tables, got, 2, 5, 12), [branches.swapped(s, 2, 5, 12)[0] for s in want]
    assert [s.rows for s in got] == [s.rows for s in want] and [s.value for s in got] == pytest.approx([s.value for s in want])


def test_branch_selection_holds_no_whole_graph(spark, tmp_path, monkeypatch):
    """The query never makes the graph of all rows on the driver."""
    from clipsieve.operators import branches

    events(tmp_path, [(n % 6, n % 7, n % 5, n % 24) for n in range(6 * 64)])
    monkeypatch.setattr(branches, "Graph", None)
    got = registry.QUERIES["branch_selection"](spark, str(tmp_path)).toPandas()
    assert set(got.groupby("branch")["node"].nunique()) == {12} and got["branch"].nunique() > 1
