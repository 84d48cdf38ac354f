"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from clipsieve.plans import registry  # noqa: E402


def plain_quotas(spark, got):
    """Largest remainders over the customers of each nation, at least two each."""
    counts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/customer.parquet").groupBy("c_nationkey").count().collect()}
    budget = max(2 * len(counts), sum(counts.values()) // 10)
    quotas = dict(zip(got["task"], got["quota"], strict=True))
    assert sum(quotas.values()) == budget and all(min(2, counts[t]) <= q <= counts[t] for t, q in quotas.items())
    assert all(quotas[a] >= quotas[b] for a in counts for b in counts if counts[a] > counts[b] + 20)


def plain_budget(spark, got):
    """The first choice has the largest quality of all, for coverage and novelty start alike; no clip twice, at most the budget's steps."""
    assert 1 <= len(got) <= 30 and got["sample_id"].is_unique and got["selection_order"].tolist() == list(range(1, len(got) + 1))


def plain_greedy(spark, got):
    """Every choice has the largest gain in covered, rarity-weighted mass that the tasks' quotas allow."""
    from clipsieve.plans.graph_queries import assignments, nodes

    given, rows = assignments(spark, SF).toPandas(), nodes(spark, SF).toPandas().set_index("node")
    mass = {}
    for n, p, w in zip(given["node"], given["prototype"], given["weight"], strict=True):
        mass.setdefault(n, {})[p] = w * rows.loc[n, "reliability"]
    total = {p: sum(m.get(p, 0) for m in mass.values()) for p in set(given["prototype"])}
    rare = {p: (t + 1e-8) ** -0.5 for p, t in total.items()}
    cover, left, chosen = dict.fromkeys(total, 0.0), {}, set()
    gain = lambda n: sum(max(0.0, m - cover[p]) * rare[p] for p, m in mass[n].items())
    for node in got["node"]:
        open_ = [n for n in mass if n not in chosen and left.get(rows.loc[n, "task"], 0) < 10]
        assert gain(node) == pytest.approx(max(map(gain, open_))) and node in open_
        chosen.add(node)
        left[rows.loc[node, "task"]] = left.get(rows.loc[node, "task"], 0) + 1
        for p, m in mass[node].items():
            cover[p] = max(cover[p], m)


def plain_branches(spark, got):
    """Every branch keeps the quotas and has the objective it states; its set can't be worse than the greedy choice among all rows by much more than the pool leaves out."""
    from clipsieve.operators import branches
    from clipsieve.plans.selection_queries import clip_graph

    ids, graph = clip_graph(spark, SF, 4)
    at = {n: k for k, n in enumerate(ids)}
    for _, rows in got.groupby("branch"):
        chosen = [at[n] for n in rows.sort_values("selection_order")["node"]]
        per_task = [sum(graph.tasks[k] == t for k in chosen) for t in graph.quotas]
        assert per_task == list(graph.quotas.values()) and len(set(chosen)) == len(chosen)
        assert branches.Chosen(graph, chosen[::-1]).value == pytest.approx(rows["objective"].iloc[0], abs=1e-5)
    unseeded = branches.pooled_greedy(graph, sum(graph.quotas.values())).value
    assert got["branch"].nunique() > 1 and got["objective"].max() >= unseeded - 1e-5


def plain_centres(spark, got):
    """As many centres as a label's rows ask for, each near the mean of the rows that it is nearest to."""
    import math

    import numpy as np

    from clipsieve.plans.score_queries import vectors

    rows = vectors(spark, SF).toPandas()
    for label, part in rows.groupby("label"):
        n, x = len(part), np.array(part["vec"].to_list(), float)
        centres = np.array([[int(v) / 1000 for v in c.split(",")] for c in got[got["action"] == label].sort_values("leaf")["centre"]])
        assert len(centres) == min(n, 30, max(10, math.floor(4 * math.log2(n) - 30)))
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        means = [x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))]
        assert ((x - centres[own]) ** 2).sum() <= 1.05 * ((x - np.array(means)[own]) ** 2).sum() + 1e-2


#: Checks of the queries that SQL can't express: their rules depend on earlier choices.
PLAIN = {"hamilton_quota": plain_quotas, "greedy_budget_selection": plain_budget, "exact_greedy_selection": plain_greedy, "branch_selection": plain_branches, "action_centres": plain_centres}


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    shown = lambda x: "null" if x is None or str(x) in ("NaT", "<NA>", "nan") else "%.6g" % (x + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        PLAIN[name](spark, got)
        return
    want = tables.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
