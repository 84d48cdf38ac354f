"""Top k, percentages, quotas and sequential selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import branch_passes, branches, prototypes, similarity
from ..operators import graph as g
from ..operators import selection as c
from ..operators.stored import stored
from ..sources import tables
from .base import query, rounded
from .graph_queries import _NODES, assignments, nodes
from .score_queries import _SCORES, TDUS, scores, vectors

_TDUS = _SCORES + ", ranked AS (SELECT sample_id, round(least(greatest(0.4 * quality + 0.2 * coverage + 0.2 * diversity + 0.2 * novelty, 0), 1), 9) AS tdus FROM scores)"


def tdus(spark: SparkSession, sf: str) -> DataFrame:
    return stored(similarity.combined(scores(spark, sf), TDUS, "tdus").withColumn("tdus", F.round("tdus", 9)).select("sample_id", "length", "tdus"))


@query(_TDUS + " SELECT sample_id, round(tdus, 6) AS tdus FROM ranked ORDER BY ranked.tdus DESC, sample_id LIMIT 50")
def tdus_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.top_k(tdus(spark, sf), "tdus", 50).select("sample_id", "tdus"))


@query(_TDUS + " SELECT sample_id, round(tdus, 6) AS tdus FROM ranked QUALIFY row_number() OVER (ORDER BY ranked.tdus DESC, sample_id) <= ceil(count(*) OVER () * 12.5 / 100)")
def tdus_percent(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.top_percent(tdus(spark, sf), "tdus", "12.5").select("sample_id", "tdus"))


@query(_TDUS + " SELECT sample_id FROM ranked QUALIFY row_number() OVER (ORDER BY ranked.tdus DESC, sample_id) <= floor(count(*) OVER () * 0.1 + 0.5)")
def ratio_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = tdus(spark, sf)
    return c.top_k(rows, "tdus", c.ratio_budget(rows.count(), 0.1)).select("sample_id")


@query(_NODES + " SELECT task, sample_id FROM nodes QUALIFY row_number() OVER (PARTITION BY task ORDER BY md5('11:' || sample_id), sample_id) <= ceil(count(*) OVER (PARTITION BY task) * 10 / 100)")
def random_clips_per_task(spark: SparkSession, sf: str) -> DataFrame:
    return c.per_group_percent(nodes(spark, sf).select("task", "sample_id"), "task", 10, 11)


@query(_NODES + " SELECT sample_id FROM nodes ORDER BY md5('5:' || sample_id), sample_id LIMIT 40")
def seeded_random_selection(spark: SparkSession, sf: str) -> DataFrame:
    return c.random_selection(nodes(spark, sf), 40, 5)


@query()
def hamilton_quota(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the customers, at least two a nation (some 25 numbers come to the driver)."""
    counts = {r[0]: r[1] for r in tables.table(spark, sf, "customer").groupBy("c_nationkey").count().collect()}
    quotas = c.allocate_quotas(counts, max(2 * len(counts), sum(counts.values()) // 10), 2)
    return spark.createDataFrame(sorted(quotas.items()), "task long, quota long")


@query()
def greedy_budget_selection(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("id")
    clips = vectors(spark, sf).select(F.format_string("ep%06d", at).alias("sample_id"), F.lit(15).alias("length"), (at * 37 % 101 / 100.0).alias("quality"), (at * 53 % 97 / 96.0).alias("novelty"), (at * 37 % 101 / 100.0).alias("score"), "vec")
    chosen = c.budget_selection(clips, 450, (0.4, 0.2, 0.2, 0.2), 1.5)
    return spark.createDataFrame(list(enumerate(chosen, 1)), "selection_order long, sample_id string")


@query()
def exact_greedy_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = nodes(spark, sf)
    given = stored(assignments(spark, sf).join(rows.select("node", "task", "reliability"), "node").select("node", "task", "prototype", (F.col("weight") * F.col("reliability")).alias("mass")))
    kinds = [r[0] for r in given.select("prototype").distinct().orderBy("prototype").collect()]  # event types
    wide = given.groupBy("node", "task").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("prototype") == p, F.col("mass"))), F.lit(0.0)) for p in kinds]).alias("mass"))
    chosen = c.covering_selection(wide, kinds, 30, {r[0]: 10 for r in given.select("task").distinct().collect()})
    return spark.createDataFrame(list(enumerate(chosen, 1)), "selection_order long, node long")


@query("""WITH quotas(source, quota) AS (VALUES (0, 4), (1, 2), (2, 1)),
    pattern AS (SELECT source, quota, row_number() OVER (ORDER BY turn, source) - 1 AS k FROM quotas, (SELECT unnest(range(0, 4)) AS turn) WHERE turn < quota),
    batches AS (SELECT step, slot, source, quota FROM (SELECT DISTINCT o_orderkey % 100 AS step FROM orders), (SELECT unnest(range(0, 7)) AS slot), pattern WHERE k = (step + slot) % 7)
    SELECT step, slot, source::BIGINT AS source, (step * quota + row_number() OVER (PARTITION BY step, source ORDER BY slot) - 1)::BIGINT AS draw FROM batches""")
def interleaved_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of seven from three sources by weights 3, 2 and 1: quotas 4, 2 and 1."""
    steps = tables.table(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("step")).distinct()
    return c.interleaved_batches(steps, (3, 2, 1), 7)


def clip_graph(spark: SparkSession, sf: str, quota: int | None = None, most_rows: int = 2_000_000) -> tuple[list[int], branches.Graph]:
    """The clips' nodes in order and their graph; more than ``most_rows`` are an error. Matrices over event types are small."""
    rows = nodes(spark, sf)
    if rows.count() > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    table = rows.orderBy("node").toPandas()
    given, at = assignments(spark, sf), {n: k for k, n in enumerate(table["node"])}
    wide = given.toPandas().pivot(index="node", columns="prototype", values="weight").fillna(0.0).loc[table["node"]]
    kinds = {p: k for k, p in enumerate(wide.columns)}

    def matrix(edges: DataFrame) -> np.ndarray:
        out = np.zeros((len(kinds), len(kinds)))
        for p, q, x in g.prototype_matrix(edges, given).collect():
            out[kinds[p], kinds[q]] = x
        return out

    edges = g.sequence_edges(rows).toPandas()
    ends = np.array([[at[a], at[b]] for a, b in zip(edges["source"], edges["target"], strict=True)], int).reshape(-1, 2)
    trust = table["reliability"].to_numpy()
    alike = [(a, b, trust[a] * trust[b] * max(0.0, min(1.0, 0.7 + w / 2) - 0.8) / 0.2) for (a, b), w in zip(ends.tolist(), edges["weight"], strict=True)]
    rare = 1 / np.sqrt(wide.to_numpy().sum(0) + 1e-8)
    tasks = table["task"].tolist()
    return table["node"].tolist(), branches.Graph(wide.to_numpy() * trust[:, None], trust, rare / rare.sum(), matrix(g.sequence_edges(rows, product=True)), matrix(g.cooccurrence_edges(rows, 3)), ends, alike,
                                                  wide.to_numpy(), table["episode_id"].tolist(), tasks if quota else None, {t: quota for t in set(tasks)} if quota else None)


def clip_tables(spark: SparkSession, sf: str) -> dict:
    """What ``clip_graph`` holds, as tables; only matrices and sums over event types are on the driver."""
    rows, given = stored(nodes(spark, sf)), stored(assignments(spark, sf))
    often = sorted((p, w) for p, w in given.filter("prototype IS NOT NULL").groupBy("prototype").agg(F.sum("weight")).collect())
    kinds = {p: k for k, (p, _) in enumerate(often)}

    def matrix(edges: DataFrame) -> np.ndarray:
        out = np.zeros((len(kinds), len(kinds)))
        for p, q, x in g.prototype_matrix(edges, given.filter("prototype IS NOT NULL")).collect():
            out[kinds[p], kinds[q]] = x
        return out

    wide = given.groupBy("node").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("prototype") == p, F.col("weight"))), F.lit(0.0)) for p in kinds]).alias("vec"))
    clips = rows.select("node", "episode_id", "task", "reliability").join(wide, "node").withColumn("mass", F.transform("vec", lambda w: w * F.col("reliability")))
    edges, moves = stored(g.sequence_edges(rows)), stored(g.sequence_edges(rows, product=True))
    over = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 + F.col("weight") / 2) - 0.8)
    alike = edges.join(moves.select("source", "target", F.col("weight").alias("r")), ["source", "target"]).select("source", "target", (F.col("r") * over / 0.2).alias("penalty"))
    rare = 1 / np.sqrt(np.array([w for _, w in often]) + 1e-8)
    return {"rows": stored(clips), "edges": edges, "alike": alike, "rarity": rare / rare.sum(), "transition": matrix(moves), "together": matrix(g.cooccurrence_edges(rows, 3))}


@query()
def branch_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve clips, four a task, by four branches of pooled greedy choice and one round of swaps each."""
    clips = clip_tables(spark, sf)
    quotas = {r[0]: 4 for r in clips["rows"].select("task").distinct().collect()}
    found = branch_passes.best_branch(**clips, budget=sum(quotas.values()), quotas=quotas, branches=4, rounds=1)
    rows = [(int(b), float(v), k, int(node)) for b, v, chosen in found.itertuples(index=False, name=None) for k, node in enumerate(chosen, 1)]
    return rounded(spark.createDataFrame(rows, "branch long, objective double, selection_order long, node long"))


@query()
def action_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Centres of the vectors of each label, as many as its rows ask for."""
    return rounded(prototypes.fit_centres(vectors(spark, sf).select(F.col("label").cast("long").alias("action"), "vec")))
