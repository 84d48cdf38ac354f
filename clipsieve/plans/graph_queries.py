"""The clip graph and its objective. Prototypes of a clip are its commonest event types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph as g
from ..sources import tables
from ..streaming import ensemble
from .base import CLIPS, VECTORS, query, rounded
from .motion_queries import clip_frames
from .score_queries import vectors
from .window_queries import clips

_NODES = f"""WITH {CLIPS}, nodes AS (SELECT sample_id, episode_id, start_step, end_step, episode_id * 1000 + start_step AS node, 0.05 + (episode_id * 7 + start_step) % 19 / 20.0::DOUBLE AS reliability, episode_id % 3 AS task FROM clips),
    assignments AS (SELECT node, event_type AS prototype, count(*) / 15.0::DOUBLE AS weight FROM nodes JOIN clip_frames USING (sample_id) GROUP BY 1, 2)"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return clips(spark, sf).select("sample_id", "episode_id", "start_step", "end_step", (F.col("episode_id") * 1000 + F.col("start_step")).alias("node"),
                                   (0.05 + (F.col("episode_id") * 7 + F.col("start_step")) % 19 / 20.0).alias("reliability"), (F.col("episode_id") % 3).alias("task"))


def assignments(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).select("sample_id", "node").join(clip_frames(spark, sf), "sample_id").groupBy("node", F.col("event_type").alias("prototype")).agg((F.count(F.lit(1)) / 15.0).alias("weight"))


_SEQUENCE = """, sequence AS (SELECT a.node AS source, b.node AS target, least(a.reliability, b.reliability) AS weight FROM nodes a JOIN nodes b ON a.episode_id = b.episode_id AND b.start_step = a.end_step + 1)"""


@query(_NODES + _SEQUENCE + " SELECT source, target, round(weight, 6) AS weight, 'sequence' AS edge_type FROM sequence")
def sequence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.sequence_edges(nodes(spark, sf)))


@query(_NODES + """, o AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_step) AS at FROM nodes)
    SELECT a.node AS source, b.node AS target, round(least(a.reliability, b.reliability), 6) AS weight, 'sequence' AS edge_type FROM o a JOIN o b ON a.episode_id = b.episode_id AND b.at = a.at + 1""")
def ordered_sequence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.sequence_edges(nodes(spark, sf), contiguous=False))


@query(_NODES + """, o AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_step) AS place FROM nodes)
    SELECT a.node AS source, b.node AS target, round(a.reliability * b.reliability, 6) AS weight, 'cooccurrence' AS edge_type FROM o a JOIN o b ON a.episode_id = b.episode_id AND b.place BETWEEN a.place + 2 AND a.place + 3""")
def cooccurrence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.cooccurrence_edges(nodes(spark, sf), 3))


@query(f"""WITH {VECTORS}, k AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.vec, b.vec) AS c FROM vectors a JOIN vectors b ON a.id != b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY c DESC, b.id) <= 5)
    SELECT least(id, other) AS source, greatest(id, other) AS target, round(max(least(greatest(c, 0), 1)), 6) AS weight, 'similarity' AS edge_type FROM k WHERE c >= 0.3 GROUP BY 1, 2""")
def cosine_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.similarity_edges(vectors(spark, sf).select("id", "vec"), 5, 0.3))


@query(_NODES + _SEQUENCE + """, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k FROM nodes WHERE reliability >= 0.3)
    SELECT a.k AS source, b.k AS target, round(weight, 6) AS weight FROM sequence JOIN n a ON a.node = source JOIN n b ON b.node = target""")
def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    rows = nodes(spark, sf)
    return rounded(g.induced(g.sequence_edges(rows), rows.filter("reliability >= 0.3")))


def _matrix(edges: str, name: str) -> str:
    return f"""{name} AS (SELECT p, q, v / sum(v) OVER () AS value FROM (SELECT a.prototype AS p, b.prototype AS q, sum(s.r * a.weight * b.weight) AS v FROM {edges} s JOIN assignments a ON a.node = source JOIN assignments b ON b.node = target GROUP BY 1, 2))"""


_MATRIX = _SEQUENCE + """, moves AS (SELECT source, target, a.reliability * b.reliability AS r FROM sequence JOIN nodes a ON a.node = source JOIN nodes b ON b.node = target),
    o AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_step) AS place FROM nodes),
    together AS (SELECT a.node AS source, b.node AS target, a.reliability * b.reliability AS r FROM o a JOIN o b ON a.episode_id = b.episode_id AND b.place BETWEEN a.place + 2 AND a.place + 3),
    """ + _matrix("moves", "matrix") + ", " + _matrix("together", "comatrix")


@query(_NODES + _MATRIX + " SELECT p, q, round(value, 6) AS value FROM matrix")
def prototype_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.prototype_matrix(g.sequence_edges(nodes(spark, sf), product=True), assignments(spark, sf)))


@query(_NODES + _MATRIX + " SELECT p, q, round(value, 6) AS value FROM comatrix")
def cooccurrence_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.prototype_matrix(g.cooccurrence_edges(nodes(spark, sf), 3), assignments(spark, sf)))


_MASS = ", masses AS (SELECT a.prototype, a.node, weight * reliability AS m FROM assignments a JOIN nodes USING (node))"


@query(_NODES + _MASS + " SELECT prototype, round(max(m), 6) AS mass FROM masses GROUP BY prototype")
def prototype_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.prototype_coverage(assignments(spark, sf), nodes(spark, sf)))


@query(_NODES + _MASS + " SELECT DISTINCT node FROM (SELECT node FROM masses QUALIFY row_number() OVER (PARTITION BY prototype ORDER BY m DESC, node) = 1)")
def max_coverage_seed(spark: SparkSession, sf: str) -> DataFrame:
    return g.coverage_seed(assignments(spark, sf), nodes(spark, sf))


_COUNTED = """, counted AS (SELECT a.prototype AS p, b.prototype AS q, sum(a.m * b.m) AS whole, coalesce(sum(a.m * b.m) FILTER (source % 5 < 2 AND target % 5 < 2), 0) AS part
    FROM sequence JOIN masses a ON a.node = source JOIN masses b ON b.node = target GROUP BY 1, 2)"""


@query(_NODES + _SEQUENCE + _MASS + _COUNTED + " SELECT p, q, round(whole, 6) AS count FROM counted")
def sequence_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = nodes(spark, sf)
    return rounded(g.sequence_counts(g.sequence_edges(rows), assignments(spark, sf), rows))


@query(_NODES + _MATRIX + _MASS + _COUNTED + """, chosen AS (SELECT * FROM nodes WHERE node % 5 < 2),
    cover AS (SELECT prototype, max(m) AS m FROM masses JOIN chosen USING (node) GROUP BY prototype),
    rare AS (SELECT prototype, r / sum(r) OVER () AS r FROM (SELECT prototype, 1 / sqrt(sum(weight) + 1e-8) AS r FROM assignments GROUP BY prototype)),
    alike AS (SELECT source, target, least(1, 0.7 + weight / 2) AS w FROM sequence),
    penalties AS (SELECT sum(p) AS whole, coalesce(sum(p) FILTER (source % 5 < 2 AND target % 5 < 2), 0) AS part FROM (SELECT source, target, a.reliability * b.reliability * greatest(w - 0.8, 0) / 0.2 AS p FROM alike JOIN nodes a ON a.node = source JOIN nodes b ON b.node = target)),
    parts AS (SELECT (SELECT sum(m * r) FROM cover JOIN rare USING (prototype)) AS n, (SELECT sum(value * sqrt(a.m * b.m)) FROM matrix JOIN cover a ON a.prototype = p JOIN cover b ON b.prototype = q) AS t,
        (SELECT sum(value * sqrt(a.m * b.m)) FROM comatrix JOIN cover a ON a.prototype = p JOIN cover b ON b.prototype = q) AS c,
        (SELECT sum(value * ln(1 + part) / (ln(1 + whole) + 1e-8)) FROM matrix JOIN counted USING (p, q)) AS s, (SELECT part / greatest(whole, 1e-8) FROM penalties) AS r)
    SELECT round(n, 6) AS node_value, round(t, 6) AS transition_value, round(c, 6) AS cooccurrence_value, round(s, 6) AS sequence_value, round(r, 6) AS redundancy,
        round(4 * n + 1.2 * t + 0.5 * c + 2 * s - 2 * r, 6) AS objective FROM parts""")
def objective_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    rows, given = nodes(spark, sf), assignments(spark, sf)
    edges = g.sequence_edges(rows)
    similar = edges.select("source", "target", F.least(F.lit(1.0), 0.7 + F.col("weight") / 2).alias("weight"))
    transition = g.prototype_matrix(g.sequence_edges(rows, product=True), given)
    together = g.prototype_matrix(g.cooccurrence_edges(rows, 3), given)
    return rounded(g.objective(rows.filter("node % 5 < 2"), rows, given, transition, together, edges, similar))


@query(_NODES + " SELECT node, count(*) AS prototypes, round(sum(weight), 6) AS total FROM assignments GROUP BY node")
def clip_assignments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assignments(spark, sf).groupBy("node").agg(F.count(F.lit(1)).alias("prototypes"), F.sum("weight").alias("total")))


@query("""WITH f AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    SELECT user_id AS episode_id, min(i) FILTER (event_type = 'error') - 1 AS first_step FROM f GROUP BY user_id""")
def first_success_step(spark: SparkSession, sf: str) -> DataFrame:
    return tables.frames(spark, sf).groupBy("episode_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("frame_index"))).alias("first_step"))


@query("""WITH f AS (SELECT user_id, value / 10 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT t.user_id AS episode_id, t.i AS frame_index, round(sum(f.a * exp(-0.1 * (f.i - t.i + 3))) / sum(exp(-0.1 * (f.i - t.i + 3))), 6) AS ensembled FROM f t JOIN f ON f.user_id = t.user_id AND f.i BETWEEN t.i - 3 AND t.i GROUP BY 1, 2""")
def temporal_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """The last four values with weights falling from the oldest on."""
    order = W.partitionBy("episode_id").orderBy("frame_index")
    past = [F.lag(F.col("action")[0], k).over(order) if k else F.col("action")[0] for k in range(4)]
    weights = [F.exp(F.lit(-0.1 * (3 - k))) for k in range(4)]
    total = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in zip(past, weights, strict=True)), F.lit(0.0))
    norm = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in zip(past, weights, strict=True)), F.lit(0.0))
    return rounded(tables.frames(spark, sf).select("episode_id", "frame_index", (total / norm).alias("ensembled")))


@query("""WITH f AS (SELECT user_id, value / 10 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT t.user_id AS episode_id, t.i AS frame_index, round(sum((f.a - (t.i - f.i)) * exp(-0.2 * (f.i - greatest(t.i - 3, 0)))) / sum(exp(-0.2 * (f.i - greatest(t.i - 3, 0)))), 6) AS ensembled FROM f t JOIN f ON f.user_id = t.user_id AND f.i BETWEEN t.i - 3 AND t.i GROUP BY 1, 2""")
def aligned_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of four that fall by one a step from a frame's action: what the last four predict for the present frame."""
    chunk = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array(F.col("action")[0] - k))
    rows = tables.frames(spark, sf).select("episode_id", "frame_index", chunk.alias("chunk"))
    return rounded(ensemble.aligned_chunks(rows, 1, 4, 0.2).select("episode_id", "frame_index", F.col("ensembled")[0].alias("ensembled")))
