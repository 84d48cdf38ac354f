"""The register of queries, and SQL that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Frames of episodes (see ``sources.tables``), episodes, and 15-frame candidate clips, in DuckDB's SQL.
FRAMES = """
    frames AS (
        SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, epoch_us(ts) / 1e6 AS "timestamp",
               event_type, [value, (props->>'$.k')::DOUBLE, hour(ts)::DOUBLE] AS state, [value / 10, (props->>'$.k')::DOUBLE / 100 - 0.5] AS action FROM events)"""
EPISODES = FRAMES + """,
    episodes AS (SELECT episode_id, count(*) AS length FROM frames GROUP BY episode_id)"""
CLIPS = EPISODES + """,
    clips AS (
        SELECT episode_id, start_step, start_step + 14 AS end_step, format('ep{:06d}_fragment_{:06d}_{:06d}', episode_id, start_step, start_step + 14) AS sample_id, 15 AS length
        FROM (SELECT episode_id, unnest(list_distinct(list_concat(range(0, length - 14, 15), [length - 15]))) AS start_step FROM episodes WHERE length >= 15)),
    clip_frames AS (SELECT sample_id, start_step, end_step, f.* FROM clips c JOIN frames f ON f.episode_id = c.episode_id AND f.frame_index BETWEEN start_step AND end_step)"""
LENGTHS = "lengths AS (SELECT c_custkey AS episode_id, c_custkey % 211 AS length FROM customer)"
VECTORS = "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name; ``sql``: what DuckDB must return for it."""
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles, and those in arrays, to so many places; arrays as text, one number after another."""
    out = []
    for field in df.schema:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            c = F.round(c, places)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.DoubleType):
            c = F.array_join(F.transform(c, lambda x: F.round(x * 1000, 0).cast("long").cast("string")), ",")
        out.append(c.alias(field.name))
    return df.select(*out)


def thousandths(column: str) -> str:
    """A list as ``rounded`` shows it, in DuckDB's SQL."""
    return f"array_to_string(list_transform({column}, lambda x: round(x * 1000)::BIGINT::VARCHAR), ',')"
