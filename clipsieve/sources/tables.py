"""Episodes and frames from the driver's ``events`` and ``customer`` tables.

A user's events are an episode: frames ordered by time, ``state`` = value, k
(from ``props``) and hour of day, ``action`` = value / 10 and k / 100 - 0.5.
``time10`` is a regular clock (ten frames a second) for metrics that need one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``episode_id, frame_index, timestamp, time10, event_type, state, action``."""
    events = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("double")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("episode_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_index"),
        (F.unix_micros(at) / 1e6).alias("timestamp"), "event_type",
        F.array(F.col("value"), k, F.hour(at).cast("double")).alias("state"), F.array(F.col("value") / 10, k / 100 - 0.5).alias("action"),
    ).withColumn("time10", F.col("frame_index") / 10)


def episodes(frames_: DataFrame) -> DataFrame:
    """``episode_id, length, task_name``: the task is the commonest event type, ties to the first by name."""
    counts = frames_.groupBy("episode_id", "event_type").count()
    task = F.min_by("event_type", F.struct(-F.col("count"), F.col("event_type")))
    return counts.groupBy("episode_id").agg(F.sum("count").alias("length"), task.alias("task_name"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``episode_id, length`` with lengths from 0 to 210, one episode a customer."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode_id"), (F.col("c_custkey") % 211).alias("length"))
