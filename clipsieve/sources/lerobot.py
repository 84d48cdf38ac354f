"""Reading a LeRobot v2 directory: ``meta/*.json(l)`` and one Parquet file an episode.

All frames come from one scan of ``data/chunk-*/*.parquet`` with the wanted
columns only; the rules that a dataset must keep are queries that return what
breaks them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class InvalidDataset(ValueError):
    """A dataset breaks one of its rules; the message names the rule and some rows."""


def _require(bad: DataFrame, rule: str) -> None:
    rows = bad.limit(3).collect()
    if rows:
        raise InvalidDataset(f"{rule}: {', '.join(map(str, rows))}")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON Lines file; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tasks(spark: SparkSession, root: str) -> DataFrame:
    """``task_index, task`` with both unique."""
    table = read_jsonl(spark, f"{root}/meta/tasks.jsonl", "task_index long, task string")
    for column in ("task_index", "task"):
        _require(table.groupBy(column).count().filter("count > 1"), f"repeated {column}")
    return table


def episodes(spark: SparkSession, root: str, empty_task: str = "error") -> DataFrame:
    """``episode_id, length, task_index, task_name``: exactly one known task each.

    Episodes whose task is empty are an error, or are left out (``exclude``).
    """
    listed = read_jsonl(spark, f"{root}/meta/episodes.jsonl", "episode_index long, tasks array<string>, length long")
    _require(listed.groupBy("episode_index").count().filter("count > 1"), "repeated episode")
    _require(listed.filter("length IS NULL OR length <= 0"), "episode without frames")
    _require(listed.filter("size(tasks) != 1"), "not exactly one task")
    named = listed.select(F.col("episode_index").alias("episode_id"), "length", F.col("tasks")[0].alias("task_name"))
    empty = F.trim("task_name") == ""
    if empty_task == "exclude":
        named = named.filter(~empty)
    else:
        _require(named.filter(empty), "empty task")
    known = F.broadcast(tasks(spark, root).withColumnRenamed("task", "task_name"))
    joined = named.join(known, "task_name", "left")
    _require(joined.filter("task_index IS NULL"), "unknown task")
    return joined.select("episode_id", "length", "task_index", "task_name")


def frames(spark: SparkSession, root: str, state: str = "observation.state", action: str = "action", most: int = 0) -> DataFrame:
    """``episode_id, frame_index, timestamp, task_index, state, action``; of the first ``most`` episodes only, if that is not 0."""
    rows = spark.read.parquet(f"{root}/data").select(
        F.col("episode_index").alias("episode_id"), "frame_index", "timestamp", "task_index", F.col(f"`{state}`").alias("state"), F.col(f"`{action}`").alias("action"))
    if not most:
        return rows
    first = episodes(spark, root).orderBy("episode_id").limit(most).select("episode_id")
    return rows.join(F.broadcast(first), "episode_id", "left_semi")


def subset(rows: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The listed episodes' rows; a repeated id is an error."""
    if len(set(ids)) != len(ids):
        raise ValueError("an episode is listed twice")
    return rows.filter(F.col("episode_id").isin(list(ids)))


def violations(frames_: DataFrame, episodes_: DataFrame) -> DataFrame:
    """``episode_id, rule`` for every rule that an episode's frames break.

    Rows as many as the length; time and actions finite; time not decreasing;
    frame numbers 0, 1, 2, ...; one task.
    """
    order = W.partitionBy("episode_id").orderBy("frame_index")
    finite = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = frames_.withColumns({"back": F.col("timestamp") < F.lag("timestamp").over(order), "place": F.row_number().over(order) - 1})
    seen = rows.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("back").alias("back"), F.bool_or(F.col("place") != F.col("frame_index")).alias("gap"),
        F.bool_or(~finite(F.col("action")) | ~finite(F.col("state")) | F.isnan("timestamp")).alias("odd"), F.countDistinct("task_index").alias("tasks"))
    joined = episodes_.select("episode_id", "length").join(seen, "episode_id", "full")
    rules = {"unknown_episode": F.col("length").isNull(), "wrong_length": F.coalesce(F.col("n") != F.col("length"), F.col("n").isNull()), "time_decreases": F.col("back"),
             "frames_not_contiguous": F.col("gap"), "not_finite": F.col("odd"), "several_tasks": F.col("tasks") > 1}
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    return joined.select("episode_id", F.explode(broken).alias("rule"))


def write(frames_: DataFrame, episodes_: DataFrame, tasks_: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """The same layout: frames partitioned by episode, and the two lists as JSON Lines (by ``meta``'s folders)."""
    out = frames_.select(F.col("episode_id").alias("episode_index"), "frame_index", "timestamp", "task_index", F.col("state").alias("observation.state"), "action")
    out.repartition("episode_index").sortWithinPartitions("episode_index", "frame_index").write.mode(mode).parquet(f"{root}/data")
    episodes_.select(F.col("episode_id").alias("episode_index"), F.array("task_name").alias("tasks"), "length").coalesce(1).write.mode(mode).json(f"{root}/meta/episodes.jsonl")
    tasks_.coalesce(1).write.mode(mode).json(f"{root}/meta/tasks.jsonl")
