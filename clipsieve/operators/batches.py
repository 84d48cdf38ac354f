"""Epochs of frames for several ranks: episodes dealt in turn, and whole batches of equal number for every rank.

Orders come from a hash of seed, epoch and id, so an epoch is a declarative plan that
can be recomputed from any batch on; it is not the reference's random stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import numbered


def _hash(seed: int, epoch: int, *parts: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(p).cast("string") for p in parts]))


def _dealt(episodes: DataFrame, ranks: int, seed: int, epoch: int) -> DataFrame:
    """Adds ``turn`` (place in the epoch's order, from 0) and ``rank``."""
    if ranks < 1:
        raise ValueError("there must be a rank")
    rows = numbered(episodes.select("episode_id", "length"), _hash(seed, epoch, "episode_id"), F.col("episode_id"))
    return rows.select("episode_id", "length", (F.col("place") - 1).alias("turn"), ((F.col("place") - 1) % ranks).alias("rank"))


def _whole(dealt: DataFrame, ranks: int, size: int) -> DataFrame:
    """One row, ``batches``: as many whole batches as the rank with the fewest frames has (none, if a rank has no episode)."""
    sums = dealt.groupBy("rank").agg(F.sum("length").alias("frames"))
    return sums.agg(F.when(F.count(F.lit(1)) == ranks, F.floor(F.min("frames") / size)).otherwise(0).cast("long").alias("batches"))


def epoch_batches(episodes: DataFrame, ranks: int, size: int, seed: int, epoch: int) -> DataFrame:
    """``rank, episodes, frames, batches`` of an epoch of ``episode_id, length`` rows."""
    dealt = _dealt(episodes, ranks, seed, epoch)
    sums = dealt.groupBy("rank").agg(F.count(F.lit(1)).alias("episodes"), F.sum("length").cast("long").alias("frames"))
    return sums.crossJoin(F.broadcast(_whole(dealt, ranks, size)))  # one row


def epoch_frames(episodes: DataFrame, ranks: int, size: int, seed: int, epoch: int) -> DataFrame:
    """``rank, batch, slot, episode_id, frame_index``: each rank's frames by episode in turn and in hashed order within it, cut to whole batches.

    A frame's place is the sum of the rank's earlier episodes, made over episodes
    alone and in parts, plus its rank within its own episode; no task holds a rank's frames.
    """
    dealt = _dealt(episodes, ranks, seed, epoch)
    cut = 1024  # consecutive turns of a rank that are summed together
    part = F.floor(F.col("turn") / (cut * ranks))
    sums = dealt.groupBy("rank", part.alias("part")).agg(F.sum("length").alias("size"))
    earlier = sums.select("rank", "part", (F.sum("size").over(W.partitionBy("rank").orderBy("part")) - F.col("size")).alias("earlier"))
    inner = F.sum("length").over(W.partitionBy("rank", "part").orderBy("turn")) - F.col("length")
    begun = dealt.withColumn("part", part).withColumn("inner", inner).join(earlier, ["rank", "part"])
    frames = begun.crossJoin(F.broadcast(_whole(dealt, ranks, size))).filter(F.col("earlier") + F.col("inner") < F.col("batches") * size).select(
        "rank", "episode_id", (F.col("earlier") + F.col("inner")).alias("begin"), "batches", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1)).alias("frame_index"))
    own = F.row_number().over(W.partitionBy("episode_id").orderBy(_hash(seed, epoch, "episode_id", "frame_index"), "frame_index")) - 1
    placed = frames.withColumn("at", F.col("begin") + own).filter(F.col("at") < F.col("batches") * size)
    return placed.select("rank", F.floor(F.col("at") / size).alias("batch"), (F.col("at") % size).alias("slot"), "episode_id", "frame_index")
