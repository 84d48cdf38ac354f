"""Action ensembling over a stream: the last few actions of each episode, weighted by age, with state kept by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUTPUT = "episode_id long, frame_index long, ensembled double"
STATE = "values array<double>"


def ensemble(stream: DataFrame, size: int = 4, decay: float = 0.1) -> DataFrame:
    """``episode_id, frame_index, ensembled`` for ``episode_id, frame_index, value`` rows of a stream.

    Weights are exp(-decay * k), the oldest kept value first. Rows of an episode
    within one micro-batch are taken in frame order; later batches must not go back.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("frame_index")
        out = []
        for frame, value in zip(rows["frame_index"], rows["value"], strict=True):
            kept = [*kept, float(value)][-size:]
            weights = np.exp(-decay * np.arange(size - len(kept), size))
            out.append((key[0], frame, float(np.dot(weights, kept) / weights.sum())))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["episode_id", "frame_index", "ensembled"])

    return stream.groupBy("episode_id").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")


CHUNK_INPUT = "episode_id long, frame_index long, chunk array<array<double>>"
CHUNK_OUTPUT = "episode_id long, frame_index long, ensembled array<double>"
CHUNK_STATE = "chunks array<array<array<double>>>"


def chunk_ensemble(stream: DataFrame, horizon: int = 4, temperature: float = 0.0) -> DataFrame:
    """``episode_id, frame_index, ensembled`` for ``episode_id, frame_index, chunk`` rows, ``chunk`` being the ``horizon`` actions predicted from that frame on.

    The present action is the mean of what the last ``horizon`` chunks predicted
    for this frame, weighted exp(-temperature * k) with the oldest chunk first. As in ``ensemble``,
    frames of an episode are taken in order within a micro-batch; state is ``horizon`` chunks an episode.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = [np.array([list(a) for a in c], float) for c in state.get[0]] if state.exists else []
        rows = pd.concat(list(frames)).sort_values("frame_index")
        out = []
        for frame, chunk in zip(rows["frame_index"], rows["chunk"], strict=True):
            actions = np.array([list(a) for a in chunk], float)
            if len(actions) != horizon or not np.isfinite(actions).all():
                raise ValueError(f"a chunk must have {horizon} finite actions")
            kept = [*kept, actions][-horizon:]
            weights = np.exp(-temperature * np.arange(len(kept)))
            present = np.array([c[len(kept) - 1 - k] for k, c in enumerate(kept)])
            out.append((key[0], frame, (weights / weights.sum()) @ present))
        state.update(([c.tolist() for c in kept],))
        yield pd.DataFrame(out, columns=["episode_id", "frame_index", "ensembled"])

    return stream.groupBy("episode_id").applyInPandasWithState(step, CHUNK_OUTPUT, CHUNK_STATE, "append", "NoTimeout")


def aligned_chunks(frames: DataFrame, size: int, horizon: int = 4, temperature: float = 0.0) -> DataFrame:
    """``chunk_ensemble`` of a finished table whose actions have ``size`` numbers: lags of one window, all in built-in functions."""
    order = W.partitionBy("episode_id").orderBy("frame_index")
    before = F.least(F.row_number().over(order), F.lit(horizon)) - 1
    past = [F.get(F.lag("chunk", k).over(order), F.lit(k)) for k in range(horizon)]
    rows = frames.select("episode_id", "frame_index", before.alias("before"), F.array(*past).alias("past"))
    weight = lambda k: F.exp(F.lit(-temperature) * (F.col("before") - k))
    total = F.aggregate(F.sequence(F.lit(0), F.col("before")), F.lit(0.0), lambda a, k: a + weight(k))

    def mean(dim: int) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.col("before")), F.lit(0.0), lambda a, k: a + weight(k) * F.get(F.get(F.col("past"), k), F.lit(dim))) / total

    return rows.select("episode_id", "frame_index", F.array(*[mean(d) for d in range(size)]).alias("ensembled"))
