"""Global order without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts into which an order is cut, and rows (by a hash) that the cuts come from.
PARTS, SAMPLE = 64, 2048


def _part(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Adds ``part_``: the place of ``key`` (a struct) among cuts that a bounded sample gives."""
    some = sorted(tuple(r[0]) for r in rows.select(key.alias("key")).orderBy(F.xxhash64("key")).limit(SAMPLE).collect())
    cuts = sorted({some[len(some) * n // PARTS] for n in range(1, PARTS)}) if some else []
    if not cuts:
        return rows.withColumns({name: key, "part_": F.lit(0)})
    every = F.array(*[F.struct(*[F.lit(v).alias(f"k{n}") for n, v in enumerate(cut)]) for cut in cuts])
    return rows.withColumns({name: key, "part_": F.size(F.filter(every, lambda cut: cut <= key))})


def quantiles(rows: DataFrame, column: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by, q0, q1, ...``: exact quantiles, linearly interpolated, of all values that are not null.

    Equal values are counted first, so common values are one row; distinct ones
    are dealt to parts in order, and running counts within a part plus the sums
    of those before it find the two values beside each quantile. No task holds all
    values, however many there are. Without ``by`` there is one row, of nulls if there are no values.
    """
    counts = rows.select(*by, F.col(column).cast("double").alias("x_")).filter("x_ IS NOT NULL").groupBy(*by, "x_").agg(F.count(F.lit(1)).alias("n_"))
    dealt = _part(counts, F.struct(F.col("x_").alias("k0")), "key_")
    sums = dealt.groupBy(*by, "part_").agg(F.sum("n_").alias("size_"))
    whole = W.partitionBy(*by)
    before = sums.select(*by, "part_", (F.sum("size_").over(whole.orderBy("part_")) - F.col("size_")).alias("before_"), F.sum("size_").over(whole).alias("all_"))
    until = F.sum("n_").over(W.partitionBy(*by, "part_").orderBy("x_")) + F.col("before_")
    placed = dealt.join(F.broadcast(before), [*by, "part_"]).withColumn("until_", until)
    place = [F.lit(float(p)) * (F.col("all_") - 1) for p in at]
    beside = [F.min(F.when(F.col("until_") > f(c), F.col("x_"))).alias(f"{n}{k}_") for k, c in enumerate(place) for n, f in (("low", F.floor), ("high", F.ceil))]
    found = placed.groupBy(*by).agg(F.max("all_").alias("all_"), *beside)
    return found.select(*by, *[(F.col(f"low{k}_") + (F.col(f"high{k}_") - F.col(f"low{k}_")) * (c - F.floor(c))).alias(f"q{k}") for k, c in enumerate(place)])


def numbered(rows: DataFrame, *keys: Column, by: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Adds ``name``: each row's place, from 1, by ``keys`` (ascending, not null, together unique), within equal values of ``by`` if it is given.

    Cuts through the keys, from a bounded sample, deal the rows to parts in
    order; a place is the rank within a part plus the sizes of those before it, so
    the largest task has a small share of the rows, whatever ties or large groups
    there are. Only the parts' sizes meet in one window.
    """
    key = F.struct(*[k.alias(f"k{n}") for n, k in enumerate(keys)])
    dealt = _part(rows, key, "key_")
    sizes = dealt.groupBy(*by, "part_").agg(F.count(F.lit(1)).alias("size_"))
    before = sizes.withColumn("before_", F.sum("size_").over(W.partitionBy(*by).orderBy("part_")) - F.col("size_")).select(*by, "part_", "before_")
    placed = dealt.withColumn("rank_", F.row_number().over(W.partitionBy(*by, "part_").orderBy("key_")))
    return placed.join(before, [*by, "part_"]).withColumn(name, (F.col("rank_") + F.col("before_")).cast("long")).drop("key_", "part_", "rank_", "before_")
