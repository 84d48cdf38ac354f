"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_by_size


def _stars(links: DataFrame, larger: bool, scratch: Scratch, name: str) -> DataFrame:
    """Each node's neighbours are linked to its least neighbour instead (larger ones only, or smaller ones and itself).

    A node with a large share of all links is met by broadcast (``join_by_size``), not in one task.
    """
    if larger:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), name)
        return join_by_size(both, least, ["a"], "n").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
    least = scratch.write(links.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")), name)
    return join_by_size(links, least, ["b"], "n").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``node, root`` for every node with a link; the root is the component's least node.

    ``links``: ``a LONG, b LONG``, in either direction, repeats and loops
    allowed. Rounds end when the links no longer change; each is written to the
    shared folder, so lineage stays short and nothing comes to the driver but a
    count and a checksum.
    """
    now = scratch.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), f"{name}0")
    seen, k = None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, k = mark, k + 1
        large = scratch.write(_stars(now, True, scratch, f"{name}_least_large"), f"{name}_large")
        now = scratch.write(_stars(large, False, scratch, f"{name}_least_small"), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}", f"{name}_large", f"{name}_least_large", f"{name}_least_small")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
