"""Exact dedup against a persistent digest index (DataFrame operations only).

The index is a Parquet table bucketed and sorted by the SHA-256 digest of the
normalised text. New rows are dealt in batches of falling ids; a batch is reduced
to one row per digest (partial aggregation comes before the shuffle, so copies
cost nothing), anti-joined by sort-merge with the index, whose buckets need no
shuffle, and what is new is appended. Every row then takes its digest's entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, join_by_size

#: Batches in which new rows meet the index.
BATCHES = 2


class DigestIndex:
    """Digests seen so far: ``digest BINARY, keep_id LONG, batch STRING``.

    Bucketed by digest; each append adds at most one sorted file per bucket, and
    ``compact`` merges them. A table is known by its location, so that another
    session can open it again.
    """

    SCHEMA = T.StructType([
        T.StructField("digest", T.BinaryType()), T.StructField("keep_id", T.LongType()), T.StructField("batch", T.StringType()),
    ])

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark, self.location, self.buckets = spark, location, buckets
        self.table = "digests_" + hashlib.sha256(location.encode()).hexdigest()[:16]
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
            )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """Adds ``digest, keep_id, batch`` rows, one file per bucket."""
        (
            rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.location).saveAsTable(self.table)
        )

    def forget(self) -> None:
        """Takes the table out of the session's catalogue; its files stay, and a later session opens them by location."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def compact(self, to: str) -> DigestIndex:
        """The same index at a new location with one file per bucket."""
        merged = DigestIndex(self.spark, to, self.buckets)
        merged.append(self.read())
        return merged


def exact_dedup(
    docs: DataFrame,
    index: DigestIndex,
    scratch: Scratch,
    batch: str = "0",
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    tie_cols: Sequence[str] = (),
    batches: int = BATCHES,
) -> DataFrame:
    """One row per row of ``docs`` (dropped ones too), and the index extended.

    Returns ``id_col, keep_id, group_size, kept, text_sha256``. ``docs`` meet the
    index in ``batches`` ranges of ids, the largest ids first, so of equal texts
    the row with the largest id is indexed and stays; a text that the index has
    from an earlier call keeps the id it has there, and no row of this call
    stays. ``group_size`` counts the rows of this call. ``batch`` names the call:
    one that is repeated with the same rows (after a lost driver, say) finds its
    own entries, appends nothing twice and gives the same result. Null text counts
    as empty; empty texts are equal to each other. Null ids are smaller than all
    others; rows that repeat an id with the same text are all kept or all dropped,
    unless ``tie_cols`` (passed through) tell them apart. An empty table gives no
    rows. Other columns of ``docs`` are not read, so their names don't matter.

    The rows' digests are written once (40 bytes a row) so texts are read once.
    Common digests take their entry by broadcast (see ``join_by_size``), the rest
    by sort-merge join, so no task gets more than a small share of the rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.write(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(normalise(text) if normalise else text, 256)).alias("digest"),
            *(F.col(c).alias(f"tie{k}") for k, c in enumerate(tie_cols)),
        ),
        "digests",
    )
    ties = [f"tie{k}" for k in range(len(tie_cols))]
    tops = rows.groupBy("digest").agg(F.max(F.struct("id", *ties)).alias("top"), F.count(F.lit(1)).alias("group_size"))
    tops = scratch.write(tops, "groups")
    for part in _falling(rows, batches):
        new = part.groupBy("digest").agg(F.max("id").alias("keep_id"))
        fresh = new.join(index.read().select("digest").hint("merge"), "digest", "left_anti")
        index.append(scratch.write(fresh.withColumn("batch", F.lit(batch)), "fresh"))
    entries = index.read().select("digest", "keep_id", (F.col("batch") == batch).alias("own"))
    groups = scratch.write(tops.join(entries.hint("merge"), "digest"), "entries")
    out = join_by_size(rows, groups, ["digest"], "group_size")
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.struct("id", *ties).eqNullSafe(F.col("top")) & F.col("own")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), *(F.col(t).alias(c) for t, c in zip(ties, tie_cols, strict=True)),
    )


def _falling(rows: DataFrame, batches: int) -> list[DataFrame]:
    """``rows`` in ranges of ``id`` of about even size, the largest ids first and null ids in the last."""
    cuts = sorted(set(rows.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []), reverse=True) if batches > 1 else []
    if not cuts:
        return [rows]
    inner = [rows.filter((F.col("id") <= high) & (F.col("id") > low)) for high, low in zip(cuts, cuts[1:])]
    return [rows.filter(F.col("id") > cuts[0]), *inner, rows.filter((F.col("id") <= cuts[-1]) | F.col("id").isNull())]
