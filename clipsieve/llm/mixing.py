"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh_name, join_by_size

#: Hex digits of a key that name its range; 16 ** RANGE_DIGITS ranges a source.
RANGE_DIGITS = 3
#: Up to so many sources (one short row each) are sent to all executors.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.size(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))
                      - F.when(F.regexp_like(text, F.lit(WORD)), 0).otherwise(1), F.lit(0)).cast("long")


def random_key(id_: Column, text: Column) -> Column:
    """A uniform key, hex, that depends on nothing but the row's id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def _source_weights(sizes: DataFrame, scratch: Scratch, weights: Sequence[float]) -> DataFrame:
    """Adds ``weight``: the given ones in turn, by the source's place in code point order, null last.

    The place comes from a range partitioning: the rank within the partition
    plus the number of sources in those before it.
    """
    order = F.col("source").asc_nulls_last()
    ranges = scratch.write(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = ranges.groupBy("part").count().withColumn(
        "before", F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    place = F.row_number().over(W.partitionBy("part").orderBy(order)) + F.coalesce("before", F.lit(0)) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return ranges.join(before, "part").select("source", "source_size", "documents", turn.alias("weight"))


def source_targets(rows: DataFrame, scratch: Scratch, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """``source, source_size, weight, target`` for ``source, size`` rows.

    Targets share ``share`` of all sizes by weight, none above ``epochs`` times
    its source's size; what is above is reshared by weight. The water level
    (target a unit of weight) is found by repeated sums over one row a source;
    it only rises, and each round caps one source more at least.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    table = scratch.write(_source_weights(sizes, scratch, weights), "weights")
    cap = F.col("source_size") * F.lit(float(epochs))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while level != before:
        full = cap <= F.lit(level) * F.col("weight")
        capped, free = table.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        before, level = level, ((share * total - capped) / free if free else float("inf"))
    return table.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")) if level < float("inf") else cap)


def source_cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each source's budget ends in key order.

    ``rows``: ``source, key, size``. Returns one row a source: ``source,
    source_size, target, rounds`` (whole passes), ``cut_key`` and ``cut_words``
    (the row at which the last pass ends, and its words taken; null if there
    is none). Keys are uniform, so each of a source's 4096 key ranges holds its
    part of even the largest source; ranges are summed in place, prefix sums over
    ranges find the one with the cut, and only that one is sorted.
    """
    range_ = F.substring("key", 1, RANGE_DIGITS)
    sums = rows.groupBy("source", range_.alias("range")).agg(F.sum("size").alias("words"))
    sums = sums.withColumn("until", F.sum("words").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, 0)))
    budget = F.floor("target").cast("long")
    plan = targets.withColumns({
        "rounds": F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)),
        "rest": F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(F.lit(0)),
    })
    same = sums["source"].eqNullSafe(plan["source"])
    where = sums.join(plan.filter("rest > 0"), same).filter("until - words < rest AND until >= rest").select(
        sums["source"].alias("s"), "range", (F.col("rest") - (F.col("until") - F.col("words"))).alias("rest"))
    inside = rows.join(where, F.col("source").eqNullSafe(F.col("s")) & (range_ == F.col("range")))
    keys = inside.groupBy("source", "range", "rest", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("copies"))
    ends = keys.withColumn("until", F.sum("words").over(W.partitionBy("source", "range").orderBy("key").rowsBetween(W.unboundedPreceding, 0)))
    cut = ends.filter("until - words < rest AND until >= rest").select(
        F.col("source").alias("s"), F.col("key").alias("cut_key"), F.expr("(rest - (until - words)) div copies").alias("cut_words"))
    return plan.join(cut, plan["source"].eqNullSafe(cut["s"]), "left").select("source", "source_size", "target", "documents", "rounds", "cut_key", "cut_words")


def _with_cut(rows: DataFrame, cuts: DataFrame, source: Column, name: str) -> DataFrame:
    """``rows`` with their source's row of ``cuts`` as the struct ``name``: by broadcast, or if there are too many sources only the large ones so."""
    named = lambda c: F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c))
    key, size = fresh_name(rows, "of"), fresh_name(rows, "m")
    table = cuts.select(named(F.col("source")).alias(key), F.struct(*cuts.columns).alias(name), F.col("documents").alias(size))
    rows = rows.withColumn(key, named(source))
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return (rows.join(F.broadcast(table), key) if few else join_by_size(rows, table, [key], size)).drop(key, size)


def with_taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (``source, key, size`` and more) with ``source_size, target, taken``."""
    joined = _with_cut(rows, cuts, F.col("source"), "cut").select("*", "cut.source_size", "cut.target", "cut.rounds", "cut.cut_key", "cut.cut_words")
    last = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.col("cut_words")).otherwise(0)
    return joined.withColumn("taken", (F.col("rounds") * F.col("size") + last).cast("long")).drop("cut", "rounds", "cut_key", "cut_words")


def mix(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes.

    Returns ``id_col, source, size, source_size, target, taken`` for every row.
    Documents are passed in the order of a hash of id and text, whole passes
    first; the last pass ends within the document at which the source's target
    (rounded down) is reached, so a source's ``taken`` sum to it exactly. Null
    texts have size 0 and are taken with 0 words; null sources are a source of
    their own; a source without words has target 0. Rows that repeat both id and
    text share a key; if the budget ends at them, each gives the same number of
    words (rounded down). An empty table gives no rows. Columns besides the three
    named are not read. Text is read once; keys and sizes are written.
    """
    rows = scratch.write(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        random_key(F.col(id_col), F.col(text_col)).alias("key"), word_count(F.col(text_col)).alias("size"),
    ), "rows")
    cuts = scratch.write(source_cuts(rows, source_targets(rows, scratch, weights, share, epochs)), "cuts")
    return with_taken(rows, cuts).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0,
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass over a document.

    Whole passes give the row as it is; a pass that ends within a document gives
    its first words, as far as they are taken. Documents of which nothing is
    taken (by budget, or because they have no words) are left out. Texts are not
    shuffled: each row finds its source's cut by a join with one row a source.
    """
    rows = scratch.write(docs.select(
        F.col(source_col).cast("string").alias("source"), random_key(F.col(id_col), F.col(text_col)).alias("key"),
        word_count(F.col(text_col)).alias("size")), "rows")
    cuts = scratch.write(source_cuts(rows, source_targets(rows, scratch, weights, share, epochs)), "cuts")
    struct = fresh_name(docs, "cut")
    joined = _with_cut(docs, cuts, F.col(source_col).cast("string"), struct)
    key, size = random_key(F.col(id_col), F.col(text_col)), word_count(F.col(text_col))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col(f"{struct}.cut_words").cast("int")), "")
    at = F.col(f"{struct}.cut_key")
    texts = F.array_repeat(F.col(text_col), F.col(f"{struct}.rounds").cast("int"))
    last = F.when(key < at, F.array(F.col(text_col))).when((key == at) & (F.col(f"{struct}.cut_words") > 0), F.array(cut)).otherwise(F.array().cast("array<string>"))
    taken = F.when(size > 0, F.concat(texts, last)).otherwise(F.array().cast("array<string>"))
    piece = fresh_name(docs, "piece")
    return joined.select(*docs.columns, F.explode(taken).alias(piece)).withColumn(text_col, F.col(piece)).select(*docs.columns)
