"""Strict scans of score tables, rankings and chosen fragments, and their writers.

A scan reads with a given schema and checks whole tables by aggregates and anti
joins; a table that breaks a rule is an error which says how many rows do.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import numbered

#: Columns of a score table, besides those of a method.
SCORES = ("sample_id", "length", "quality", "coverage", "diversity", "novelty")


class SourceError(ValueError):
    """A table breaks a rule of its format."""


def check(rows: DataFrame, **rules: Column) -> DataFrame:
    """``rows``, if no row fulfils any of the ``rules`` (each says what is wrong with a row)."""
    found = rows.agg(F.count(F.lit(1)).alias("n_"), *[F.coalesce(F.sum(rule.cast("int")), F.lit(0)).alias(name) for name, rule in rules.items()]).first()
    if not found["n_"]:
        raise SourceError("the table is empty")
    if wrong := {name: found[name] for name in rules if found[name]}:
        raise SourceError(", ".join(f"{name}: {n} rows" for name, n in wrong.items()))
    return rows


def unique(rows: DataFrame, *keys: str) -> DataFrame:
    if twice := rows.groupBy(*keys).count().filter("count > 1").count():
        raise SourceError(f"{twice} values of {', '.join(keys)} are repeated")
    return rows


def read_scores(spark: SparkSession, path: str, score: str, required: Sequence[str] = SCORES, forbidden: Sequence[str] = ()) -> DataFrame:
    """A CSV of scores with a header: ``required`` columns and ``score``, all columns as text but the score, which is a double in [0, 1]; ids are unique and not blank."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if missing := sorted({*required, score} - set(rows.columns)):
        raise SourceError(f"columns are missing: {missing}")
    if there := sorted(set(forbidden) & set(rows.columns)):
        raise SourceError(f"columns are already there: {there}")
    value = F.expr(f"try_cast(`{score}` AS DOUBLE)")
    bad = F.coalesce(value.isNull() | F.isnan(value) | (value < 0) | (value > 1), F.lit(True))
    check(rows, blank_ids=F.coalesce(F.trim("sample_id") == "", F.lit(True)), bad_scores=bad)
    return unique(rows.withColumns({"sample_id": F.trim("sample_id"), score: value}), "sample_id")


def read_ranking(spark: SparkSession, path: str, score: str, place: str = "place") -> DataFrame:
    """A CSV ranking: places 1 to n, each once, by falling score, equal scores by length and id."""
    rows = read_scores(spark, path, score, ("sample_id", "length", place)).withColumns({place: F.expr(f"try_cast(`{place}` AS BIGINT)"), "length": F.expr("try_cast(length AS BIGINT)")})
    want = numbered(rows.filter(F.col("length").isNotNull()), -F.col(score), F.col("length"), F.col("sample_id"), name="want_")
    check(want, wrong_places=~F.col(place).eqNullSafe(F.col("want_")))
    if rows.filter("length IS NULL").limit(1).count():
        raise SourceError("a length is no number")
    return rows


_FRAGMENT = T.StructType([T.StructField(c, T.LongType()) for c in ("episode_id", "start_step", "end_step")])


def read_fragments(spark: SparkSession, path: str, episodes: DataFrame) -> DataFrame:
    """JSON lines of ``episode_id, start_step, end_step`` (whole numbers): known episodes, ranges within them, each once. ``episodes``: ``episode_id, length``."""
    rows = spark.read.schema(T.StructType([*_FRAGMENT, T.StructField("bad_", T.StringType())])).option("columnNameOfCorruptRecord", "bad_").json(path)
    met = rows.join(episodes.select("episode_id", "length"), "episode_id", "left")
    missing = F.col("bad_").isNotNull() | F.col("episode_id").isNull() | F.col("start_step").isNull() | F.col("end_step").isNull()
    ranged = (F.col("start_step") < 0) | (F.col("end_step") < F.col("start_step"))
    rest = lambda c: F.coalesce(~missing & c, F.lit(False))
    check(met, bad_fields=missing, unknown_episodes=rest(F.col("length").isNull()), bad_ranges=rest(ranged), beyond_the_end=rest(F.col("end_step") >= F.col("length")))
    return unique(rows.select(*_FRAGMENT.names), *_FRAGMENT.names)


def aligned(scores: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """Scores with their vectors, by id: both have the same ids, and vectors are ``width`` finite numbers."""
    both = scores.withColumn("s_", F.lit(True)).join(vectors.select("sample_id", "vec"), "sample_id", "full")
    fine = (F.size("vec") == width) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return check(both, no_scores=F.col("s_").isNull(), no_vectors=F.col("vec").isNull(), bad_vectors=F.col("vec").isNotNull() & ~F.coalesce(fine, F.lit(False))).drop("s_")


def rescored(rows: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    """``out`` computed again from its components (in [0, 1]); every other column, text included, stays as it is."""
    total = sum((w * F.expr(f"try_cast(`{c}` AS DOUBLE)") for c, w in weights.items()), F.lit(0.0))
    check(rows, no_number=total.isNull())
    return rows.withColumn(out, F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))).select(*rows.columns, *([] if out in rows.columns else [out]))


def write_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """``columns`` in this order, with a header in each part."""
    rows.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def write_selection(rows: DataFrame, path: str, parameters: dict) -> None:
    """A selection's folder: ``selected`` (CSV in order of choice), ``fragments`` (JSON lines), and last ``manifest`` with the parameters and counts.

    A folder without manifest is one that was not finished.
    """
    spark = rows.sparkSession
    write_csv(rows.orderBy("selection_order"), f"{path}/selected", rows.columns)
    rows.select(*_FRAGMENT.names).write.mode("errorifexists").json(f"{path}/fragments")
    n = spark.read.option("header", True).csv(f"{path}/selected").count()
    spark.createDataFrame([(json.dumps({"parameters": parameters, "selected": n, "status": "complete"}, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


def read_selection(spark: SparkSession, path: str, episodes: DataFrame) -> tuple[DataFrame, dict]:
    """The fragments of a finished selection, checked, and its manifest."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    rows = read_fragments(spark, f"{path}/fragments", episodes)
    if manifest.get("status") != "complete" or rows.count() != manifest["selected"]:
        raise SourceError("the selection is not complete")
    return rows, manifest


def weight_rows(spark: SparkSession, path: str, names: Sequence[str], total: float = 1.0) -> DataFrame:
    """JSON lines of candidate weights: ``position`` (from 0, in file order) and ``names``, each at least 0, which sum to ``total``."""
    rows = spark.read.schema(T.StructType([T.StructField(n, T.DoubleType()) for n in names])).json(path).withColumn("position", F.monotonically_increasing_id())
    sum_ = sum((F.col(n) for n in names), F.lit(0.0))
    return check(rows, bad_weights=F.coalesce((F.abs(sum_ - total) > 1e-9) | (F.least(*names) < 0), F.lit(True)))
