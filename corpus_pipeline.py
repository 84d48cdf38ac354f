"""A training corpus from documents, in stages: each is written as Parquet and read again as the next one's documents.

``run`` applies the stages to a folder's ``documents``; the last gives token
counts and digests of what the others kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsieve.llm import dedup, jaccard, language, mixing, pieces, queries
from clipsieve.llm.common import Scratch, fresh_name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes each text's language into ``lang`` and leaves out texts in which none is found: null, empty, or without a letter.

    Profiles come from the rows outside the held-out fold that have a language. Repeated rows and null ids stay as they
    are; an empty table gives none; columns besides ``doc_id, text, lang`` pass through.
    """
    return language.identified_rows(docs, queries.language_profiles(docs))


def named(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a name of each row, made of all its columns, and the name's column: ids may repeat or be null, so stages choose rows by it.

    Rows of one name repeat wholly, and any of them stands for the others.
    """
    name = fresh_name(docs, "name")
    return docs.withColumn(name, F.concat_ws("-", F.hex(F.xxhash64(*docs.columns)), F.hex(F.xxhash64(F.lit(1), *docs.columns)))), name


def only(docs: DataFrame, name: str, kept: DataFrame) -> DataFrame:
    """One row of each of the names in ``kept``; texts are shuffled once."""
    chosen = docs.join(kept.select(name).distinct().hint("merge"), name, "left_semi").dropDuplicates([name])
    return chosen.drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: that with the largest doc_id (null: the smallest), of repeated ids that with the largest name.

    Null and empty texts are equal; an empty table gives no rows; other columns pass through, whatever their names.
    """
    scratch, (rows, name) = Scratch(spark, "pipeline-copies"), named(docs)
    index = dedup.DigestIndex(spark, scratch.path("index"))
    found = dedup.exact_dedup(rows, index, scratch, tie_cols=(name,))
    index.forget()
    return only(rows, name, found.filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links (five words, 0.8) one row stays: that with the smallest doc_id (null: the largest), of repeated ids that with the smallest name.

    Rows are the nodes, so rows that share an id are told apart. Texts without words link with nothing and stay; rows that repeat wholly count once;
    an empty table gives no rows; other columns pass through, whatever their names.
    """
    scratch, (rows, name) = Scratch(spark, "pipeline-near"), named(docs)
    found = jaccard.similar_classes(rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", name).alias("doc_id"), "text"), scratch)
    return only(rows, name, found.select(F.col(f"component_id.{name}").alias(name)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document, the last one cut at its source's budget.

    A null source is a source; texts without words are left out; null ids and repeats are mixed like others; an empty
    table gives no rows; other columns pass through.
    """
    return mixing.mixed_documents(docs, Scratch(spark, "pipeline-mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, covered`` of every row of the mix; null text counts as empty, other columns are not read."""
    return pieces.encode(docs, queries.piece_model(), ("n_tokens", "ids_sha256", "decoded_sha256", "covered"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: The last stage can't be expressed in SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives for the folder's ``documents``; the stages state how they treat nulls, repeats and empty tables."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, name)
    return docs
