"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import buckets, shingles
from .common import Scratch, free

#: Target documents from which the target model is counted, at most (in expectation).
TARGET_ROWS = 20_000
#: n-gram buckets: a power of two, one for every eighth word at least, at any size of the corpus.
MIN_BITS = 14
#: Rounds in which texts are scored, so that a round's files are a part of the whole.
ROUNDS = 6


def _buckets(texts: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """The buckets of each text's words and word pairs."""
    shift = np.uint64(64 - bits)
    for words, first in shingles.word_hashes(texts):
        pairs = shingles.mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
        one, two = (words >> shift).astype(np.int64), (pairs >> shift).astype(np.int64)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.concatenate([one[lo:hi], two[lo : max(lo, hi - 1)]])


def bucket_bits(words: int) -> int:
    """Bits of the bucket number for a corpus of so many words."""
    return max(MIN_BITS, (max(words, 8) // 8).bit_length())


def count_models(docs: DataFrame, bits: int) -> DataFrame:
    """``piece, raw, target, n_raw, n_target``: counts of n-grams by bucket, of raw (all) and of target rows of ``text, target``.

    Each task counts a chunk's distinct buckets; pieces of them are dealt out by
    number and added in a stream, one piece at a time.
    """
    low = buckets.low_bits(bits)
    sent = T.StructType([T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in ("places", "raw", "target")])
    schema = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("raw", T.BinaryType()), T.StructField("target", T.BinaryType()),
                           T.StructField("n_raw", T.LongType()), T.StructField("n_target", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks, n = [], [], 0

        def packed() -> pa.RecordBatch:
            marked = np.repeat(np.array(marks, bool), [len(b) for b in held])
            found, at, raw = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            target = np.bincount(at[marked], minlength=len(found))
            rows = [(k, places, buckets.pack(raw[lo:hi].astype(np.uint32)), buckets.pack(target[lo:hi].astype(np.uint32))) for k, lo, hi, places in buckets.cut(found, low)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 3, strict=True)], sent.names)

        for batch in batches:
            for found, target in zip(_buckets(batch.column(0), bits), batch.column(1).to_pylist(), strict=True):
                held.append(found)
                marks.append(bool(target))
                n += len(found)
                if n >= buckets.CHUNK or len(held) >= buckets.TEXTS:
                    yield packed()
                    held, marks, n = [], [], 0
        if n:
            yield packed()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, 0), np.int64)

        def summed() -> pa.RecordBatch:
            values = [now, buckets.pack(sums[0]), buckets.pack(sums[1]), int(sums[0].sum()), int(sums[1].sum())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], schema.names)

        for batch in batches:
            for k, places, raw, target in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != now:
                    if now is not None:
                        yield summed()
                    now, sums = k, np.zeros((2, 1 << low), np.int64)
                at = buckets.places_of(places)
                sums[0][at] += buckets.unpack(raw, np.uint32)
                sums[1][at] += buckets.unpack(target, np.uint32)
        if now is not None:
            yield summed()

    found = docs.select("text", "target").mapInArrow(count, sent)
    return found.repartition("piece").sortWithinPartitions("piece").mapInArrow(add_up, schema)


def log_ratio(raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int, size: int) -> np.ndarray:
    """log of target over raw probability of each bucket; the target's is smoothed by a tenth of the raw model.

    ``n_raw``, ``n_target``: the models' sums; ``size``: the number of all buckets. Without target text 0.
    """
    if not n_target:
        return np.zeros(len(raw), np.float32)
    p = (raw + 1.0) / (n_raw + size)
    q = 0.9 * (target + 0.0) / n_target + 0.1 * p
    return (np.log(q) - np.log(p)).astype(np.float32)


def weights(docs: DataFrame, counts: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """``doc_id, log_weight, gumbel``: the log of the importance weight (the sum over n-grams) and unit Gumbel noise.

    The noise is a function of id and text, so reruns agree, and rows that repeat
    both share it. The model stays a table: chunks of texts send their distinct
    buckets to the pieces, which send back the ratios, in rounds over parts of
    the documents.
    """
    n_raw, n_target = counts.agg(F.coalesce(F.sum("n_raw"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("gumbel", T.DoubleType())])

    def ratios(held: list[bytes]) -> np.ndarray:
        return log_ratio(buckets.unpack(held[0], np.int64), buckets.unpack(held[1], np.int64), n_raw, n_target, 1 << bits)

    def scored(batch: pa.RecordBatch, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = list(_buckets(batch.column(1), bits))
        table = values[np.unique(np.concatenate(held), return_inverse=True)[1]].astype(np.float64)
        ends = np.cumsum([len(b) for b in held]).tolist()
        found = [float(table[hi - len(b) : hi].sum()) for b, hi in zip(held, ends, strict=True)]
        mixed = shingles.mix(batch.column(2).to_numpy().astype(np.int64).view(np.uint64))
        uniform = ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array(-np.log(-np.log(uniform)), pa.float64())], schema.names)

    noise = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", noise.alias("noise"))
    out = None
    for k in range(ROUNDS):
        some = rows.filter(F.pmod("noise", F.lit(ROUNDS)) == k)
        asked = scratch.write(buckets.asks(some, bits, lambda texts: _buckets(texts, bits), 1), f"asks{k}")
        answered = buckets.answers(asked, counts, ("raw", "target"), ratios)
        part = scratch.write(buckets.met(asked, answered, np.float32, scored, schema), f"scores{k}")
        scratch.drop(f"asks{k}")
        free(docs)
        out = part if out is None else out.unionByName(part)
    return out


def kth_largest(values: DataFrame, k: int, bins: int = 1024, few: int = 10_000) -> float:
    """The k-th largest of column ``x``, by repeated histograms over the range that holds it."""
    lo, hi = values.agg(F.min("x"), F.max("x")).first()
    if lo is None or k <= 0:
        return float("inf")
    while True:
        inside = values.filter(F.col("x").between(lo, hi))
        if lo == hi:
            return lo
        width = (hi - lo) / bins
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(
            F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int").alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            n, low, high = counts[b]
            if k <= n:
                lo, hi = low, high
                break
            k -= n
        else:
            return min(low for _, low, _ in counts.values())
        if n <= few:
            return values.filter(F.col("x").between(lo, hi)).orderBy(F.desc("x")).limit(k).agg(F.min("x")).first()[0]


def resample(docs: DataFrame, labels: DataFrame, scratch: Scratch, share: float | None = None, temperature: float = 1.0) -> DataFrame:
    """``doc_id, log_weight, sample_key, kept`` for every row of ``docs`` (``doc_id, text``).

    Target text is that of documents labelled ``quality`` 1 (a bounded number of
    them), raw text that of all. ``sample_key`` is the log weight plus Gumbel
    noise times ``temperature``; the ``share`` of rows with the largest keys is
    kept (without replacement; default: the labels' share of quality 1). Rows
    with the very key at which the cut falls are all kept. Null and empty texts
    have log weight 0. Without target labels all weights are 0. Documents labelled
    more than once count by the largest label; other columns are not read.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count(F.lit(1)), F.sum((F.col("quality") > 0).cast("long"))).first()
    share = share if share is not None else ((good or 0) / n if n else 1.0)
    ids = known.filter("quality > 0").filter(F.crc32(F.md5(F.col("doc_id").cast("string"))) < int(2**32 * min(1.0, TARGET_ROWS / max(1, good or 0))))
    flagged = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", F.lit(True).alias("target"))), "doc_id", "left")
    total, words = docs.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    bits = bucket_bits((words or 0) // 6)
    counts = scratch.write(count_models(flagged, bits), "counts")
    free(docs)
    scored = weights(docs, counts, bits, scratch).withColumn("sample_key", F.col("log_weight") + temperature * F.col("gumbel")).drop("gumbel")
    cut = kth_largest(scored.select(F.col("sample_key").alias("x")), round(share * total))
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(cut))
