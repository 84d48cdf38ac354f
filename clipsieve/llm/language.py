"""Language identification by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches

#: n-grams in a profile, of a language and of a document.
PROFILE = 300
#: Bits for a code point; three fit one signed 64-bit integer.
BITS = 21
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _trigrams(text: str) -> np.ndarray:
    """Codes of all trigrams of the lower-cased words, each padded by a 0 at either side.

    A word is a run of letters; whatever else stands between words is dropped.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    # one 0 for every run of other characters, and one at either end
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    padded = np.where(letter, codes, 0)[keep].astype(np.int64)
    padded = np.concatenate([np.zeros(1, np.int64), padded, np.zeros(1, np.int64)])
    grams = (padded[:-2] << 2 * BITS) | (padded[1:-1] << BITS) | padded[2:]
    return grams[padded[1:-1] > 0]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of a text and their counts.

    Every letter is the middle of one trigram, so counts of single letters and of
    bigrams (a letter and what follows) are sums over trigrams. Codes of bigrams
    are below 0, those of letters below any bigram's.
    """
    grams, counts = np.unique(_trigrams(text), return_counts=True)
    return _with_shorter(grams, counts)


def _with_shorter(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, sums = [grams], [counts]
    for part in (-(grams & ((1 << 2 * BITS) - 1)) - 1, -((grams >> BITS) & ((1 << BITS) - 1)) - 1 - (1 << 2 * BITS)):
        key, at = np.unique(part, return_inverse=True)
        keys.append(key)
        sums.append(np.bincount(at, counts, len(key)).astype(np.int64))
    return np.concatenate(keys), np.concatenate(sums)


def profile(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    if len(grams) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        grams, counts = grams[some], counts[some]
    return grams[np.lexsort((grams, -counts))[:size]]


def learn_profiles(docs: DataFrame, size: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A profile of each language of ``docs``, from all its texts.

    Each task sums the trigrams of its rows by language; the sums are added up,
    shorter n-grams derived, and the ``size`` most frequent of each language
    come to the driver (languages x ``size`` rows). Rows without language or text
    are passed over.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def add(lang: str) -> None:
            grams, counts = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            if lang in total:
                grams, at = np.unique(np.concatenate([grams, total[lang][0]]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, total[lang][1]]), len(grams)).astype(np.int64)
            total[lang] = grams, counts

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(found := _trigrams(text))
                waiting += len(found)
                if waiting > 1_000_000:
                    for some in list(held):
                        add(some)
                    waiting = 0
        for lang in list(held):
            add(lang)
        for lang, (grams, counts) in total.items():
            for lo in range(0, len(grams), 50_000):
                g, n = grams[lo : lo + 50_000], counts[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col).mapInArrow(sums, schema)
    every = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    low, mid = (1 << 2 * BITS) - 1, (1 << BITS) - 1
    grams = every.select("lang", F.explode(F.array(
        F.struct(F.col("gram").alias("g"), F.col("n")),
        F.struct((-F.col("gram").bitwiseAND(F.lit(low)) - 1).alias("g"), F.col("n")),
        F.struct((-F.shiftright("gram", BITS).bitwiseAND(F.lit(mid)) - 1 - (1 << 2 * BITS)).alias("g"), F.col("n")))).alias("x"))
    summed = grams.groupBy("lang", F.col("x.g").alias("g")).agg(F.sum("x.n").alias("n"))
    top = summed.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "g"))).filter(F.col("r") <= size)
    out: dict[str, list] = {}
    for row in top.orderBy("lang", "r").toLocalIterator():
        out.setdefault(row["lang"], []).append(row["g"])
    return {lang: np.array(grams, np.int64) for lang, grams in out.items()}


def distances(doc: np.ndarray, known: np.ndarray, ranks: np.ndarray, size: int) -> np.ndarray:
    """Out-of-place distance of a document's profile to each language's.

    ``known``: sorted n-grams of all profiles; ``ranks[k, l]``: the rank of the
    k-th in language l. An n-gram that a language lacks is ``size`` places out.
    """
    at = np.minimum(np.searchsorted(known, doc), len(known) - 1)
    there = known[at] == doc
    out = np.full((len(doc), ranks.shape[1]), size, np.int64)
    places = ranks[at[there]]
    out[there] = np.where(places >= 0, np.abs(places - np.flatnonzero(there)[:, None]), size)
    return out.sum(axis=0)


class Identifier:
    """Predicts the language of single texts from the profiles learned."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.known = np.unique(np.concatenate([profiles[x] for x in self.names])) if self.names else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.known), len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.known, profiles[name]), k] = np.arange(len(profiles[name]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not len(self.known):
            return UNKNOWN, 0.0
        grams, counts = ngram_counts(text)
        if not len(grams):
            return UNKNOWN, 0.0
        far = distances(profile(grams, counts, self.size), self.known, self.ranks, self.size)
        best = int(np.argmin(far))
        rest = np.delete(far, best)
        if not len(rest):
            return self.names[best], 1.0
        return self.names[best], float((rest.min() - far[best]) / rest.min()) if rest.min() else 0.0


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for every row of ``docs``.

    The language whose profile has the smallest out-of-place distance, ties to
    the first by name; ``score`` is how much nearer it is than the next, as a
    share of the next's distance (1 if there is no other language). A text that
    is null, empty or has no letters gives ``und`` and 0, as does everything if
    no language was learned. Whole texts are read, in Arrow batches and without a
    shuffle; other columns are not read. Repeated rows give repeated rows.
    """
    bound_batches(docs.sparkSession)
    one = Identifier(profiles, size)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(rows, schema)


def identified_rows(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, in whose text a language is found, with it in ``lang_col``; those with ``und`` are left out.

    Null and empty texts and those without a letter are ``und``. Repeated rows
    stay as often as they come; an empty table gives none. Other columns pass
    through, whatever their names.
    """
    bound_batches(docs.sparkSession)
    one, at, to = Identifier(profiles, size), docs.columns.index(text_col), docs.columns.index(lang_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([one(t)[0] for t in batch.column(at).to_pylist()], pa.string())
            columns = [found.cast(batch.schema.field(k).type) if k == to else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pc.not_equal(found, UNKNOWN))

    return docs.mapInArrow(rows, docs.schema)
