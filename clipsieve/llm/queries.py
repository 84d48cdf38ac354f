"""The queries over the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dedup, jaccard, language, mixing, neighbours, pieces, resampling, toxicity, urls
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    index = dedup.DigestIndex(spark, scratch.path("index"))
    found = dedup.exact_dedup(_table(spark, sf_dir, "documents"), index, scratch)
    index.forget()
    return found


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), Scratch(spark, "op2")).drop("source")


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Scratch(spark, "op4"))


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(_table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), piece_model(), ("n_tokens", "ids_sha256", "decoded_sha256", "covered"))


def _spread(value: Column) -> Column:
    """A number that spreads evenly: the first 28 bits of the md5."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 7), 16, 10).cast("long")


#: Days of the captures' year; the tables have no fetch times or lists, so both follow from hashes.
DAYS = 365


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against lists on which half the hosts come and go, and ``example.net`` for three weeks."""
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select(F.col("page_id").alias("id"), "url", (_spread(F.col("page_id")) % DAYS).alias("fetched"))
    hosts = captures.select(urls.host(F.col("url")).alias("key")).filter("key != ''").distinct()
    spread = _spread(F.col("key"))
    dated = hosts.filter(spread % 2 == 0).select("key", F.explode(F.array(
        F.struct(F.lit("block").alias("action"), (spread % 200).alias("listed")),
        F.struct(F.when(spread % 3 == 0, "allow").otherwise("remove").alias("action"), (spread % 200 + 20 + spread % 90).alias("listed")))).alias("e")).select("key", "e.*")
    fixed = spark.sql("SELECT * FROM VALUES ('example.net', 'block', 180L), ('example.net', 'remove', 201L) AS fixed(key, action, listed)")
    found = urls.evaluate(captures, dated.unionByName(fixed))
    return found.select(F.col("id").alias("page_id"), "host", "fetched", "matched", "action", "since", "blocked")


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2k against 2k + 1, the first as the chosen one."""
    turns = _table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")
    pairs = chat.preference_pairs(turns)
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"], s["end"])), ",")
    return pairs.withColumns({c: shown(c) for c in ("chosen_mask", "rejected_mask")})


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op8"))


def _fold(n: int) -> Column:
    """crc32 of doc_id as text, mod n (null: that of the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def language_profiles(docs: DataFrame) -> dict:
    """Profiles learned outside the held-out fold."""
    return language.learn_profiles(docs.filter(_fold(3) != 1))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language_profiles(docs))
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    train = toxicity.training_rows(docs, labels.filter(_fold(5) != 0), Scratch(spark, "op1"))
    found = toxicity.score(docs, toxicity.train_model(train))
    return found.withColumn("held_out", _fold(5) == 0)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mix_sources, op3_exact_dedup, op4_importance_resampling, op5_shingle_join,
                                     op6_sentencepiece, op7_url_filter, op8_neighbours, op9_preference_pairs, op10_language_id)}

#: Targets: weights 5, 2, 1 in turn, 150 % of all words, 2 times a source's at most.
#: The level is that of the first source in order of cap / weight which stays below its cap.
_TARGETS = r"""
    sizes AS (
        SELECT source, key, size, doc_id FROM (SELECT *, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key,
               coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs})),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
    weighted AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM totals),
    filled AS (
        SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
        FROM weighted WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (
        SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * (SELECT level FROM filled WHERE level * weight < 2.0::DOUBLE * source_size ORDER BY 2.0::DOUBLE * source_size / weight, source LIMIT 1)) AS target FROM filled)
"""

_TAKEN = """
    taken AS (
        SELECT doc_id, key, size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size * size
                    + greatest(0, least(size, floor(target)::BIGINT % source_size - (sum(size) OVER (PARTITION BY source ORDER BY key) - size))) END::BIGINT AS taken
        FROM (SELECT s.*, t.source_size, t.target FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source))
"""

ORACLES = {
    "op2_mix_sources": f"WITH {_TARGETS.format(docs='documents')}, {_TAKEN} SELECT doc_id, size, source_size, target, taken FROM taken",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op7_url_filter": r"""
        WITH captures AS (
            SELECT page_id, fetched, host FROM (SELECT page_id, crc % 365 AS fetched, coalesce(regexp_replace(lower(regexp_extract(url,
                   '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', ''), '') AS host FROM (SELECT *, ('0x' || substr(md5(page_id::VARCHAR), 1, 7))::BIGINT AS crc FROM pages))),
        hosts AS (SELECT host AS key, ('0x' || substr(md5(host), 1, 7))::BIGINT AS crc FROM (SELECT DISTINCT host FROM captures WHERE host != '')),
        entries AS (
            SELECT key, 'block' AS action, crc % 200 AS listed FROM hosts WHERE crc % 2 = 0
            UNION ALL SELECT key, CASE WHEN crc % 3 = 0 THEN 'allow' ELSE 'remove' END, crc % 200 + 20 + crc % 90 FROM hosts WHERE crc % 2 = 0
            UNION ALL VALUES ('example.net', 'block', 180), ('example.net', 'remove', 201)),
        spans AS (SELECT *, lead(listed) OVER (PARTITION BY key ORDER BY listed) AS until FROM entries),
        matches AS (
            SELECT c.page_id, s.key, s.action, s.listed, row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.key) DESC) AS r
            FROM captures c JOIN spans s ON (c.host = s.key OR ends_with(c.host, '.' || s.key)) AND s.action != 'remove'
                 AND s.listed <= c.fetched AND (s.until IS NULL OR c.fetched < s.until))
        SELECT c.page_id, c.host, c.fetched, m.key AS matched, m.action, m.listed AS since, coalesce(m.action = 'block', false) AS blocked
        FROM captures c LEFT JOIN matches m ON c.page_id = m.page_id AND m.r = 1
    """,
    "op9_preference_pairs": r"""
        WITH turns AS (
            SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS good, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
                   coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        shown AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS r FROM turns),
        joined AS (
            SELECT coalesce(c.pair_id, j.pair_id) AS pair_id, coalesce(c.place, j.place) AS place,
                   coalesce(c.role = j.role AND c.text = j.text, false) AS same
            FROM (SELECT * FROM turns WHERE good) c FULL JOIN (SELECT * FROM turns WHERE NOT good) j ON c.pair_id = j.pair_id AND c.place = j.place),
        cuts AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN place END) - 1, max(place)) AS n_common FROM joined GROUP BY pair_id),
        ends AS (
            SELECT s.*, n_common, sum(length(r)) OVER (PARTITION BY s.pair_id, good ORDER BY place) AS e
            FROM shown s JOIN cuts USING (pair_id) WHERE place > n_common),
        spans AS (SELECT *, (e - length(text) - 8)::BIGINT || '-' || e::BIGINT AS span FROM ends)
        SELECT c.pair_id, c.n_common::BIGINT AS n_common,
               coalesce((SELECT string_agg(r, '' ORDER BY place) FROM shown s WHERE s.pair_id = c.pair_id AND good AND place <= c.n_common), '') AS prompt,
               coalesce((SELECT string_agg(r, '' ORDER BY place) FROM spans s WHERE s.pair_id = c.pair_id AND good), '') AS chosen,
               coalesce((SELECT string_agg(r, '' ORDER BY place) FROM spans s WHERE s.pair_id = c.pair_id AND NOT good), '') AS rejected,
               coalesce((SELECT string_agg(span, ',' ORDER BY place) FROM spans s WHERE s.pair_id = c.pair_id AND good AND role = 'assistant'), '') AS chosen_mask,
               coalesce((SELECT string_agg(span, ',' ORDER BY place) FROM spans s WHERE s.pair_id = c.pair_id AND NOT good AND role = 'assistant'), '') AS rejected_mask,
               EXISTS (SELECT 1 FROM spans s WHERE s.pair_id = c.pair_id AND good) AND EXISTS (SELECT 1 FROM spans s WHERE s.pair_id = c.pair_id AND NOT good) AS usable
        FROM cuts c
    """,
}
