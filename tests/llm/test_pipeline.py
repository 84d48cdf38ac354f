"""The pipeline against a plain version of its stages."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipsieve.llm.queries import piece_model

from .test_operators import DOCS, WORD, edited, plain_components, plain_mix, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = [prose(50 + k, 40 + 9 * k) for k in range(10)]
    texts = [*base, base[0], base[0], *[edited(base[k], 0.01, k) for k in range(6)], *[edited(base[k], 0.3, 20 + k) for k in range(3)], None, "", "12 34 !", "one two", "  lead  and trail \n"]
    rows = [(10 + k, t, "en" if k % 5 else None, None if k % 9 == 0 else f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(at / "documents.parquet"))
    return str(at), rows


def key(doc_id, text):
    return hashlib.md5(f"{doc_id}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()


def plain_pipeline(rows):
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    last = {}
    for r in kept:
        last[r[1]] = max(last.get(r[1], -1), r[0])
    kept = [r for r in kept if last[r[1]] == r[0]]
    kept = [r for r in kept if (str(r[0]), str(r[0])) in {(i, c) for i, _, c in plain_components([x[0] for x in kept], [x[1] for x in kept])}]
    size, totals, target = plain_mix([(r[0], r[1], r[3]) for r in kept])
    mixed = []
    for source in totals:
        mine = sorted((key(r[0], r[1]), r, n) for r, n in zip(kept, size, strict=True) if r[3] == source)
        budget = int(target[source] + 1e-9)
        rounds, rest = divmod(budget, totals[source])
        for _, r, n in mine:
            mixed += [(r[0], r[1])] * rounds
            if rest >= n:
                mixed.append((r[0], r[1]))
            elif rest:
                spans = [m.end() for m in WORD.finditer(r[1])]
                first = WORD.search(r[1]).start()
                following = [m.start() for m in WORD.finditer(r[1])][rest]
                assert spans
                mixed.append((r[0], r[1][first:following]))
            rest = max(0, rest - n)
    return mixed


def test_pipeline(spark, folder):
    import sentencepiece

    path, rows = folder
    lib = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    want = []
    for doc_id, text in plain_pipeline(rows):
        ids = lib.encode(text, add_bos=True, add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, path).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns(spark, folder):
    path, rows = folder
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), path).columns == docs.columns, name


def test_every_source_is_near_its_target(spark, folder):
    path, rows = folder
    docs = spark.createDataFrame(rows, DOCS)
    size, totals, target = plain_mix([(r[0], r[1], r[3]) for r in rows])
    words = defaultdict(int)
    for r in corpus_pipeline.mix_sources(spark, docs, path).collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(words[s] - target[s]) <= 1 for s in totals)


def test_one_row_stays_of_repeats(spark):
    """Rows that repeat wholly, ids that repeat with another text, and null ids."""
    a, b, c, d = (prose(70 + k, 60) for k in range(4))
    schema = "doc_id long, text string, row string"
    docs = spark.createDataFrame([(1, a, "x"), (1, a, "x"), (1, a, "y"), (2, b, "x"), (2, c, "x"), (None, d, "x"), (None, d, "x"), (None, d, "y"), (None, c, "x"), (9, None, "x"), (None, "", "x")], schema)
    for parts in (1, 5):
        got = corpus_pipeline.drop_copies(spark, docs.repartition(parts), "").select("doc_id", "text").collect()
        assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(1, a), (2, b), (2, c), (None, d), (9, None)], "doc_id long, text string").collect()))
    near = lambda text, k: edited(text, 0.01, k)
    docs = spark.createDataFrame([(1, a, "x"), (5, b, "x"), (5, near(a, 1), "x"), (7, c, "x"), (7, c, "x"), (8, near(c, 2), "x"),
                                  (None, d, "x"), (None, near(d, 3), "x"), (None, near(b, 4), "x"), (3, near(a, 5), "x")], schema)
    for parts in (1, 5):
        got = corpus_pipeline.drop_near_copies(spark, docs.repartition(parts), "").select("doc_id", "text").collect()
        rest = [r for r in got if r["doc_id"] is not None]
        assert sorted((r["doc_id"], r["text"]) for r in rest) == sorted([(1, a), (5, b), (7, c)])
        assert len(got) == 4 and [r["text"] in (d, near(d, 3)) for r in got if r["doc_id"] is None] == [True]


def test_clashing_names_long_texts_and_empty_tables(spark, folder):
    """Stage by stage: columns that the operators use themselves pass through, and nothing crashes on extremes."""
    path, rows = folder
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    more = [(900, long, "en", None, None), (901, long + " end", None, "s1", None), (None, None, None, None, None), (None, "only words here", None, None, 3)]
    docs = spark.createDataFrame([*rows, *more], DOCS).withColumns({c: F.lit(c) for c in ("name", "piece", "cut", "of", "m", "digest", "key", "component_id", "size", "tie0")})
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, path)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept and all(r["piece"] == "piece" and r["key"] == "key" for r in kept), name
        assert stage(spark, docs.limit(0), path).count() == 0, name
        now = spark.createDataFrame(kept, docs.schema)
    assert now.filter("doc_id IN (900, 901)").select("doc_id").distinct().count() <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, now, path).count() == now.count()


def test_the_language_found_is_written(spark, folder):
    path, rows = folder
    docs = spark.createDataFrame([*rows, (1000, "w1 w2 w3", "fr", None, None)], DOCS)
    got = corpus_pipeline.identify_language(spark, docs, path).collect()
    assert {r["lang"] for r in got} <= {"en", "fr"} and all(any(c.isalpha() for c in r["text"]) for r in got)
