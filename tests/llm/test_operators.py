"""The training-data operators against brute-force versions, and on nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.llm import buckets, chat, components, dedup, jaccard, language, mixing, neighbours, pieces, queries, resampling, shingles, toxicity, urls
from clipsieve.llm.common import Scratch
from clipsieve.llm.queries import piece_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


def edited(text, share, seed):
    rng = np.random.default_rng(seed)
    words = text.split(" ")
    for k in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[k] = f"x{seed}y{k}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    base = [prose(k, 60 + 7 * k) for k in range(12)]
    texts = [*base, *base[:3], *[edited(base[k % 12], 0.004 + 0.02 * (k % 5), k) for k in range(60)], None, "", " \t\n", "one two", "One  TWO", "two one", prose(99, 30_000, 50_000)]
    texts += [edited(texts[-1], 0.001, 7), "a b c d e", "A B C D E f", "é ü", "x" * 5000]
    rows = [(100 + 3 * k, t, None if k % 7 == 0 else "en", None if k % 11 == 0 else f"s{k % 3}", None) for k, t in enumerate(texts)]
    rows += [rows[4], (None, "no id here", None, None, None)]
    return table(spark, rows).withColumns({"key": F.lit("clash"), "digest": F.lit(1), "cut": F.lit(2), "rounds": F.lit(0)}).persist()


def plain_sets(texts):
    out = []
    for t in texts:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    return out


# -- 1 ----------------------------------------------------------------------------


def test_grammar_weighs_context():
    reader = toxicity.Reader((("idiot$", 5.0), ("scum", 5.0)))
    plain, aimed, negated, reported = (reader.clause(c) for c in ("an idiot came", "you are an idiot", "you are not an idiot", "they said he is an idiot"))
    assert aimed > plain > 0 and negated < plain and reported < aimed
    assert reader.clause("scummy thing") > 0 and reader.clause("idiotic thing") == 0
    assert reader.clause("kill the lights") == 0 and reader.clause("i will kill you") > 0
    assert reader.features(None) == reader.features("") == (0.0, 0.0, 0.0)


def test_apostrophes_and_marks_of_speech():
    reader = toxicity.Reader((("idiot$", 5.0),))
    denied, reported = reader.clause("you are not an idiot"), reader.clause("she said you are an idiot")
    assert reader.clause("you aren't an idiot") == reader.clause("you aren’t an idiot") == denied < reader.clause("you are an idiot")
    assert reader.clause("she said: you are an idiot") == reader.clause("she said, you are an idiot") == reported < reader.clause("you are an idiot")
    assert reader.features("She said: you are an idiot. Fine.") == reader.features("she said, you are an idiot. fine!")
    assert reader.clause("l'idiot") > 0 and reader.clause("not here, you idiot") == reader.clause("here, you idiot")


def test_composition_feeds_one_machine_to_the_next():
    """The composed grammar against the chain, run one after the other."""
    rng = np.random.default_rng(3)
    for _ in range(500):
        word, state, composed, states, chained = [], 0, [], [0] * len(toxicity.CHAIN), []
        for tag in rng.choice(toxicity.TAGS, 12):
            written, state, w = toxicity.GRAMMAR.step(state, str(tag))
            composed.append((written, w))
            symbol, total = str(tag), 0.0
            for k, machine in enumerate(toxicity.CHAIN):
                symbol, states[k], v = machine.step(states[k], symbol)
                total += v
            chained.append((symbol, total))
            word.append(tag)
        assert composed == chained, word
    rename = toxicity.compose(toxicity.Transducer(({"other": ("insult", 0, 1.0)},)), toxicity.Transducer(({"insult": ("aimed", 1, 2.0)}, {})))
    assert rename.step(0, "other")[::2] == ("aimed", 3.0)


SMALL = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_toxicity_of_held_out_documents(spark):
    """The query's scores against a plain loop, and its accuracy on the held-out fold."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert len(got) == docs.count() and all(r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i]["score"], t) for i, t in labels.items() if i in got and got[i]["held_out"]]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) >= 0.9
    assert np.mean([(s >= 0.5) == bool(t) for s, t in held]) >= 0.9


def test_scores_of_long_texts_and_clashing_names(spark):
    model = toxicity.Model((("idiot$", 5.0),), -3.0, (2.0, 0.1, 0.1))
    rows = [(1, "you idiot. " * 100_000), (2, "calm words " * 100_000), (2, None), (None, "idiot")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "predicted": F.lit(1), "strongest": F.lit(None).cast("string")})
    reader = toxicity.Reader(model.insults)
    got = sorted((str(r["doc_id"]), round(r["score"], 9)) for r in toxicity.score(frame, model).collect())
    assert got == sorted((str(i), round(model.score(reader.features(t)), 9)) for i, t in rows)


def test_toxicity_learns_stems(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(400):
        words = [f"p{x}q" for x in rng.integers(0, 300, 60)]
        bad = k % 4 == 0
        if bad:
            for at in rng.choice(60, 4, replace=False):
                words[at] = ("zorg" + "abc"[int(rng.integers(3))]) if k % 8 else "blarp"
        rows.append((k, " ".join(w + ("." if i % 9 == 0 else "") for i, w in enumerate(words)), None, None, None))
        labels.append((k, 1, int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "", None, None, None)]
    docs, marks = table(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    train = toxicity.training_rows(docs, marks.filter("doc_id % 5 != 0"), Scratch(spark, "t1"))
    model = toxicity.train_model(train)
    assert any(s.rstrip("$") in "zorg" or s.startswith("zorg") for s, _ in model.insults) and any("blarp".startswith(s.rstrip("$")) for s, _ in model.insults)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 403 and all(got[k]["predicted"] == int(k % 4 == 0) for k in range(400))
    assert got[1000]["score"] == got[1001]["score"] < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train_model(train.limit(0)).insults == ()


# -- 2 ----------------------------------------------------------------------------


def plain_mix(rows, weights=(5, 2, 1), share=1.5, epochs=2.0):
    size = [len(WORD.findall(t or "")) for _, t, s in rows]
    totals = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        totals[s] += n
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, budget = set(), share * sum(size)
    while True:
        free = [s for s in order if s not in capped]
        level = (budget - sum(epochs * totals[s] for s in capped)) / sum(weight[s] for s in free) if free else float("inf")
        over = {s for s in free if level * weight[s] >= epochs * totals[s]}
        if not over:
            break
        capped |= over
    return size, totals, {s: epochs * totals[s] if s in capped else level * weight[s] for s in order}


def test_mix(spark, corpus):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in corpus.collect()]
    size, totals, target = plain_mix(rows)
    got = mixing.mix(corpus, Scratch(spark, "t2")).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(size)
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == totals[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
    for s, t in target.items():
        assert abs(taken[s] - t) <= 2
    again = mixing.mix(corpus.repartition(7), Scratch(spark, "t2")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(corpus.limit(0), Scratch(spark, "t2")).count() == 0


def test_mixed_documents_hold_what_is_taken(spark, corpus):
    unique = corpus.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(unique, Scratch(spark, "t2")).collect()}
    mixed = mixing.mixed_documents(unique, Scratch(spark, "t2"))
    assert mixed.columns == unique.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert dict(words) == {k: v for k, v in taken.items() if v}


# -- 3 ----------------------------------------------------------------------------


def test_exact_dedup(spark, corpus):
    scratch = Scratch(spark, "t3")
    got = dedup.exact_dedup(corpus, dedup.DigestIndex(spark, scratch.path("i"), 4), scratch).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in corpus.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = sorted((str(i), str(max((x for x in groups[t] if x is not None), default=None)), len(groups[t]), i == max((x for x in groups[t] if x is not None), default=None), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_dedup_against_earlier_batches(spark):
    scratch = Scratch(spark, "t3b")
    index = dedup.DigestIndex(spark, scratch.path("i"), 4)
    first = table(spark, [(1, "a", None, None, None), (2, "b", None, None, None), (3, "a", None, None, None)])
    second = table(spark, [(9, "a", None, None, None), (10, "c", None, None, None), (11, "c", None, None, None)])
    shown = lambda rows: {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows.collect()}
    want = {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}
    assert shown(dedup.exact_dedup(first, index, scratch, "0")) == want
    index.forget()
    reopened = dedup.DigestIndex(spark, scratch.path("i"), 4)
    assert shown(dedup.exact_dedup(first, reopened, scratch, "0")) == want and reopened.read().count() == 2
    for _ in range(2):
        assert shown(dedup.exact_dedup(second, reopened, scratch, "1")) == {9: (3, 1, False), 10: (11, 2, False), 11: (11, 2, True)}
    assert reopened.read().count() == 3 == reopened.compact(scratch.path("j")).read().count()
    assert dedup.exact_dedup(first.limit(0), reopened, scratch, "2").count() == 0


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_of_falling_ids_cover_all_rows(spark, batches):
    rows = spark.createDataFrame([(k % 37 if k % 5 else None,) for k in range(200)], "id long")
    parts = [[r["id"] for r in p.collect()] for p in dedup._falling(rows, batches)]
    assert sorted(map(str, sum(parts, []))) == sorted(str(r["id"]) for r in rows.collect())
    known = [[i for i in p if i is not None] for p in parts]
    assert all(min(a) > max(b) for a, b in zip(known, known[1:])) and all(None not in p for p in parts[:-1])


# -- 4 ----------------------------------------------------------------------------


def test_resampling_prefers_target_text(spark):
    good, bad = [prose(k, 80, 100) for k in range(60)], [" ".join(f"z{x}" for x in np.random.default_rng(k).integers(0, 100, 80)) for k in range(60)]
    docs = table(spark, [(k, t, None, None, None) for k, t in enumerate([*good, *bad, None, ""])])
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(0, 120, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in resampling.resample(docs, labels, Scratch(spark, "t4")).collect()}
    assert len(got) == 122 and sum(r["kept"] for r in got.values()) == 61
    assert sum(got[k]["kept"] for k in range(60)) >= 58 and not any(got[k]["kept"] for k in range(60, 120))
    assert got[120]["log_weight"] == got[121]["log_weight"] == 0
    assert resampling.resample(docs.limit(0), labels, Scratch(spark, "t4")).count() == 0


def test_resampling_against_brute_force(spark, corpus):
    """Weights from exact counts (buckets are wide enough here to hold few collisions), and the largest keys kept, ties at the cut included."""
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    labels = spark.createDataFrame([(i, 1 if k % 3 == 0 else 0, 0) for k, (i, _) in enumerate(rows[:60]) if i], "doc_id long, quality int, toxic int")
    target_ids = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    import pyarrow as pa

    bits = resampling.bucket_bits(sum(len(t or "") for _, t in rows) // 6)
    found = list(resampling._buckets(pa.array([t for _, t in rows]), bits))
    raw, target = Counter(), Counter()
    for (i, _), b in zip(rows, found, strict=True):
        raw.update(b.tolist())
        if i in target_ids:
            target.update(b.tolist())
    n, m = sum(raw.values()), sum(target.values())

    def ratio(b):
        p = (raw[b] + 1) / (n + (1 << bits))
        return np.log(0.9 * target[b] / m + 0.1 * p) - np.log(p)

    want = sorted((str(i), sum(ratio(x) for x in b.tolist())) for (i, _), b in zip(rows, found, strict=True))
    got = resampling.resample(corpus, labels, Scratch(spark, "t4c"), share=0.4).collect()
    assert [i for i, _ in want] == sorted(str(r["doc_id"]) for r in got)
    assert sorted(r["log_weight"] for r in got) == pytest.approx(sorted(w for _, w in want), rel=1e-3, abs=1e-3)
    keys = sorted((r["sample_key"] for r in got), reverse=True)
    cut = keys[round(0.4 * len(got)) - 1]
    assert all(r["kept"] == (r["sample_key"] >= cut) for r in got)
    noise = {(r["doc_id"], round(r["log_weight"], 3)): r["sample_key"] - r["log_weight"] for r in got}
    assert len({round(x, 6) for x in noise.values()}) == len(noise)


def test_gumbel_noise_is_of_unit_scale(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = resampling.resample(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), Scratch(spark, "t4d")).collect()
    x = np.array([r["sample_key"] for r in got])
    assert all(r["log_weight"] == 0 and r["kept"] for r in got) and abs(x.mean() - 0.5772) < 0.06 and abs(x.std() - np.pi / 6**0.5) < 0.06


def test_buckets_grow_with_the_corpus():
    assert [resampling.bucket_bits(8 * n) for n in (1 << 13, 1 << 22, 1 << 26, 1 << 29)] == [14, 23, 27, 30]


def test_ratios_from_pieces_match_one_table(spark, corpus, monkeypatch):
    """Beyond the largest piece size there are more pieces (here 128)."""
    import pyarrow as pa

    bits = 15
    monkeypatch.setattr(buckets, "CHUNK", 10_000)
    monkeypatch.setattr(buckets, "PIECE_BITS", 8)
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    found = list(resampling._buckets(pa.array([t for _, t in rows]), bits))
    raw, target = Counter(np.concatenate(found).tolist()), Counter(np.concatenate([b for (i, _), b in zip(rows, found, strict=True) if (i or 1) % 2 == 0]).tolist())
    ratio = {b: float(resampling.log_ratio(np.array([n]), np.array([target[b]]), raw.total(), target.total(), 1 << bits)[0]) for b, n in raw.items()}
    want = sorted((str(i), sum(ratio[x] for x in b.tolist())) for (i, _), b in zip(rows, found, strict=True))
    scratch = Scratch(spark, "t4b")
    counts = scratch.write(resampling.count_models(corpus.withColumn("target", F.col("doc_id") % 2 == 0), bits), "counts")
    got = sorted((str(r["doc_id"]), r["log_weight"]) for r in resampling.weights(corpus, counts, bits, scratch).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [w for _, w in got] == pytest.approx([w for _, w in want], rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("k", [1, 7, 500, 999])
def test_kth_largest(spark, k):
    values = np.round(np.random.default_rng(k).normal(size=1000), 2)
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert resampling.kth_largest(frame, k, bins=8, few=20) == sorted(values, reverse=True)[k - 1]


# -- 5 ----------------------------------------------------------------------------


def plain_components(ids, texts):
    sets = plain_sets(texts)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, n in enumerate(ids):
        r = find(i)
        least[r] = n if least.get(r) is None else least[r] if n is None else min(n, least[r])
    return sorted((str(n), len(sets[i]), str(least[find(i)])) for i, n in enumerate(ids))


def test_similar_classes(spark, corpus):
    rows = corpus.select("doc_id", "text").collect()
    got = jaccard.similar_classes(corpus, Scratch(spark, "t5")).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain_components([r["doc_id"] for r in rows], [r["text"] for r in rows])
    assert jaccard.similar_classes(corpus.limit(0), Scratch(spark, "t5")).count() == 0


def test_a_group_that_closes_without_its_hub(spark):
    """Many copies at all distances: links between members that are far from the hub must be found."""
    base = prose(3, 160)
    texts = [base]
    for k in range(70):
        texts.append(edited(texts[int(np.random.default_rng(k).integers(0, len(texts)))], 0.012, 1000 + k))
    docs = table(spark, [(k * 2, t, None, None, None) for k, t in enumerate(texts)])
    got = jaccard.similar_classes(docs, Scratch(spark, "t5b")).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain_components([k * 2 for k in range(len(texts))], texts)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 50), (50, 101), (7, 7), (3, 2)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "cc")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[100] == got[101] == got[50] == 50


def test_shingles_match_the_definition():
    import pyarrow as pa

    texts = ["a b c d e f", "A b  C\td e f", None, "", "x", " lead and trail ", "é É a b c d", "a b a b a b a b a b"]
    got = list(shingles.shingle_sets(pa.array(texts)))
    assert [len(s) for s in got] == [len(s) for s in plain_sets(texts)] and (got[0] == got[1]).all()
    one = list(shingles.shingle_sets(pa.array(["pad pad", *texts]).slice(1)))
    assert all((a == b).all() for a, b in zip(got, one, strict=True))


# -- 6 ----------------------------------------------------------------------------


def test_pieces_match_the_library(spark, corpus):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    got = pieces.encode(corpus, piece_model(), ("n_tokens", "ids", "begins", "ends", "decoded", "ids_sha256", "covered")).collect()
    texts = defaultdict(list)
    for r in corpus.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    for r in got:
        text = texts[r["doc_id"]][0]
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == lib.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["covered"] == len(text.encode())
    assert pieces.encode(corpus.limit(0), piece_model()).count() == 0
    back = pieces.decode(spark.createDataFrame([(1, [1, 2]), (2, None)], "doc_id long, ids array<int>"), piece_model()).collect()
    assert [r["decoded"] for r in back] == ["", ""]


def with_map(rule, squeeze=False, dummy=True, symbols=()):
    """The dealt model with a public compiled map, and the library's tokenizer for it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, rules = pb.ModelProto(), pb.ModelProto()
    model.ParseFromString(piece_model())
    if rule:
        rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = squeeze, dummy
    for s in symbols:
        model.pieces.add(piece=s, score=0.0, type=pb.ModelProto.SentencePiece.USER_DEFINED)
    blob = model.SerializeToString()
    return pieces.OffsetTokenizer(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)


TEXTS = ["a  b", " é▁ü ", "\n\t", "日本 x", "😀!", "", "Ｈｅｌｌｏ   Wörld ﬁ ①  ", "e\u0301 A\u030a  ｶﾞ", "\u200b x \u00a0 y\u3000z", " ", "   ", "ΑΣ ς İ", "<tag> a<tag>b  ", "½ ㍿ … ", "\u0344 \u1e9b\u0323 \ufdfa"]


@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("dummy", [False, True])
def test_normaliser_matches_the_library(rule, squeeze, dummy):
    """Longest keys of compiled maps, squeezing and marks; spans against the library's own."""
    tok, lib = with_map(rule, squeeze, dummy, ("<tag>",))
    rng = np.random.default_rng(4)
    letters = sorted(set("".join(TEXTS)))
    for text in [*TEXTS, *("".join(rng.choice(letters, int(rng.integers(1, 30)))) for _ in range(300))]:
        normal, begin, end = tok.normalise(text)
        assert normal.decode() == lib.normalize(text), (text, rule)
        assert len(normal) == len(begin) == len(end) and (begin <= end).all() and (np.diff(begin) >= 0).all()
        ids = tok.encode([text])[0]
        begins, ends = tok.spans(text, ids)
        inner = lib.encode(text, return_type="proto").pieces
        for p, a, b in zip(inner, begins[1:-1].tolist(), ends[1:-1].tolist(), strict=True):
            # a piece with a part of a key spans the whole key here, and squeezed spaces are nobody's; the library gives them to the last piece before
            assert a == p.begin and (b == p.end or rule and b > p.end or squeeze and b < p.end) or lib.is_byte(p.id), (text, rule, p.piece)


def test_character_map_takes_the_longest_key():
    """A small map built by hand: ``a`` to ``x``, ``ab`` to ``yz``."""
    units = [0] * 512
    root, child = 0, 256
    units[root] = child << 10
    a = child ^ 0x61
    units[a] = 0x61 | 1 << 8 | (a ^ 0x180) << 10 | 0
    base = a ^ (a ^ 0x180)
    units[base] = 0x80000000 | 0
    ab = base ^ 0x62
    units[ab] = 0x62 | 1 << 8 | (ab ^ 0x10) << 10
    units[ab ^ (ab ^ 0x10)] = 0x80000000 | 2
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"x\0yz\0"
    m = pieces.CharacterMap(blob)
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"ba", 0) is None
    tok = pieces.OffsetTokenizer(piece_model())
    tok.map, tok.starts = m, m.starts
    normal, begin, end = tok.normalise("abac")
    assert normal == pieces.MARK + b"yzxc" and list(zip(begin, end, strict=True))[3:] == [(0, 2), (0, 2), (2, 3), (3, 4)]


# -- 7 ----------------------------------------------------------------------------


def test_url_lists(spark):
    captures = spark.createDataFrame([
        (1, "http://a.bad.org/x", 5), (2, "https://user@A.BAD.org:8080/y?z", 15), (3, "http://bad.org.", 25), (4, "http://ok.bad.org", 15), (5, "http://notbad.org", 15),
        (6, None, 15), (7, "no url", 15), (8, "http://bad.org", None), (9, "http://bad.org", 300), (9, "http://bad.org", 300), (10, "http:///path", 1)], "id long, url string, fetched long").withColumn("key", F.lit("clash"))
    entries = spark.createDataFrame([("bad.org", "block", 10), ("bad.org", "remove", 20), ("bad.org", "block", 290), ("ok.bad.org", "allow", 12), ("bad.org", None, 1), (None, "block", 1), ("org", "block", 28)], "key string, action string, listed long")
    got = {r["id"]: (r["matched"], r["blocked"]) for r in urls.evaluate(captures, entries).collect()}
    assert got == {1: (None, False), 2: ("bad.org", True), 3: (None, False), 4: ("ok.bad.org", False), 5: (None, False), 6: (None, False), 7: (None, False), 8: (None, False), 9: ("bad.org", True), 10: (None, False)}
    assert urls.evaluate(captures.limit(0), entries).count() == 0
    assert urls.evaluate(captures, entries.limit(0)).filter("blocked").count() == 0


def test_url_lists_know_deep_hosts(spark):
    deep = "l12.l11.l10.l9.l8.l7.l6.l5.l4.l3.l2.l1"
    captures = spark.createDataFrame([(1, f"http://{deep}/", 5), (2, f"http://x.{deep}/", 5), (3, f"http://y.{deep}/", 5), (4, f"http://z{deep}/", 5)], "id long, url string, fetched long")
    entries = spark.createDataFrame([(deep, "block", 1), (f"x.{deep}", "allow", 1)], "key string, action string, listed long")
    got = {r["id"]: (r["matched"], r["blocked"]) for r in urls.evaluate(captures, entries).collect()}
    assert got == {1: (deep, True), 2: (f"x.{deep}", False), 3: (deep, True), 4: (None, False)}


def test_url_lists_give_a_row_for_every_capture(spark):
    captures = spark.createDataFrame([(1, "http://a.org/x", 5), (1, "http://a.org/y", 5), (1, "http://a.org/y", 5), (2, None, 5), (2, None, 5)], "id long, url string, fetched long")
    entries = spark.createDataFrame([("a.org", "block", 1)], "key string, action string, listed long")
    got = sorted((r["id"], r["blocked"]) for r in urls.evaluate(captures, entries).collect())
    assert got == [(1, True), (1, True), (1, True), (2, False), (2, False)]


def plain_url_lists(captures, entries):
    out = []
    for i, url, at in captures:
        m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", url or "")
        host = re.sub(r"\.$", "", m.group(1).lower()) if m else ""
        best = None
        for key in {k for k, _, _ in entries if k}:
            dated = {}
            for k, action, day in entries:
                if k == key and action is not None and day is not None:
                    dated[day] = max(action, dated.get(day, ""))
            held = [d for d in dated if at is not None and d <= at]
            if held and dated[max(held)] != "remove" and (host == key or host.endswith("." + key)) and (best is None or len(key) > len(best[0])):
                best = key, dated[max(held)], max(held)
        out.append((i, best, bool(best) and best[1] == "block"))
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", [1, 2])
def test_url_lists_against_brute_force(spark, seed, monkeypatch):
    """Negative and late times, equal key and date with different actions, hot keys dealt out, very long URLs, clashing names."""
    monkeypatch.setattr(urls, "LOOKUPS", 3)
    rng = np.random.default_rng(seed)
    hosts = [".".join(rng.choice(["a", "b", "c", "d"], int(rng.integers(1, 5)))) for _ in range(40)]
    captures = [(int(k), f"http://{rng.choice(hosts)}/{'x' * (100_000 if k == 3 else 2)}", None if k % 17 == 0 else int(rng.integers(-900, 900))) for k in range(300)]
    entries = [(str(rng.choice(hosts)), str(rng.choice(["block", "allow", "remove"])), int(rng.integers(-1000, 1000))) for _ in range(120)]
    entries += [(hosts[0], "block", 5), (hosts[0], "remove", 5), (hosts[1], "allow", 7), (hosts[1], "block", 7), (None, "block", 0), (hosts[2], None, 0)]
    frame = spark.createDataFrame(captures, "id long, url string, fetched long").withColumns({"part": F.lit(1), "lot": F.lit(2), "best": F.lit(3)})
    found = urls.evaluate(frame, spark.createDataFrame(entries, "key string, action string, listed long")).collect()
    assert sorted(str((r["id"], (r["matched"], r["action"], r["since"]) if r["matched"] else None, r["blocked"])) for r in found) == plain_url_lists(captures, entries)


# -- 8 ----------------------------------------------------------------------------


def plain_neighbours(rows, queries, k):
    """``rows``: (id, vector); for each query (a place in rows) its k nearest as (id, score)."""
    out = []
    for q in queries:
        found = sorted((-float((v * rows[q][1]).sum()), i, n) for n, (i, v) in enumerate(rows) if n != q)[:k]
        out.append((rows[q][0], tuple((i, -s) for s, i, _ in found)))
    return sorted(out)


def found_neighbours(frame):
    out = defaultdict(dict)
    for r in frame.collect():
        out[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    return sorted((q, tuple(by[n] for n in sorted(by))) for q, by in out.items())


def test_neighbours(spark, monkeypatch):
    """All leaves visited: exact, on many leaves that are cut on both sides."""
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[40] = x[41] = x[60] = x[0]
    rows = [(k, [float(v) for v in x[k]]) for k in range(300)]
    bad = [(320, None), (340, [0.0] * 8), (360, [float("nan")] + [1.0] * 7), (380, [None] + [1.0] * 7), (420, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (400, [1.0])]
    frame = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>").withColumns({"leaf": F.lit(0), "row": F.lit(1)})
    y = [(i, np.array(v)) for i, v in rows]
    assert found_neighbours(neighbours.search(frame, Scratch(spark, "t8"), k=5, recall=1.0)) == plain_neighbours(y, range(0, 300, 20), 5)
    assert neighbours.search(frame.limit(0), Scratch(spark, "t8")).count() == 0
    assert neighbours.search(frame.filter("vec_id IN (20, 21)"), Scratch(spark, "t8")).count() == 1


def test_repeated_ids_are_queries_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [2.0, -1.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark, "t8b"), k=3, recall=1.0).collect()]
    assert sorted(got) == sorted([(20, 1, 8, 2.0), (20, 2, 7, 1.0), (20, 3, 7, 1.0), (20, 1, 7, 1.0), (20, 2, 7, 1.0), (20, 3, 20, 0.0)])


@pytest.mark.parametrize("kind", ["clusters", "sphere"])
def test_recall_on_queries_outside_the_calibration(spark, kind, monkeypatch):
    """5,000 vectors on twenty leaves or more; recall over all queries but the 32 that set the width."""
    monkeypatch.setattr(neighbours, "CALIBRATE", 32)
    monkeypatch.setattr(neighbours, "LEAF_SHARE", 0.5)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5000, 16))
    if kind == "clusters":
        x = 0.3 * x + rng.normal(size=(60, 16))[rng.integers(0, 60, 5000)]
    else:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert neighbours.fit_tree(x, int(0.5 * 5000**0.5)).leaves >= 20
    used = []
    monkeypatch.setattr(neighbours, "_calibrate", lambda placed, queries, *rest, f=neighbours._calibrate: (used.extend(queries["id"]), f(placed, queries, *rest))[1])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = dict(found_neighbours(neighbours.search(frame, Scratch(spark, "t8c"))))
    others = [q for q in range(0, 5000, 20) if q not in used]
    want = dict(plain_neighbours_fast(x, others, 20))
    assert len(used) == 32 and sorted(got) == list(range(0, 5000, 20))
    assert np.mean([len({v for v, _ in got[q]} & want[q]) / 20 for q in others]) >= 0.9


def plain_neighbours_fast(x, queries, k):
    products = x[queries] @ x.T
    products[np.arange(len(queries)), queries] = -np.inf
    return [(q, set(np.argsort(-products[n])[:k].tolist())) for n, q in enumerate(queries)]


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(0).normal(size=(500, 6))
    tree = neighbours.fit_tree(x, 20)
    assert sorted(tree.visit(x[0], tree.leaves)) == list(range(tree.leaves)) and len(set(tree.place(x))) > 10


# -- 9 ----------------------------------------------------------------------------


def test_preference_pairs(spark):
    rows = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", "why"),
            (2, "chosen", 0, "user", "same"), (2, "rejected", 5, "user", "same"), (3, "chosen", 0, None, None), (None, "chosen", 0, "user", "x"), (4, "other", 0, "user", "x")]
    got = {r["pair_id"]: r for r in chat.preference_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").withColumn("at", F.lit(0))).collect()}
    assert sorted(got) == [1, 2, 3]
    one = got[1]
    assert one["n_common"] == 1 and one["prompt"] == "<|user|>\nhi<|end|>\n"
    assert one["chosen"] == "<|assistant|>\nyes<|end|>\n" and one["rejected"] == "<|assistant|>\nno<|end|>\n<|user|>\nwhy<|end|>\n"
    assert [one["chosen"][m["begin"] : m["end"]] for m in one["chosen_mask"]] == ["yes<|end|>\n"]
    assert [one["rejected"][m["begin"] : m["end"]] for m in one["rejected_mask"]] == ["no<|end|>\n"]
    assert (got[2]["n_common"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "")
    assert (got[3]["prompt"], got[3]["chosen"], got[3]["rejected"]) == ("", "<|unknown|>\n<|end|>\n", "")
    assert [got[k]["usable"] for k in (1, 2, 3)] == [True, False, False]


def test_preference_pairs_of_long_and_repeated_turns(spark):
    long = "word " * 200_000
    rows = [(1, "chosen", 0, "user", long), (1, "rejected", 0, "user", long), (1, "chosen", 1, "assistant", long), (1, "chosen", 1, "assistant", "b"), (1, "rejected", 1, "assistant", "c")]
    frame = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")
    (one,) = chat.preference_pairs(frame).collect()
    assert one["n_common"] == 1 and len(one["prompt"]) == len(long) + 17 and one["chosen"].startswith("<|assistant|>\nb<|end|>") and len(one["chosen_mask"]) == 2 and one["usable"]
    assert chat.preference_pairs(frame.limit(0)).count() == 0


# -- 10 ---------------------------------------------------------------------------


def plain_counts(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f"_{word}_"
        for i in range(1, len(padded) - 1):
            out.update((padded[i], padded[i : i + 2], padded[i - 1 : i + 2]))
    return out


@pytest.mark.parametrize("text", ["Abc, abd!", "é1é  x", "a", "don't stop", "ß" * 40])
def test_ngram_counts(text):
    grams, counts = language.ngram_counts(text)
    assert len(set(grams.tolist())) == len(grams) and sorted(counts.tolist()) == sorted(plain_counts(text).values())


def test_language_id(spark):
    words = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "zwölf boxkämpfer jagen viktor quer".split()}
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(words["aa" if k % 2 else "bb"], 30)), "aa" if k % 2 else "bb", None, None) for k in range(60)]
    rows += [(100, None, "aa", None, None), (101, "", None, None, None), (102, "123 !?", "bb", None, None), (103, "lorem", None, None, None), (3, rows[3][1], "aa", None, None)]
    docs = table(spark, rows)
    profiles = language.learn_profiles(docs.filter("doc_id % 3 != 1"))
    got = defaultdict(list)
    for r in language.identify(docs, profiles).collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert all(x[0] == ("aa" if k % 2 else "bb") and 0 <= x[1] <= 1 for k in range(60) for x in got[k]) and len(got[3]) == 2
    assert got[100] == got[101] == got[102] == [("und", 0.0)] and got[103][0][0] == "aa"
    assert language.identify(docs, {}).filter("lang_pred != 'und'").count() == 0
    assert sorted(r["doc_id"] for r in language.identified_rows(docs, profiles).collect()) == sorted([*range(60), 103, 3])


def plain_profile(counts, size):
    """Most frequent first; ties by the code that orders n-grams in the library."""
    def code(gram):
        c = [0 if ch == "_" else ord(ch) for ch in gram]
        return {1: lambda: -c[0] - 1 - (1 << 42), 2: lambda: -((c[0] << 21) | c[1]) - 1, 3: lambda: (c[0] << 42) | (c[1] << 21) | c[2]}[len(gram)]()

    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def test_language_id_against_brute_force(spark):
    """Profiles, out-of-place distances, ties, long texts and clashing names."""
    size = 40
    rng = np.random.default_rng(8)
    letters = {"aa": "abcdef", "bb": "cdefgh", "cc": "xyzab"}
    rows = [(k, " ".join("".join(rng.choice(list(letters[lang]), int(rng.integers(1, 7)))) for _ in range(25)), lang) for k, lang in enumerate(sorted(letters) * 12)]
    rows += [(100, "abc " * 100_000, None), (101, "é1 ü", None), (102, "", "aa"), (103, None, None), (104, "zz zz", "cc"), (None, "ab", "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"gram": F.lit("x"), "n": F.lit(1), "lang_pred": F.lit("y"), "score": F.lit(None).cast("string")})
    known = {lang: plain_profile(sum((plain_counts(t) for _, t, x in rows if x == lang and t), Counter()), size) for lang in letters}
    want = []
    for i, t, _ in rows:
        mine = plain_profile(plain_counts(t or ""), size)
        far = sorted((sum(abs(r - known[x].index(g)) if g in known[x] else size for r, g in enumerate(mine)), x) for x in known)
        want.append((str(i), far[0][1] if mine else "und", round((far[1][0] - far[0][0]) / far[1][0], 9) if mine and far[1][0] else 0.0))
    profiles = language.learn_profiles(frame, size)
    got = language.identify(frame, profiles, size).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 9)) for r in got) == sorted(want)
    assert language.learn_profiles(frame.limit(0)) == {} and language.identify(frame.limit(0), profiles, size).count() == 0


def test_fold_is_crc32(spark):
    from clipsieve.llm.queries import _fold

    got = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", _fold(3).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in got)
