"""Toxicity by a weighted finite-state pattern grammar over clauses.

A chain of weighted transducers, each reading what the one before it writes: the
lexicon writes a class for each word (insult, threat, target, negation, reported
speech, pause), the next ones rewrite attacks as denied, reported or aimed, and the
last one weighs them. All but the lexicon, whose input is any word, are composed
into one machine. A text's score is the calibrated probability for its clauses' weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches

#: Labelled rows from which insult stems and calibration are learned, at most
#: (in expectation: rows are picked by a hash of their id).
TRAIN_ROWS = 20_000
#: Letters of a learned stem, at least.
STEM = 3

#: Closed classes of words, in the languages of the corpus; apostrophes are left out.
WORDS = {
    "threat": """kill kills killing hurt hurting beat destroy shoot stab burn strangle smash crush murder punish töte töten umbringen erschießen schlage schlagen verprügeln vernichten
        tuer tuerai frapper frapperai détruire écraser brûler matar mataré golpear golpearé destruir quemar aplastar apuñalar""",
    "target": """you your yours youre youve youll u ur he his she her they them their him himself herself themselves du dich dir dein deine ihr euch euer eure sie ihn ihm ihnen
        tu te toi ton ta tes vous votre vos il elle ils elles leur lui tú ti tus usted ustedes vosotros él ella ellos ellas les""",
    "negation": """not no never nobody none neither nor cannot isnt arent wasnt werent dont doesnt didnt wont wouldnt cant couldnt shouldnt aint hasnt havent hadnt without hardly
        nicht kein keine keinen keiner nie niemals niemand weder ne pas jamais aucun aucune personne sans nunca ni ningún ninguno ninguna nadie tampoco sin""",
    "report": """said says say saying told tells wrote writes called calls calling quoted quote quotes claims claimed reported accused shouted yelled heard
        sagte sagt sagten schrieb schreibt nannte nennt behauptet behauptete rief dit disait dirent écrit écrivait appelle appelait prétend cria
        dijo dice dijeron escribió escribe llamó llama afirma gritó""",
}
#: What the lexicon writes, and the classes that the others write besides.
TAGS = ("insult", "threat", "target", "negation", "report", "pause", "other")
CLASSES = (*TAGS, "denied", "reported", "aimed", "menace")
_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[,:]")


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][class] = (written class, next state, weight)``; a class without an arc is written as it is, at weight 0, and the state stays."""

    arcs: tuple[dict[str, tuple[str, int, float]], ...]

    def step(self, state: int, symbol: str) -> tuple[str, int, float]:
        return self.arcs[state].get(symbol, (symbol, state, 0.0))


def compose(left: Transducer, right: Transducer) -> Transducer:
    """The transducer that feeds what ``left`` writes to ``right``: it reads for the one and writes for the other; weights add."""
    index, queue, arcs = {(0, 0): 0}, [(0, 0)], []
    while len(arcs) < len(queue):
        a, b = queue[len(arcs)]
        out = {}
        for symbol in CLASSES:
            between, x, v = left.step(a, symbol)
            written, y, w = right.step(b, between)
            if (x, y) not in index:
                index[x, y] = len(queue)
                queue.append((x, y))
            out[symbol] = (written, index[x, y], v + w)
        arcs.append(out)
    return Transducer(tuple(arcs))


def _scope(words: int) -> Transducer:
    """A negation reaches over the next few words, not over a pause, and denies an attack there."""
    inside = ({"negation": ("negation", words, 0.0), "insult": ("denied", 0, 0.0), "threat": ("denied", 0, 0.0), "pause": ("pause", 0, 0.0),
               "other": ("other", k - 1, 0.0), "report": ("report", k - 1, 0.0)} for k in range(1, words + 1))
    return Transducer(({"negation": ("negation", words, 0.0)}, *inside))


#: The chain behind the lexicon. What follows a verb of speech is reported, also after a pause; an attack is aimed where a target comes
#: before it; at last attacks are weighed: state 0 is none yet, 1 an attack, 2 an aimed one, 3 a threat whose target may still come.
NEGATION = _scope(3)
REPORT = Transducer(({"report": ("report", 1, 0.0)}, {"insult": ("reported", 1, 0.0), "threat": ("reported", 1, 0.0)}))
AIM = Transducer(({"target": ("target", 1, 0.0)}, {"insult": ("aimed", 1, 0.0), "threat": ("menace", 1, 0.0)}))
WEIGHT = Transducer((
    {"insult": ("insult", 1, 1.0), "threat": ("threat", 3, 0.0), "aimed": ("aimed", 2, 1.5), "menace": ("menace", 2, 1.5), "denied": ("denied", 0, 0.25), "reported": ("reported", 0, 0.5)},
    {"insult": ("insult", 1, 0.5), "aimed": ("aimed", 2, 0.75), "menace": ("menace", 2, 0.75), "target": ("target", 2, 0.25), "threat": ("threat", 1, 0.25)},
    {"insult": ("insult", 2, 0.5), "aimed": ("aimed", 2, 0.5), "menace": ("menace", 2, 0.5), "threat": ("threat", 2, 0.25)},
    {"insult": ("insult", 1, 1.0), "target": ("menace", 2, 1.0), "aimed": ("aimed", 2, 1.5), "menace": ("menace", 2, 1.5), "denied": ("denied", 3, 0.25), "reported": ("reported", 3, 0.5)},
))
CHAIN = (NEGATION, REPORT, AIM, WEIGHT)
GRAMMAR = reduce(compose, CHAIN)


class Lexicon:
    """A transducer of one state that reads any word and writes its class, with the learned weight of an insult."""

    def __init__(self, insults: Iterable[tuple[str, float]]):
        self.weights = dict(insults)
        self.longest = max((len(s.rstrip("$")) for s in self.weights), default=0)
        self.words = {w: tag for tag, text in WORDS.items() for w in text.split()}

    def __call__(self, word: str) -> tuple[str, float]:
        if word in ",:":
            return "pause", 0.0
        if (w := self.weights.get(word + "$")) is not None:
            return "insult", w
        for n in range(min(self.longest, len(word)), 0, -1):
            if (w := self.weights.get(word[:n])) is not None:
                return "insult", w
        return self.words.get(word, "other"), 0.0

    def read(self, clause: str) -> Iterator[tuple[str, float]]:
        """The classes of a clause's words; a word with apostrophes is one if the lexicon has it without them, else its parts are."""
        for token in _TOKEN.findall(clause):
            parts = re.split("['’]", token)
            whole = "".join(parts)
            for word in [whole] if len(parts) == 1 or whole in self.words else parts:
                yield self(word)


class Reader:
    """Runs the grammar over the clauses that hold an attack."""

    def __init__(self, insults: Iterable[tuple[str, float]]):
        import ahocorasick

        self.lexicon = Lexicon(insults)
        self.attacks = ahocorasick.Automaton()
        for key in {s.rstrip("$") for s in self.lexicon.weights} | set(WORDS["threat"].split()):
            self.attacks.add_word(key, len(key))
        self.attacks.make_automaton()

    def clause(self, text: str) -> float:
        """The grammar's weight of one clause, more for insults that were learned as strong; 0 if nothing in it counts."""
        state, total, lexical = 0, 0.0, 0.0
        for tag, weight in self.lexicon.read(text):
            _, state, w = GRAMMAR.step(state, tag)
            total += w
            lexical = max(lexical, weight * min(1.0, w))
        return total * (1.0 + max(0.0, lexical) / 10.0)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Of a whole text: log of the clauses' summed weight, the largest weight, and log of the matched clauses in a hundred words."""
        lower = (text or "").lower()
        spots = [end - n + 1 for end, n in self.attacks.iter(lower)] if len(self.attacks) and lower else []
        spots = [s for s in spots if not s or not lower[s - 1].isalpha()]
        if not spots:
            return 0.0, 0.0, 0.0
        found, at, k = [], 0, 0
        for stop in _CLAUSE.finditer(lower + "\n"):
            hit = False
            while k < len(spots) and spots[k] < stop.start():
                hit |= spots[k] >= at
                k += 1
            if hit:
                found.append(self.clause(lower[at : stop.start()]))
            at = stop.end()
            if k == len(spots):
                break
        found = [x for x in found if x > 0]
        if not found:
            return 0.0, 0.0, 0.0
        return math.log1p(sum(found)), max(found), math.log1p(100.0 * len(found) / max(1, lower.count(" ")))


@lru_cache(maxsize=2)
def _reader(insults: tuple[tuple[str, float], ...]) -> Reader:
    return Reader(insults)


def training_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic`` of at most ``rows`` labelled documents, each text once.

    A document labelled more than once is toxic if any label says so. The picked
    ids (bounded by ``rows``) are broadcast, so no text is shuffled for the join.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n = known.count()
    known = known.filter(F.crc32(F.md5(F.col("doc_id").cast("string"))) < int(2**32 * min(1.0, rows / max(1, n))))
    picked = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return scratch.write(picked.groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("key"), "train")


def learn_insults(train: DataFrame) -> tuple[tuple[str, float], ...]:
    """Word beginnings and words (ending in ``$``) that mark toxic texts, with weights (log odds).

    The unit of evidence is a distinct context (word before and after), so that a
    text which was copied with small changes counts once for what it says. A
    stem is taken if its contexts' likelihood ratio against the share of toxic
    words is beyond what the number of candidates makes likely by chance, and it
    occurs in three texts at least; a stem excludes those that it begins or that begin it.
    Candidates come from the bounded training rows only, so they fit the driver.
    """
    schema = T.StructType([T.StructField("stem", T.StringType()), T.StructField("context", T.LongType()), T.StructField("toxic", T.BooleanType()), T.StructField("text_id", T.LongType())])
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    toxic_share = train.groupBy("toxic").agg(F.sum(F.size(words)).alias("n")).collect()
    share = {r["toxic"]: r["n"] for r in toxic_share}
    if not share.get(True) or not share.get(False):
        return ()
    base = share[True] / (share[True] + share[False])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows: set[tuple[str, int, bool, int]] = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, own = _WORD.findall(text.lower()), xxhash.xxh64_intdigest(text) >> 1
                for k, word in enumerate(found):
                    if toxic and len(word) >= STEM:
                        context = xxhash.xxh64_intdigest(f"{found[k - 1] if k else ''} {found[k + 1] if k + 1 < len(found) else ''}") >> 1
                        rows.add((word + "$", context, toxic, own))
                        rows.update((word[:n], context, toxic, own) for n in range(STEM, len(word) + 1))
            for lot in _lots(list(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lot, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], schema.names)

    counted = train.select("text", "toxic").mapInArrow(contexts, schema).groupBy("stem").agg(
        F.countDistinct("context").alias("a"), F.countDistinct("text_id").alias("texts")).filter("a >= 4 AND texts >= 3")
    counted = counted.persist()
    many = counted.count()
    enough = math.log(max(many, 2)) + 3
    alone = {r["stem"]: r["a"] for r in counted.filter(F.col("a") * -math.log(base) >= enough).select("stem", "a").collect()}
    counted.unpersist()
    clean = _clean_counts(train.filter(~F.col("toxic")), alone)
    scored = []
    for stem, a in alone.items():
        b = clean.get(stem, 0)
        rate = a / (a + b)
        ratio = a * math.log(rate / base) + (b * math.log((1 - rate) / (1 - base)) if b else 0.0)
        if rate > max(0.5, base) and ratio >= enough:
            scored.append((ratio, len(stem), stem, math.log((a + 0.5) / (b + 0.5)) - math.log(base / (1 - base))))
    scored.sort(key=lambda x: (-x[0], -x[1], x[2]))
    taken: dict[str, float] = {}
    begun: set[str] = set()
    for _, _, stem, weight in scored:
        word = stem.rstrip("$")
        if word not in begun and not any(word[:n] in taken for n in range(1, len(word) + 1)) and word + "$" not in taken:
            taken[stem] = weight
            begun.update(word[:n] for n in range(1, len(word) + 1))
    return tuple(sorted(taken.items()))


def _clean_counts(clean: DataFrame, stems: dict[str, int]) -> dict[str, int]:
    """Occurrences in clean texts of each of ``stems``."""
    wanted = frozenset(stems)
    schema = T.StructType([T.StructField("stem", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in _WORD.findall(text.lower()):
                    for stem in (word + "$", *(word[:n] for n in range(STEM, len(word) + 1))):
                        if stem in wanted:
                            found[stem] = found.get(stem, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema.names)

    return {r["stem"]: r["n"] for r in clean.select("text").mapInArrow(count, schema).groupBy("stem").agg(F.sum("n").alias("n")).collect()}


def _lots(rows: list, size: int) -> Iterator[list]:
    for lo in range(0, len(rows), size):
        yield rows[lo : lo + size]


@dataclass(frozen=True)
class Model:
    """Insult stems with weights, and the calibration: bias and a weight for each feature."""

    insults: tuple[tuple[str, float], ...]
    bias: float
    slope: tuple[float, ...]

    def score(self, features: tuple[float, ...]) -> float:
        x = self.bias + sum(w * f for w, f in zip(self.slope, features, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (bias first) by Newton's method, lightly regularised."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * max(1.0, len(y) / 100.0))
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_model(train: DataFrame) -> Model:
    """Learns stems and calibration from ``text, toxic`` rows (their number is bounded, so the features fit the driver).

    Without rows of both labels nothing is learned: the grammar then has its
    closed classes only, and its calibration is fixed.
    """
    insults = learn_insults(train)
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in ("a", "b", "c", "y")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(insults)
        for batch in batches:
            rows = [(*reader.features(t), float(y)) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)], schema.names)

    data = np.array([tuple(r) for r in train.select("text", "toxic").mapInArrow(features, schema).collect()], float).reshape(-1, 4)
    if len(set(data[:, 3])) < 2:
        return Model(insults, -3.0, (2.0, 0.0, 0.0))
    bias, *slope = fit_logistic(data[:, :3], data[:, 3])
    return Model(insults, float(bias), tuple(map(float, slope)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted, clauses_weight, strongest`` for every row of ``docs``.

    Whole texts are read. Null and empty texts have no clause and get the score
    of a text without attacks. Repeated rows give repeated rows, an empty table
    none; no other column is read. The model (some KB) goes with the tasks; no shuffle.
    """
    bound_batches(docs.sparkSession)
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("clauses_weight", T.DoubleType()), T.StructField("strongest", T.DoubleType()),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model.insults)
        for batch in batches:
            found = [reader.features(t) for t in batch.column(1).to_pylist()]
            scores = [model.score(f) for f in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                pa.array([math.expm1(f[0]) for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()),
            ], schema.names)

    return docs.select(id_col, text_col).mapInArrow(rows, schema)
