"""Toxicity by a weighted finite-state pattern grammar.

Every token becomes a symbol (insult, threat, target, negation, report, clause end, other).  Small transducers each read
the symbols and keep one fact about the clause; their composition is one machine, tabulated once, whose states at a
clause's end name the pattern that the clause matched (a directed threat, an insult under negation, ...).  A document's
score is a logistic function of its matched patterns.  Pattern weights and the insults of languages without a word list
are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices, small_batches, table

# Seed words of each class.
INSULTS = """idiot idiots moron morons scum trash worthless clown loser losers stupid disgusting pathetic imbecile vermin
filth bastard bitch asshole dumbass retard idiota imbécil estúpido basura escoria perdedor payaso idiote imbécile débile
ordure racaille minable crétin dummkopf abschaum versager trottel widerlich erbärmlich schwachkopf""".split()
THREATS = """kill hurt destroy beat punch stab shoot burn hang murder smash matar golpear destruir quemar tuer frapper
détruire brûler töten schlagen vernichten verbrennen""".split()
TARGETS = """you your yours u they them he she him her everyone people tú usted ustedes vosotros tu vous toi ils elles
du dich dir ihr euch sie""".split()
NEGATIONS = "not no never don't isn't aren't wasn't nobody none nunca jamás ne pas jamais nicht kein keine nie".split()
REPORTS = """said says say wrote writes called calls claimed quoted reported reports according dijo dice escribió
llamó dit écrit appelé sagte sagt schrieb nannte""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")
#: Tokens after a negation that it covers.
NEGATION_REACH = 4

#: At most so many labelled rows (those with the least hash of their id) teach the lexicon and the weights.
MAX_LABELLED = 20_000
#: A learned insult is in this share of the toxic sample and in this many texts at least, and is so much likelier there.
MIN_SHARE, MIN_TEXTS, MIN_ODDS = 0.004, 6, 12.0
MAX_LEARNED = 5_000


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``step(state, symbol) -> state``; ``final`` says what a clause that ends in a state contributes."""

    start: int
    states: int
    step: object
    final: object


def _insult() -> Transducer:
    return Transducer(0, 2, lambda s, x: 1 if x == INSULT else s, lambda s: {"insult"} if s else set())


def _threat() -> Transducer:
    return Transducer(0, 2, lambda s, x: 1 if x == THREAT else s, lambda s: {"threat"} if s else set())


def _target() -> Transducer:
    return Transducer(0, 2, lambda s, x: 1 if x == TARGET else s, lambda s: {"directed"} if s else set())


def _negation() -> Transducer:
    """States 0..reach: tokens that the last negation still covers; reach+1 absorbs: it covered an insult or a threat."""
    hit = NEGATION_REACH + 1

    def step(s, x):
        if s == hit or (s and x in (INSULT, THREAT)):
            return hit
        return NEGATION_REACH if x == NEGATION else max(0, s - 1)

    return Transducer(0, hit + 1, step, lambda s: {"negated"} if s == hit else set())


def _report() -> Transducer:
    """1: reported speech began; 2: an insult or a threat came after it."""
    return Transducer(0, 3, lambda s, x: 1 if x == REPORT and s == 0 else 2 if s == 1 and x in (INSULT, THREAT) else s, lambda s: {"reported"} if s == 2 else set())


class Machine:
    """Composition of transducers over the same symbols, tabulated over their product states."""

    def __init__(self, parts: list[Transducer]):
        sizes = [p.states for p in parts]
        number = {s: i for i, s in enumerate(product(*map(range, sizes)))}
        self.start = number[tuple(p.start for p in parts)]
        self.table = [[number[tuple(p.step(a, x) for p, a in zip(parts, s))] for x in range(END)] for s in number]
        self.pattern = [pattern_of(set().union(*[p.final(a) for p, a in zip(parts, s)])) for s in number]

    def clauses(self, symbols):
        """The pattern of each clause that matched one."""
        state = self.start
        for x in symbols:
            if x == END:
                if (p := self.pattern[state]) is not None:
                    yield p
                state = self.start
            else:
                state = self.table[state][x]
        if (p := self.pattern[state]) is not None:
            yield p


PATTERNS = ["insult", "directed insult", "threat", "negated", "reported"]
#: Weights before any label is seen, of the intercept and of log(1 + count) of each pattern: one clause that aims an insult
#: or a threat at someone decides, one insult without a target does not.
PRIOR = np.array([-3.0, 2.0, 5.5, 5.5, 0.3, 0.3])


def pattern_of(facts: set[str]) -> int | None:
    """A threat without a target, or a target without either, is no pattern; negation and report outrank the rest."""
    if not ("insult" in facts or {"threat", "directed"} <= facts):
        return None
    if "negated" in facts:
        return 3
    if "reported" in facts:
        return 4
    if "insult" in facts:
        return 1 if "directed" in facts else 0
    return 2


MACHINE = Machine([_insult(), _threat(), _target(), _negation(), _report()])


def lexicon(learned: list[str] = ()) -> dict[str, int]:
    words = {}
    for kind, group in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, [*INSULTS, *learned])):
        words |= dict.fromkeys(group, kind)
    return words | dict.fromkeys(".!?;:\n", END)


def features(texts, words: dict[str, int], machine: Machine = MACHINE) -> np.ndarray:
    """Per text: 1 and log(1 + matched clauses) of each pattern."""
    bad = {w for w, k in words.items() if k in (INSULT, THREAT)}
    get = words.get
    out = np.zeros((len(texts), 1 + len(PATTERNS)))
    out[:, 0] = 1
    for i, text in enumerate(texts):
        if text:
            tokens = TOKEN.findall(text.lower())
            if not bad.isdisjoint(tokens):
                for p in machine.clauses([get(t, OTHER) for t in tokens]):
                    out[i, 1 + p] += 1
    out[:, 1:] = np.log1p(out[:, 1:])
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 0.5, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to PRIOR; without rows, PRIOR itself."""
    w = PRIOR.copy()
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn_insults(sample: DataFrame) -> list[str]:
    """Words of the sample (text, toxic) that mark toxic texts, by document frequency over distinct texts."""
    total = {bool(r[0]): r[1] for r in sample.groupBy((F.col("toxic") == 1).alias("t")).agg(F.countDistinct(F.xxhash64("text"))).collect()}
    toxic, clean = total.get(True, 0), total.get(False, 0)
    if not toxic:
        return []
    once = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    words = once.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word"))
    counts = words.where(F.length("word") > 1).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = ((F.col("t") + 0.1) / (toxic + 0.2)) / ((F.col("c") + 0.1) / (clean + 0.2))
    found = counts.where((F.col("t") >= max(MIN_TEXTS, MIN_SHARE * toxic)) & (odds >= MIN_ODDS))
    return sorted(r["word"] for r in found.orderBy(odds.desc(), "word").limit(MAX_LEARNED).select("word").collect())


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray

    def score(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(texts, self.words) @ self.weights, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from labelled rows outside the held-out fold; null labels and rows without a document teach nothing."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled)
    # at most max_labelled ids and labels are broadcast
    sample = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "toxic").persist()
    words = lexicon(learn_insults(sample))

    def measure(batches):
        import pyarrow as pa

        for b in batches:
            x = features(b.column(0).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(1).to_numpy().astype("int64")), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    found = sample.mapInArrow(measure, "y long, x array<double>").groupBy("y", "x").count().collect()
    sample.unpersist()
    n = np.array([r["count"] for r in found])
    x = np.repeat(np.array([r["x"] for r in found]).reshape(-1, len(PRIOR)), n, axis=0) if found else np.empty((0, len(PRIOR)))
    return Model(words, fit_weights(x, np.repeat(np.array([r["y"] for r in found], float), n) if found else np.empty(0)))


def score_documents(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; null and empty texts score like any text without a match."""
    small_batches(docs.sparkSession)
    if out in docs.columns:
        raise ValueError(f"column already present: {out}")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(b.column(at).to_pylist()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score every whole text; ``predicted`` is 1 from a score of 0.5."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scoring below 0.5 stay."""
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_documents(docs, model, out="toxicity_score").where("toxicity_score < 0.5").drop("toxicity_score")
