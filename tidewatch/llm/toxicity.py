"""Toxicity: a weighted finite-state pattern grammar that scores matched clauses rather than isolated words.

Six transducers form a chain; each reads the symbols that the one before writes. The first reads a clause from its end, the
others, composed into one machine, from its beginning:

- target behind: writes an attack before a person or group ("kill you") as an aimed one;
- negation: opens a scope of three tokens and writes what follows in it as a milder attack ("not stupid");
- reported speech: discounts the attacks in the rest of the clause ("said", "called", an opening quote);
- target: a person or group was addressed ("you idiot"), which aims the attacks behind it; aimed attacks weigh more, and threats
  without target less;
- insult and threat: the first of a kind counts in full, further ones of the clause more, and milder ones half.

An attack's score is its term's weight times the weights of the arcs that it takes.

A clause ends at punctuation or a line break. Insults are seed terms plus word prefixes learned from labelled documents
by their log odds, which also covers languages without a seed list. A logistic layer turns a document's clause scores
into a probability.

Null and empty texts have no clause and get the score of a document without matches. Without labels of both kinds the
seed terms and a default layer are used. Labels of repeated ids count once; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, written

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END, MILD_INSULT, MILD_THREAT, AIMED_INSULT, AIMED_THREAT, MILD_AIMED_INSULT, MILD_AIMED_THREAT = range(13)
SYMBOLS = 13
#: An attack as an aimed one, as a milder one, and without its aim.
AIMED = {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT, MILD_INSULT: MILD_AIMED_INSULT, MILD_THREAT: MILD_AIMED_THREAT}
MILDER = {INSULT: MILD_INSULT, THREAT: MILD_THREAT, AIMED_INSULT: MILD_AIMED_INSULT, AIMED_THREAT: MILD_AIMED_THREAT}
PLAIN = {aimed: attack for attack, aimed in AIMED.items()}

SEED_INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns imbecile vermin dumbass bastard cretin".split()
SEED_THREATS = "kill murder hurt destroy strangle stab shoot beat punish hunt burn".split()
TARGETS = "you your yours u they them those these he she him her people everyone du dich ihr euch tu te vous ils elles tú ti ustedes ellos".split()
NEGATIONS = "not no never isn't aren't don't doesn't wasn't nicht kein keine nie pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says say claimed called calls quoted quote wrote writes according reportedly alleged sagte nannte dit disait appelé dijo llamó según".split()

EDGE = "\"'“”«»()[]{}*_~`.,;:!?…|-–—%$&#"
BREAKS = tuple(".,;:!?…")


class Transducer:
    """arcs[state, symbol] = (next state, symbol written, weight). A symbol without arc is written as it is, with weight 1,
    and the state stays, or changes as `idle` says. END leads back to the start."""

    def __init__(self, states: int, arcs: dict[tuple[int, int], tuple[int, int, float]], idle: dict[int, int] | None = None):
        self.states, self.arcs, self.idle = states, arcs, idle or {}

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        if symbol == END:
            return 0, END, 1.0
        return self.arcs.get((state, symbol), (self.idle.get(state, state), symbol, 1.0))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that hands what the first writes to the second; state s * second.states + t stands for both."""
    arcs = {}
    for s, t in product(range(first.states), range(second.states)):
        for symbol in range(SYMBOLS):
            after, written_, w = first.step(s, symbol)
            then, out, v = second.step(t, written_)
            arcs[s * second.states + t, symbol] = (after * second.states + then, out, w * v)
    return Transducer(first.states * second.states, arcs)


def target_behind() -> Transducer:
    """Reads a clause from its end."""
    return Transducer(2, {(0, TARGET): (1, TARGET, 1.0)} | {(1, attack): (1, AIMED[attack], 1.0) for attack in (INSULT, THREAT)})


def grammar() -> tuple[list[list[int]], list[list[float]]]:
    """The composed machine as tables next[state][symbol], weight[state][symbol]; state 0 is the start."""
    attacks = (*AIMED, *PLAIN)
    # State n > 0: n more tokens in the scope of a negation.
    negation = Transducer(4, {(s, NEGATION): (3, OTHER, 1.0) for s in range(4)} | {(s, a): (s - 1, mild, 1.0) for s in (1, 2, 3) for a, mild in MILDER.items()}, {1: 0, 2: 1, 3: 2})
    report = Transducer(2, {(0, REPORT): (1, OTHER, 1.0)} | {(1, a): (1, a, 0.6) for a in attacks})
    aimed = {(s, a): (s, plain, 1.3) for s in (0, 1) for a, plain in PLAIN.items()}
    target = Transducer(2, {(0, TARGET): (1, OTHER, 1.0)} | aimed | {(0, a): (0, a, 0.4) for a in (THREAT, MILD_THREAT)} | {(1, a): (1, a, 1.3) for a in AIMED})
    kind = lambda full, mild: Transducer(2, {(0, full): (1, full, 1.0), (1, full): (1, full, 1.2), (0, mild): (1, mild, 0.5), (1, mild): (1, mild, 0.6)})
    machine = reduce(compose, (negation, report, target, kind(INSULT, MILD_INSULT), kind(THREAT, MILD_THREAT)))
    steps = [[machine.step(state, symbol) for symbol in range(SYMBOLS)] for state in range(machine.states)]
    return [[s for s, _, _ in row] for row in steps], [[w for _, _, w in row] for row in steps]


@dataclass
class Model:
    """Learned terms: whole words and prefixes with weights; the logistic layer over the clause features."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_INSULTS, 3.0))
    prefixes: dict[str, float] = field(default_factory=dict)
    layer: list[float] = field(default_factory=lambda: [-3.0, 1.0, 0.5, 0.5])

    def lookup(self) -> dict[str, tuple[int, float]]:
        table: dict[str, tuple[int, float]] = {}
        for words, kind, weight in ((TARGETS, TARGET, 0.0), (NEGATIONS, NEGATION, 0.0), (REPORTS, REPORT, 0.0), (SEED_THREATS, THREAT, 0.5)):
            table |= {w: (kind, weight) for w in words}
        return table | {w: (INSULT, weight) for w, weight in self.words.items()}


PREFIXES = range(4, 9)


def terms(word: str) -> list[str]:
    """What is learned about a word: itself, marked by a trailing blank, and its prefixes."""
    return [word + " ", *(word[:k] for k in PREFIXES if len(word) >= k)]


class Scorer:
    """Walks the composed machine over a document's tokens; remembers at most KEPT distinct tokens."""

    KEPT = 200_000

    def __init__(self, model: Model):
        self.table, self.prefixes = model.lookup(), model.prefixes
        self.lengths = sorted({len(p) for p in model.prefixes})
        self.nexts, self.factors = grammar()
        self.behind = target_behind()
        self.seen: dict[str, tuple[int, float, bool]] = {}

    def token(self, raw: str) -> tuple[int, float, bool]:
        """(class, weight, whether the clause ends after it)."""
        word = raw.strip(EDGE)
        found = self.table.get(word)
        if found is None:
            weight = max((self.prefixes[word[:k]] for k in self.lengths if word[:k] in self.prefixes), default=0.0)
            found = (INSULT, weight) if weight else (OTHER, 0.0)
        if raw.startswith(("“", "«", '"')) and found[0] == OTHER:
            found = (REPORT, 0.0)
        got = (*found, raw.endswith(BREAKS))
        if len(self.seen) >= self.KEPT:
            self.seen.clear()
        self.seen[raw] = got
        return got

    def clause(self, tokens: list[tuple[int, float]]) -> float:
        """The score of a clause: once over its symbols from the end, once from the beginning."""
        if not any(weight for _, weight in tokens):
            return 0.0
        symbols, state = [], 0
        for label, _ in reversed(tokens):
            state, label, _ = self.behind.step(state, label)
            symbols.append(label)
        state, score = 0, 0.0
        for label, (_, weight) in zip(reversed(symbols), tokens):
            score += weight * self.factors[state][label]
            state = self.nexts[state][label]
        return score

    def features(self, text: str) -> tuple[float, float, float]:
        """log1p of the sum, and the largest, of the clause scores; log1p of the number of matched clauses."""
        seen, token = self.seen, self.token
        clauses: list[float] = []
        for line in text.lower().split("\n"):
            classes = [seen.get(raw) or token(raw) for raw in line.split()]
            if not any(c[0] == INSULT or c[0] == THREAT for c in classes):
                continue
            clause: list[tuple[int, float]] = []
            for label, weight, ends in classes:
                clause.append((label, weight))
                if ends:
                    clauses.append(self.clause(clause))
                    clause = []
            clauses.append(self.clause(clause))
        clauses = [c for c in clauses if c]
        return math.log1p(sum(clauses)), max(clauses, default=0.0), math.log1p(len(clauses))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: per batch and term the toxic and clean documents that hold it, and one row (null term) of totals."""
    for batch in batches:
        counts: dict[str | None, list[int]] = {None: [0, 0]}
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            words = {w.strip(EDGE) for w in set(text.lower().split())}
            for term in {t for w in words if 3 <= len(w) <= 40 for t in terms(w)} | {None}:
                counts.setdefault(term, [0, 0])[0 if y else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["term", "toxic", "clean"])


def _learn_terms(sample: DataFrame, most: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and prefixes whose log odds of toxic over clean documents are high; at most `most` terms reach the driver."""
    counts = sample.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counts = written(counts.where("t >= 3 or term is null"), "term-counts")
    total = counts.where("term is null").first()
    words = dict.fromkeys(SEED_INSULTS, 3.0)
    if total is None or not total["t"] or not total["c"]:
        return words, {}
    toxic, clean = total["t"], total["c"]
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    least = max(3.0, 0.02 * toxic)
    # How much more often than by chance, in deviations; ranks terms by how much they explain.
    gain = (F.col("t") - F.col("c") * (toxic / clean)) / F.sqrt(F.col("t") + F.col("c") * (toxic / clean) ** 2)
    good = counts.where(F.col("term").isNotNull() & (F.col("t") >= least)).withColumn("w", odds).where("w >= 1.5").withColumn("gain", gain)
    found = good.orderBy(F.desc("gain"), F.length("term"), "term").limit(most).collect()
    prefixes: dict[str, float] = {}
    for row in found:
        term, weight = row["term"], min(6.0, row["w"])
        if term.endswith(" "):
            if not any(term.startswith(p) for p in prefixes):
                words[term[:-1]] = weight
        elif not any(term.startswith(p) or p.startswith(term) for p in prefixes) and not any(w.startswith(term) for w in words):
            prefixes[term] = weight
    return words, prefixes


def _fit_layer(x: np.ndarray, y: np.ndarray, steps: int = 60) -> list[float]:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def fit(docs: DataFrame, labels: DataFrame, rows: int = 12_000, most: int = 2_000, folds: int = 4, held_out: int = 2) -> Model:
    """Learns terms and layer from at most `rows` labelled documents outside the held-out fold."""
    sample = written(labelled_sample(docs, labels, "toxic", folds, held_out, rows), "toxicity-sample")
    model = Model()
    model.words, model.prefixes = _learn_terms(sample, most)

    def featured(batches):
        scorer = Scorer(model)
        for batch in batches:
            rows = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(3))], names=["doc_id", "y", "f0", "f1", "f2"])

    table = sample.mapInArrow(featured, "doc_id long, y int, f0 double, f1 double, f2 double").orderBy("doc_id", "f0", "f1").toPandas()
    y = (table["y"].to_numpy() > 0).astype(float)
    if len(y) and 0 < y.sum() < len(y):
        model.layer = _fit_layer(table[["f0", "f1", "f2"]].to_numpy(), y)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, whole texts."""

    def run(batches):
        scorer = Scorer(model)
        bias, *weights = model.layer
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                logit = bias + sum(w * f for w, f in zip(weights, scorer.features(text.as_py() or "")))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score is below the threshold, all columns, in one pass without a shuffle."""
    schema = docs.schema

    def run(batches):
        scorer = Scorer(model)
        bias, *weights = model.layer
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                logit = bias + sum(w * f for w, f in zip(weights, scorer.features(text.as_py() or "")))
                keep.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
