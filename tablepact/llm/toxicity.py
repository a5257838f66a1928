"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as symbols: insults (words and word beginnings, learned from labels), threats, targets, negations and words of
report. Five transducers read a clause one after another, and each passes on every symbol, marked and weighted: ``insults`` and
``threats`` give the matches their weight, ``targets`` tells whether the clause has a target, before a match or after it (it
guesses that at the start and accepts the clause if the guess was right), ``negations`` discounts matches that a negation
reaches, and ``reports`` those that follow a word of report. ``compose`` makes one transducer of them, which is tabled and run.
Its outputs are matches such as "insult, at a target, not negated, not reported". A text's score is a logistic function of how
often it has each of them; weights are fitted to labels from a prior, the weights of the grammar.

Clauses end at ``. ! ?`` and line ends, and are read whole; ``, ; :`` end what a negation reaches, but neither a report nor a
target. Null and empty texts match nothing and get the score of a text without matches. Without labels of both kinds the
prior's weights and the given words are used. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, only_new, sliced, unused
from .ordinal import OrdinalModel, fit, sample

#: Words of the grammar's closed classes in English, German, French and Spanish.
THREATS = "kill killing murder hurt destroy shoot stab beat strangle burn töten umbringen verletzen erschießen erstechen verprügeln tuer frapper blesser égorger matar golpear herir apuñalar".split()
TARGETS = "you your yours yourself he she they them him her his their this these those du dich dir dein deine ihr euch euer sie ihn ihm ihnen tu toi te ton ta tes vous votre vos il elle ils elles lui leur tú ti te tu usted ustedes vosotros ellos ellas él ella".split()
NEGATIONS = "not never no neither nor isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't couldn't nicht kein keine keinen nie niemals ne pas jamais aucun aucune no nunca jamás ningún ninguna".split()
REPORTS = "said says saying wrote writes writing called calls quoted quotes reported reports according claimed claims sagte sagt sagten schrieb schreibt nannte nennt zitierte laut dit disait écrit écrivait appelé cité selon dijo dice escribió llamó citó según".split()
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[,;:]")
CLAUSE = re.compile(r"[.!?\n]+")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, PAUSE = range(7)
#: Lengths of the word beginnings that are looked at, and the mark of a whole word.
STEM, END = (4, 7), "$"
#: A negation reaches over so many words.
REACH = 3
SAMPLE, ROUNDS = 20_000, 25
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Symbol:
    kind: int
    target: int = 0
    negated: int = 0
    reported: int = 0

    @property
    def match(self) -> bool:
        return self.kind in (INSULT, THREAT)


#: Outputs of the grammar; a text has a count of each, and the constant.
OUTPUTS = [Symbol(*x) for x in product((INSULT, THREAT), (0, 1), (0, 1), (0, 1))]
SIZE = len(OUTPUTS) + 1
ALPHABET = [*(Symbol(k) for k in range(7) if k not in (INSULT, THREAT)), *OUTPUTS]
State = Any
Arc = tuple[State, Symbol, float]


@dataclass(frozen=True)
class Transducer:
    """``arcs``: by state and symbol, the next state, the symbol given out and the factor of its weight; none where it stops."""

    start: tuple[State, ...]
    final: frozenset[State]
    arcs: dict[tuple[State, Symbol], tuple[Arc, ...]]

    def outputs(self, clause: list[tuple[Symbol, float]]) -> list[list[tuple[Symbol, float]]]:
        """What each accepted path through the clause gives out."""
        paths: list[tuple[State, tuple]] = [(s, ()) for s in self.start]
        for symbol, weight in clause:
            paths = [(t, (*out, (b, weight * w))) for s, out in paths for t, b, w in self.arcs.get((s, symbol), ())]
        return [list(out) for s, out in paths if s in self.final]


def machine(start: tuple[State, ...], final: set[State], step: Callable[[State, Symbol], Arc | None]) -> Transducer:
    """The transducer whose arcs ``step`` gives, over every state that can be reached."""
    arcs: dict[tuple[State, Symbol], tuple[Arc, ...]] = {}
    todo, seen = list(start), set(start)
    while todo:
        s = todo.pop()
        for a in ALPHABET:
            if (arc := step(s, a)) is not None:
                arcs[s, a] = (arc,)
                if arc[0] not in seen:
                    seen.add(arc[0])
                    todo.append(arc[0])
    return Transducer(start, frozenset(final), arcs)


def insults(weight: float = 3.0) -> Transducer:
    return machine((0,), {0}, lambda s, a: (0, a, weight if a.kind == INSULT else 1.0))


def threats(weight: float = 1.5) -> Transducer:
    return machine((0,), {0}, lambda s, a: (0, a, weight if a.kind == THREAT else 1.0))


def targets(untargeted_threat: float = 0.0) -> Transducer:
    """Guesses at the start that there is a target, and must see one, or that there is none, and must not."""

    def step(s: str, a: Symbol) -> Arc | None:
        if a.kind == TARGET:
            return None if s == "none" else ("seen", a, 1.0)
        if not a.match:
            return s, a, 1.0
        return s, replace(a, target=int(s != "none")), untargeted_threat if s == "none" and a.kind == THREAT else 1.0

    return machine(("none", "awaited"), {"none", "seen"}, step)


def negations(reach: int = REACH, factor: float = 0.2) -> Transducer:
    """The state is the number of words that a negation still reaches."""

    def step(s: int, a: Symbol) -> Arc:
        after = reach if a.kind == NEGATION else 0 if a.kind == PAUSE else max(0, s - 1)
        return (after, replace(a, negated=1), factor) if a.match and s else (after, a, 1.0)

    return machine((0,), set(range(reach + 1)), step)


def reports(factor: float = 0.3) -> Transducer:
    return machine((0,), {0, 1}, lambda s, a: (int(s or a.kind == REPORT), replace(a, reported=1) if a.match and s else a, factor if a.match and s else 1.0))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that gives what ``second`` makes of the outputs of ``first``; weights multiply."""
    start = tuple(product(first.start, second.start))
    arcs: dict[tuple[State, Symbol], tuple[Arc, ...]] = {}
    todo, seen = list(start), set(start)
    while todo:
        s, t = todo.pop()
        for a in ALPHABET:
            made = tuple(((s2, t2), c, v * w) for s2, b, v in first.arcs.get((s, a), ()) for t2, c, w in second.arcs.get((t, b), ()))
            if made:
                arcs[(s, t), a] = made
                new = {x for x, _, _ in made} - seen
                seen |= new
                todo += new
    return Transducer(start, frozenset(x for x in seen if x[0] in first.final and x[1] in second.final), arcs)


MACHINES = (insults(), threats(), targets(), negations(), reports())
GRAMMAR = reduce(compose, MACHINES)


class Tables:
    """``GRAMMAR`` by numbers: only its starts are a choice, so each start is one deterministic run."""

    def __init__(self, grammar: Transducer):
        states = list(dict.fromkeys([*grammar.start, *(s for s, _ in grammar.arcs), *(arc[0] for arcs in grammar.arcs.values() for arc in arcs)]))
        number = {s: i for i, s in enumerate(states)}
        self.starts, self.final = [number[s] for s in grammar.start], [s in grammar.final for s in states]
        self.next, self.out = ([[-1] * 7 for _ in states] for _ in range(2))
        self.weight = np.zeros(len(OUTPUTS))
        for (s, a), arcs in grammar.arcs.items():
            if a != Symbol(a.kind):
                continue  # marked symbols don't come from words
            ((t, b, w),) = arcs
            self.next[number[s]][a.kind] = number[t]
            if b.match:
                self.out[number[s]][a.kind] = OUTPUTS.index(b)
                self.weight[OUTPUTS.index(b)] = w

    def matches(self, kinds: list[int]) -> list[int]:
        """Outputs of the accepted run over a clause."""
        for state in self.starts:
            hits = []
            for k in kinds:
                hit = self.out[state][k]
                state = self.next[state][k]
                if state < 0:
                    break
                if hit >= 0:
                    hits.append(hit)
            else:
                if self.final[state]:
                    return hits
        return []


TABLES = Tables(GRAMMAR)
FIXED = {w: s for s, words in ((TARGET, TARGETS), (THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words} | dict.fromkeys(",;:", PAUSE)


def prior_weights() -> np.ndarray:
    return np.array([*TABLES.weight, -1.5])


class Grammar:
    def __init__(self, insults: tuple[str, ...]):
        self.symbols = {**FIXED, **{w.removesuffix(END): INSULT for w in insults if w.endswith(END)}}
        self.beginnings = tuple(w for w in insults if not w.endswith(END))
        whole = "|".join(re.escape(w) for w, s in self.symbols.items() if s in (INSULT, THREAT))
        self.any = re.compile(r"(?<![^\W\d_])(?:(?:" + whole + r")(?![^\W\d_])" + "".join("|" + re.escape(w) for w in self.beginnings) + ")")

    def symbol(self, word: str) -> int:
        known = self.symbols.get(word)
        return known if known is not None else INSULT if word.startswith(self.beginnings) else OTHER

    def outputs(self, text: str | None) -> np.ndarray:
        """How often each output occurs, as log(1 + n), and the constant 1. Only clauses with an insult or threat are read."""
        counts = np.zeros(SIZE)
        low = text.lower() if text else ""
        done, begins, ends = 0, [], []
        for m in self.any.finditer(low):
            if m.start() < done:
                continue
            if not begins:
                marks = [x.span() for x in CLAUSE.finditer(low)]
                begins, ends = [0, *(b for _, b in marks)], [*(a for a, _ in marks), len(low)]
            at = bisect_right(begins, m.start()) - 1
            done = ends[at]
            for hit in TABLES.matches([self.symbol(w) for w in TOKEN.findall(low, begins[at], done)]):
                counts[hit] += 1
        out = np.log1p(counts) / np.log(2)
        out[-1] = 1.0
        return out


@dataclass(frozen=True)
class ToxicityModel:
    insults: tuple[str, ...]
    ordinal: OrdinalModel

    def scores(self, features: np.ndarray) -> np.ndarray:
        """P(toxic), falling back on the prior's logistic where one kind of label is missing."""
        latent = features @ self.ordinal.weights
        at = self.ordinal.thresholds[0] if len(self.ordinal.thresholds) else 0.0
        return 1 / (1 + np.exp(-np.clip(latent - at, -40, 40)))


def stems(text: str | None) -> list[str]:
    """Distinct words of a text, each with an end mark, and their beginnings of ``STEM`` letters; no words of the closed classes."""
    out: set[str] = set()
    for w in set(WORD.findall(text.lower())) - FIXED.keys() if text else ():
        out.add(w + END)
        out.update(w[:n] for n in range(STEM[0], min(len(w), STEM[1]) + 1))
    return sorted(out)


def learn_insults(rows: DataFrame, *, least: int = 4, lift_least: float = 8.0, surprise: float = 7.0) -> tuple[str, ...]:
    """Words and word beginnings that mark toxic texts, from (toxic, stems array of distinct strings).

    A stem marks them if ``least`` of the toxic texts that nothing so far explains have it, if it is ``lift_least`` times as
    often there as elsewhere, and if that is more than chance among all stems gives: its log-likelihood gain must exceed the
    logarithm of their number by ``surprise``. Each round takes the best and those at least half as good, so that a word which
    only comes along with an insult finds nothing left to explain; rounds end when no stem is left. A beginning stands for every
    word that it begins. What reaches the driver are the stems that pass, of the bounded sample.
    """
    found: list[str] = []
    kinds = rows.select(F.explode("stems").alias("stem")).distinct().count()
    floor = float(np.log(max(1, kinds)) + surprise)
    while True:
        bad = rows.where("toxic = 1")
        left = rows.where("toxic = 0").unionAll(bad.where(~F.arrays_overlap("stems", F.array(*map(F.lit, found)))) if found else bad)
        n = {r["toxic"]: r["n"] for r in left.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n1, n0 = n.get(1, 0), n.get(0, 0)
        if n1 < least or not n0:
            return tuple(found)
        words = left.select("toxic", F.explode("stems").alias("stem")).groupBy("stem").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        lift = ((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("b") + 0.5) / (n0 + 1))
        value = F.col("a") * F.log(lift)
        top = words.where((F.col("a") >= least) & (lift >= lift_least) & (value >= floor)).select("stem", value.alias("v")).orderBy(F.desc("v"), F.desc(F.length("stem")), "stem").collect()
        new = []
        for r in top:
            if 2 * r["v"] >= top[0]["v"] and not any(r["stem"].startswith(f) or f.startswith(r["stem"]) for f in found + new):
                new.append(r["stem"])
        if not new:
            return tuple(found)
        found += new


def train(docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE) -> ToxicityModel:
    """``labels``: (doc_id, toxic). Learns from a sample of at most ``limit`` of them, those with the least hash of the id."""
    some = sample(labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")), limit)
    base = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("toxic", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            made = [stems(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.string()))], ["toxic", "text", "stems"])

    rows = materialize(base.mapInArrow(words, "toxic int, text string, stems array<string>"), "toxic-words")
    insults = learn_insults(rows.select("toxic", "stems"))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(insults)
        for batch in batches:
            made = [grammar.outputs(t).astype(np.float32) for t in batch.column("text").to_pylist()]
            index = [np.arange(SIZE, dtype=np.int32)] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("toxic"), pa.int32()).cast(pa.float64()), pa.array(index, pa.list_(pa.int32())), pa.array(made, pa.list_(pa.float32()))], ["grade", "index", "value"])

    features = rows.select("toxic", "text").mapInArrow(matched, "grade double, index array<int>, value array<float>")
    model = ToxicityModel(insults, fit(features, SIZE, rounds=ROUNDS, l2=1e-3, prior=prior_weights(), rate=0.2))
    discard(rows)
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, score, n_matches (outputs of the grammar)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [id_col, *keep]
    only_new(cols, ("score", "n_matches"))
    inner = unused(cols, "__text")
    base = docs.select(*cols, F.col(text_col).cast("string").alias(inner))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[: len(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(shared.value.insults)
        for batch in sliced(batches, inner, SLICE_BYTES):
            made = np.array([grammar.outputs(t) for t in batch.column(inner).to_pylist()]).reshape(-1, SIZE)
            n = np.rint(2 ** made[:, :-1] - 1).sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.scores(made)), pa.array(n)], [*cols, "score", "n_matches"])

    return base.mapInArrow(run, f"{schema}, score double, n_matches long")
