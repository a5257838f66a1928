"""Ordinal cumulative-link regression on hashed features, fitted by gradients that Spark tasks sum.

P(grade <= k) = sigmoid(threshold_k - w x), with one weight vector for all grades and ascending thresholds. Scores are the
expected grade and the probability of a grade of at least the chosen one.

The fit reads a bounded sample of labelled rows (``SAMPLE``, those with the least hash of their id); scoring reads every
row. Null or empty texts have only the features of an empty text. Null grades aren't learned from; repeated rows of one id
are all learned from. With fewer than two grades there is nothing to tell apart: the expected grade is the one
grade (or 0), and every tail probability is 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, only_new, sliced, text_id, unused

SAMPLE, ROUNDS = 20_000, 40
SIZE = 1 << 13
SHAPES = 1 << 10
SLICE_BYTES = 4 << 20
REMEMBERED = 200_000
#: Bytes to classes of a word's shape: A for capitals, a for small letters and non-ASCII, 0 for digits, others as they are.
SHAPE = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if b >= 0x80 or 0x61 <= b <= 0x7A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


def shape_of(word: bytes) -> bytes:
    out = bytearray()
    for b in word[:64].translate(SHAPE):
        if not out or out[-1] != b:
            out.append(b)
    return bytes(out[:6])


class Hashed(dict):
    """Word to bucket of the word times SHAPES, plus bucket of its shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        bucket = SHAPES + xxhash.xxh3_64_intdigest(word.lower()) % (SIZE - SHAPES - 8)
        self[word] = both = bucket * SHAPES + xxhash.xxh3_64_intdigest(shape_of(word)) % SHAPES
        return both


def text_features(text: str | None, hashed: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words at unit length, shares of word shapes, and a few measures of the whole text."""
    raw = text.encode() if text else b""
    words = Counter(raw.split())
    n = sum(words.values())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = SIZE - 8
    dense = [1.0, min(1.0, n / 50), np.log1p(n) / 10, len(words) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), min(2.0, len(raw) / max(1, n) / 10)]
    if n:
        both = np.fromiter(map(hashed.__getitem__, words), np.int64, len(words))
        counts = np.fromiter(words.values(), np.float64, len(words))
        log = np.log1p(counts)
        index = np.concatenate((both // SHAPES, both % SHAPES, size + np.arange(len(dense))))
        value = np.concatenate((log / np.sqrt((log**2).sum()), 3 * counts / n, dense))
    else:
        index, value = size + np.arange(len(dense)), np.array(dense)
    return index, value


@dataclass(frozen=True)
class OrdinalModel:
    grades: tuple[float, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, latent: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= least)."""
        grades = np.array(self.grades or (0.0,))
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - latent[:, None], -40, 40)))
        edges = np.concatenate((np.zeros((len(latent), 1)), upto, np.ones((len(latent), 1))), axis=1)
        each = np.diff(edges, axis=1)
        return each @ grades, np.clip(each[:, grades >= least].sum(axis=1), 0, 1) if len(self.grades) > 1 else np.ones(len(latent))


def sample(labels: DataFrame, limit: int = SAMPLE, *, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` rows, those with the least hash of the id."""
    return labels.orderBy(F.xxhash64(text_id(F.col(id_col))), id_col).limit(limit)


def steps(index: np.ndarray, value: np.ndarray, starts: np.ndarray, grade: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the log-likelihood by the weights and by the thresholds, and the log-likelihood."""
    latent = np.add.reduceat(value * weights[index], starts)
    edges = np.concatenate(([-40.0], thresholds, [40.0]))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    hi, lo = sig(edges[grade + 1] - latent), sig(edges[grade] - latent)
    p = np.maximum(hi - lo, 1e-9)
    dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
    pull = dlo - dhi  # by the latent value
    lengths = np.diff(np.append(starts, len(index)))
    by_weight = np.bincount(index, weights=value * np.repeat(pull, lengths), minlength=len(weights))
    k = len(thresholds)
    by_threshold = np.bincount(grade, weights=dhi, minlength=k + 1)[:k] - np.bincount(grade, weights=dlo, minlength=k + 1)[1:]
    return by_weight, by_threshold, float(np.log(p).sum())


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of the rows of one Arrow batch, as four binary columns: rounds read them without taking arrays apart.

    Values of one feature in a row are added up, which changes no latent value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            listed = b.column("index")
            lengths = np.diff(listed.offsets.to_numpy())
            key = np.repeat(np.arange(b.num_rows), lengths) * size + listed.flatten().to_numpy()
            value = b.column("value").flatten().to_numpy()
            both, spot = np.unique(key, return_inverse=True)
            value = np.bincount(spot, weights=value, minlength=len(both)).astype(np.float32)
            starts = np.searchsorted(both, np.arange(b.num_rows) * size)
            block = (b.column("grade").to_numpy().astype(np.float64), starts.astype(np.int64), (both % size).astype(np.int32), value)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in block], ["grade", "start", "index", "value"])

    return rows.mapInArrow(run, "grade binary, start binary, index binary, value binary")


def fit(rows: DataFrame, size: int, *, rounds: int = ROUNDS, l2: float = 1e-4, prior: np.ndarray | None = None, rate: float = 0.5) -> OrdinalModel:
    """Fit (grade double, index array<int>, value array<float>). Tasks sum gradients; the driver sees one vector for each task."""
    spark = rows.sparkSession
    # written first, so that as many tasks read the documents as there are partitions; the bounded sample then fits few blocks
    graded = materialize(rows.where("grade is not null and size(index) > 0").select("grade", "index", "value"), "graded")
    blocks = materialize(packed(graded.coalesce(spark.sparkContext.defaultParallelism), size), "features")
    discard(graded)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for b in batches:
            for raw in b.column("grade").to_pylist():
                seen.update(np.frombuffer(raw).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], ["grade", "n"])

    found = {r["grade"]: r["n"] for r in blocks.select("grade").mapInArrow(tally, "grade double, n long").groupBy("grade").agg(F.sum("n").alias("n")).collect()}
    grades, total = tuple(sorted(found)), sum(found.values())
    weights = np.zeros(size) if prior is None else prior.astype(float)
    if len(grades) < 2:
        discard(blocks)
        return OrdinalModel(grades, weights, np.zeros(0))
    share = np.clip(np.cumsum([found[g] for g in grades])[:-1] / total, 1e-3, 1 - 1e-3)
    thresholds = np.log(share / (1 - share))
    start, known = weights.copy(), np.array(grades)
    m, v, mt, vt = np.zeros(size), np.zeros(size), np.zeros(len(thresholds)), np.zeros(len(thresholds))
    for t in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast((weights, thresholds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, th = shared.value
            gw, gt = np.zeros(size), np.zeros(len(th))
            for b in batches:
                for raw in zip(*(b.column(c).to_pylist() for c in ("grade", "start", "index", "value"))):
                    grade, starts, index, value = (np.frombuffer(x, kind) for x, kind in zip(raw, (np.float64, np.int64, np.int32, np.float32)))
                    a, c, _ = steps(index, value.astype(float), starts, np.searchsorted(known, grade), w, th)
                    gw += a
                    gt += c
            yield pa.RecordBatch.from_arrays([pa.array([gw.tobytes()], pa.binary()), pa.array([gt.tobytes()], pa.binary())], ["w", "t"])

        got = blocks.mapInArrow(run, "w binary, t binary").collect()
        gw = sum(np.frombuffer(r["w"]) for r in got) / total - l2 * (weights - start)
        gt = sum(np.frombuffer(r["t"]) for r in got) / total
        shared.unpersist()
        m, v, mt, vt = 0.8 * m + 0.2 * gw, 0.95 * v + 0.05 * gw**2, 0.8 * mt + 0.2 * gt, 0.95 * vt + 0.05 * gt**2
        by = lambda a, b: rate * (a / (1 - 0.8**t)) / (np.sqrt(b / (1 - 0.95**t)) + 1e-4)
        weights = weights + by(m, v)
        thresholds = np.maximum.accumulate(thresholds + 0.2 * by(mt, vt))
    discard(blocks)
    return OrdinalModel(grades, weights, thresholds)


def featured(docs: DataFrame, *, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    inner = unused(keep, "__text")
    base = docs.select(*keep, F.col(text_col).cast("string").alias(inner))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for batch in sliced(batches, inner, SLICE_BYTES):
            both = [text_features(t, hashed) for t in batch.column(inner).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([i for i, _ in both], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in both], pa.list_(pa.float32()))], [*keep, "index", "value"])

    return base.mapInArrow(run, f"{schema}, index array<int>, value array<float>")


def train(docs: DataFrame, grades: DataFrame, *, limit: int = SAMPLE, rounds: int = ROUNDS) -> OrdinalModel:
    """``grades``: (doc_id, grade). Its sample of at most ``limit`` small rows is broadcast; texts aren't shuffled."""
    some = sample(grades.where("grade is not null").select("doc_id", F.col("grade").cast("double").alias("grade")), limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return fit(featured(rows, keep=("grade",)), SIZE, rounds=rounds, l2=1e-4, rate=0.3)


def latent(model: OrdinalModel, texts: pa.Array, hashed: Hashed) -> np.ndarray:
    out = []
    for text in texts.to_pylist():
        index, value = text_features(text, hashed)
        out.append(float(value @ model.weights[index]))
    return np.array(out)


def grade_documents(docs: DataFrame, model: OrdinalModel, least: float, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, expected_grade, tail_probability of a grade of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [id_col, *keep]
    only_new(cols, ("expected_grade", "tail_probability"))
    inner = unused(cols, "__text")
    base = docs.select(*cols, F.col(text_col).cast("string").alias(inner))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[: len(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, m = Hashed(), shared.value
        for batch in sliced(batches, inner, SLICE_BYTES):
            expected, tail = m.score(latent(m, batch.column(inner), hashed), least)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], [*cols, "expected_grade", "tail_probability"])

    return base.mapInArrow(run, f"{schema}, expected_grade double, tail_probability double")


def select_documents(docs: DataFrame, model: OrdinalModel, least: float, probability: float = 0.5, *, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, unchanged, whose tail probability is at least ``probability``. The text column must hold strings."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, m = Hashed(), shared.value
        for batch in sliced(batches, f"c{at}", SLICE_BYTES):
            _, tail = m.score(latent(m, batch.column(at), hashed), least)
            yield batch.filter(pa.array(tail >= probability))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
