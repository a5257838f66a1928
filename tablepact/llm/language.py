"""Language identification by mixtures of languages over hashed letter trigrams.

Training sums trigram counts for each language over all rows given. A text is then modelled as a mixture of the learned
languages: expectation-maximisation on its trigrams estimates their proportions, and the set of languages is chosen by
penalised likelihood, adding languages in the order of their proportions while each raises the likelihood by more than
its penalty. Estimation goes on until no proportion changes
by more than ``STILL``. Trigrams overlap, so a third of the log-likelihood counts as evidence.

Null texts and texts without a letter are ``und`` with score 0 and no proportions. Rows without a language aren't learned
from. Nothing learned at all: every text is ``und``. Texts without a known trigram get the prior's language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_new, sliced, unused

BUCKETS = 1 << 15
#: Weight of evidence of overlapping trigrams, and the change of proportions at which their estimation ends.
EVIDENCE, STILL = 1 / 3, 1e-3
SLICE_BYTES = 4 << 20
LETTER = re.compile(r"[^\W\d_]")
#: ASCII that isn't a letter parts words; letters fall to lower case.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the words of a text, each word between spaces."""
    b = np.frombuffer((" " + " ".join(text.lower().encode().translate(FOLD).decode("utf-8", "replace").split()) + " ").encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return ((((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)) & (BUCKETS - 1)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    probability: np.ndarray  # languages x buckets
    prior: np.ndarray

    def mixture(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Languages of the chosen set, as indices in descending proportion, and their proportions; None for ``und``."""
        if not text or not self.languages or not LETTER.search(text):
            return None
        grams = trigrams(text)
        if not len(grams):
            return np.array([int(self.prior.argmax())]), np.ones(1)
        if len(grams) > 4000:
            counts = np.bincount(grams, minlength=BUCKETS)
            seen = np.flatnonzero(counts)
            counts = counts[seen].astype(np.float32)
        else:
            seen, counts = np.unique(grams, return_counts=True)
            counts = counts.astype(np.float32)
        p = self.probability[:, seen]
        n = counts.sum()
        share = self.fit(p, counts, n, np.full(len(p), 1 / len(p), np.float32))
        order = np.argsort(-share, kind="stable")
        alone = (np.log(p) @ counts) + np.log(self.prior)
        best = int(alone.argmax())
        order = np.concatenate(([best], order[order != best]))
        chosen, proportions, value = order[:1], np.ones(1, np.float32), float(alone[best]) * EVIDENCE
        penalty = 0.5 * np.log(n + 1) + 1
        for k in range(2, len(order) + 1):
            some = order[:k]
            start = np.maximum(share[some], 1e-3)
            fitted = self.fit(p[some], counts, n, start / start.sum())
            now = float(np.log(fitted @ p[some]) @ counts) * EVIDENCE
            if now - value <= penalty:
                break
            chosen, proportions, value = some, fitted, now
        best_first = np.argsort(-proportions, kind="stable")
        return chosen[best_first], proportions[best_first]

    @staticmethod
    def fit(p: np.ndarray, counts: np.ndarray, n: float, share: np.ndarray) -> np.ndarray:
        """Proportions of the languages whose probabilities are the rows of ``p``. Each round raises the likelihood, so rounds end."""
        while True:
            new = share * (p @ (counts / (share @ p))) / n
            if np.abs(new - share).max() <= STILL:
                return new
            share = new


def learn(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Trigram counts of every row with a language. What reaches the driver is bounded by languages times buckets."""
    base = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in sliced(batches, "text", SLICE_BYTES):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                docs_of[lang] = docs_of.get(lang, 0) + 1
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS) if len(text) > 4000 else 0
                if len(text) <= 4000:
                    np.add.at(sums[lang], trigrams(text), 1)
        for lang, total in sums.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(seen) + 1), pa.string()), pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(total[seen], docs_of[lang]), pa.int64())], ["lang", "bucket", "n"])

    rows = base.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = rows.toArrow()
    langs, buckets, n = (found.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    languages = tuple(sorted(set(langs.tolist())))
    counts, prior = np.zeros((len(languages), BUCKETS)), np.ones(len(languages))
    at = np.searchsorted(np.array(languages, dtype=object), langs) if languages else np.zeros(0, np.int64)
    real = buckets >= 0
    counts[at[real], buckets[real]] = n[real]
    prior[at[~real]] += n[~real]
    smooth = counts + 0.5
    return LanguageModel(languages, (smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32), (prior / max(1, prior.sum())).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, lang_pred, score (proportion of that language), languages (map of the chosen set's proportions)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [id_col, *keep]
    only_new(cols, ("lang_pred", "score", "languages"))
    inner = unused(cols, "__text")
    base = docs.select(*cols, F.col(text_col).cast("string").alias(inner))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[: len(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches, inner, SLICE_BYTES):
            pred, score, mixed = [], [], []
            for text in batch.column(inner).to_pylist():
                found = m.mixture(text)
                if found is None:
                    pred.append("und")
                    score.append(0.0)
                    mixed.append([])
                else:
                    who, share = found
                    pred.append(m.languages[who[0]])
                    score.append(min(1.0, max(0.0, float(share[0]))))
                    mixed.append([(m.languages[i], float(s)) for i, s in zip(who, share)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))], [*cols, "lang_pred", "score", "languages"])

    return base.mapInArrow(run, f"{schema}, lang_pred string, score double, languages map<string,double>")
