"""Quality classifier: Bradley-Terry scores from preference pairs, thresholded by a score quantile."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import released

#: Labelled rows a model is fitted on at most (those of the smallest hashes), and pairs drawn from them.
FIT_ROWS, PAIRS, SEED, RIDGE = 8000, 40_000, 31, 1e-3
#: Scores from here on are predicted 1.
CUT = 0.3

_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_MARKS = [np.frombuffer(m, np.uint8) for m in (b"*#%$&", b"|<>{}[]=_~^\\", b"!", b"?", b".", b",", b";:", b"'\"()-")]
FEATURES = 33


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: lengths, kinds of characters, repetition of words and of lines."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    again = sum(map(operator.eq, words, islice(words, 1, None)))
    rates = [raw[m].sum() / size for m in _MARKS] + [raw[_UPPER].sum() / size, raw[_DIGIT].sum() / size, raw[_LOWER].sum() / size, raw[128:].sum() / size]
    shape = [
        1 - distinct / n, again / n, 1 - len(set(lines)) / max(1, len(lines)), len(text) / n / 10, min(1.0, 50 / n), min(1.0, 10 / n),
        np.log1p(n) / 10, len(lines) / n, max(map(len, words), default=0) > 60, distinct / n ** 0.9,
    ]
    x = np.array(rates + shape, np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(x[:10], 0)), (x[12:13] > 0.5) * 1.0])


@dataclass
class PairwiseModel:
    """score(x) = sigmoid(weights . standardised x - threshold), shifted so that the threshold gives CUT."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.threshold) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> PairwiseModel:
    """Logistic loss on feature differences of (better, worse) pairs, by Newton steps with a ridge.

    The threshold is the quantile of the rows' scores at the share of worse rows, in the middle of
    the gap there. With one class only, every row scores the same and is predicted 1.
    """
    if not len(x) or y.min() == y.max():
        flat = np.zeros(FEATURES)
        return PairwiseModel(flat, flat + 1, flat, -1.0, 1.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    k = min(max(1, len(bad)), len(s) - 1)
    threshold = (s[k - 1] + s[k]) / 2
    return PairwiseModel(mean, scale, w, float(threshold), float(max(1e-6, s.std() / 4)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "quality", "x"])


def learn(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> PairwiseModel:
    """Fit on labelled rows that are not held out, at most ``most`` of them, chosen by a hash of the id.

    One row an id counts, that of the least features, however often the id is repeated.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # so bounded, it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").mapInArrow(released(_features), "doc_id long, quality int, x binary")
    fitted = made.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("s")).select("s.*").collect()
    fitted.sort(key=lambda r: (r.quality, bytes(r.x)))
    x = np.array([np.frombuffer(r.x) for r in fitted]).reshape(-1, FEATURES)
    return fit(x, np.array([r.quality for r in fitted]))


def score(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its text alone (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(released(run), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every row by a model learnt from the labels; null and empty texts are scored as empty, repeated rows each."""
    return score(docs, learn(docs, labels))


def keep_good(docs: DataFrame, model: PairwiseModel, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores CUT or more."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(at).to_pylist()]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(shared.value.score(x) >= CUT))

    return docs.mapInArrow(released(run), docs.schema)
