"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

Features of a text are the distinct words (runs of letters and digits, A-Z as
a-z), pairs of neighbours, and pairs with one word between, hashed to
``SLOTS`` slots.  L1 leaves few non-zero weights, so noise in long texts adds
nothing; the broadcast holds those slots and weights alone.

Cases: a null or empty text has no features and gets the bias's score; no
labelled rows, or labels of one kind only, give score 0.0 (1.0 if all are
toxic); null ids are scored, never learned from; repeated rows give repeated
results; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .training import Ftrl, fitted, held_out, labelled_sample, sigmoid

SLOTS = 1 << 20
MAX_TRAIN_ROWS = 12_000  # labelled rows a model is fitted on, at most
EPOCHS = 2
THRESHOLD = 0.3
_SKIP = X.U(0xA24BAED4963EE407)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and row of every feature occurrence."""
    low = X.LOWER[data]
    starts, ends, rows = X.word_bounds(low, offsets, X.PUNCT)
    words = X.word_hashes(low, starts, ends)
    pair, pair_rows = X.gram_hashes(words, rows, 2)
    skip = X.mix(words[:-2] * _SKIP + words[2:]) if len(words) > 2 else words[:0]
    same = rows[:-2] == rows[2:] if len(words) > 2 else np.zeros(0, bool)
    slots = np.concatenate([words, pair, skip[same]]) & X.U(SLOTS - 1)
    return slots.astype(np.int64), np.concatenate([rows, pair_rows, rows[:-2][same] if len(words) > 2 else rows[:0]])


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots of non-zero weights, the weights and the bias."""
    y = np.array([1.0 if v else 0.0 for v in labels])
    if not len(y) or y.min() == y.max():
        return np.zeros(0, np.int32), np.zeros(0, np.float32), (35.0 if len(y) and y[0] else -np.inf)
    # the last slot of the table is the bias
    model = Ftrl(SLOTS + 1, alpha=2.0, l1=3.0, l2=0.1)
    sets = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        slots, _ = features(raw, np.array([0, len(raw)]))
        sets.append(np.append(np.unique(slots), SLOTS).astype(np.int32))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(sets)):
            at = sets[i]
            p = sigmoid(model.weights(at)[:, 0].sum())
            model.step(at, np.ones(len(at)), p - y[i])
    w = model.weights()[:, 0]
    used = np.flatnonzero(w[:-1])
    return used.astype(np.int32), w[used].astype(np.float32), float(w[-1])


def scorer(shared):
    def score(batches):
        slots, weights, bias = shared.value
        w = np.zeros(SLOTS, np.float32)
        w[slots] = weights
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, data, offsets in X.pieces(batch.column("text")):
                slots, rows = features(data, offsets)
                used = w[slots] != 0
                key = np.unique(rows[used] * SLOTS + slots[used])
                total = np.bincount(key // SLOTS, weights=w[key % SLOTS], minlength=len(offsets) - 1)
                out[first:first + len(offsets) - 1] = sigmoid(total + bias) if np.isfinite(bias) else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names if c != "text"] + [pa.array(out)], [*[c for c in batch.schema.names if c != "text"], "score"])
    return score


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS):
    """The model of a bounded sample, broadcast."""
    return docs.sparkSession.sparkContext.broadcast(fitted(labelled_sample(docs, labels, "toxic", max_rows), max_rows, fit))


def toxicity(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, max_rows: int = MAX_TRAIN_ROWS,
             threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    shared = train(docs if train_docs is None else train_docs, labels, max_rows)
    scored = docs.select("doc_id", "text").mapInArrow(scorer(shared), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all their columns) scored under the threshold.
    The scorer passes the other columns through, so nothing is joined."""
    score = scorer(train(docs, labels))

    def keep(batches):
        for batch in batches:
            (scored,) = score(iter([batch.select(["text"])]))
            yield batch.filter(pa.array(scored.column("score").to_numpy() < threshold))

    return docs.mapInArrow(keep, docs.schema)
