"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds t_1 < ... < t_{K-1} give P(grade >= k) = sigmoid(score - t_k).  The
expected grade is the sum of those tail probabilities, and ``tail`` is the
probability of the highest grade reaching ``select_grade``, used for selection.

Ratings come from ``labels``: 0 for quality 0, 1 for quality 1 with toxic 1,
2 for quality 1 otherwise.  Features: hashed words by share of the text, hashed
word shapes (letter case, digits, symbols), line shapes and a few densities.

Cases: null or empty text has only the constant features; without labelled
rows every document gets the highest grade's expected value 0.0, tail 1.0 and
``keep`` true (nothing is known against it); null ids are scored, never learned
from; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .training import fitted, held_out, labelled_sample, sigmoid

SLOTS = 1 << 16
MAX_TRAIN_ROWS = 8_000  # rated rows a model is fitted on, at most
EPOCHS = 6
KEEP_TAIL = 0.2  # a document is kept when P(grade >= select_grade) is at least this

# byte classes of word shapes
_SHAPE = np.full(256, ord("u"), np.uint8)
_SHAPE[48:58] = ord("9")
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _SHAPE[_c] = _c
_DENSE = 8  # dense features behind the hashed ones


def features(data: np.ndarray, offsets: np.ndarray):
    """``(slot, row, value)`` of the hashed features, each row's values of a
    kind summing to 1, and the dense features."""
    n = len(offsets) - 1
    low = X.LOWER[data]
    starts, ends, rows = X.word_bounds(data, offsets)
    words = np.maximum(np.bincount(rows, minlength=n), 1)
    ids = X.word_hashes(low, starts, ends) & X.U(SLOTS // 2 - 1)
    # a shape: the word's byte classes with runs joined
    shape = _SHAPE[data]
    first = np.ones(len(data), bool)
    first[1:] = shape[1:] != shape[:-1]
    first[starts] = True
    runs = np.where(first & ~X.SPACE[data], 1, 0)
    upto = np.concatenate([[0], np.cumsum(runs)])
    joined = shape[runs.astype(bool)]
    shapes = (X.word_hashes(joined, upto[starts], upto[ends]) & X.U(SLOTS // 2 - 1)) + X.U(SLOTS // 2)
    slot = np.concatenate([ids, shapes]).astype(np.int64)
    row = np.concatenate([rows, rows])
    value = np.concatenate([1 / words[rows]] * 2)
    # dense: repeated words, length, symbols, upper case, line ends
    key = np.unique(rows * (1 << 32) + (X.word_hashes(low, starts, ends) >> X.U(32)).astype(np.int64))
    distinct = np.bincount(key >> 32, minlength=n)
    at = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)
    share = lambda of: np.bincount(at[of], minlength=n) / size
    symbol = X.PUNCT[data] & ~X.SPACE[data]
    dense = np.stack([np.ones(n), distinct / words, np.log1p(words) / 10, share(symbol), share((data >= 65) & (data < 91)),
                      share(data == 10) * 10, np.minimum(words, 20) / 20, share((data >= 48) & (data < 58))], axis=1)
    return slot, row, value, dense


def fit(texts: list[str], grades: list[int], epochs: int = EPOCHS):
    """``(weights, dense weights, thresholds)``; AdaGrad on the cumulative
    logit loss, thresholds kept in order by construction (a first one and
    positive gaps)."""
    y = np.array(grades, int)
    if not len(y) or y.min() == y.max():
        return np.zeros(SLOTS, np.float32), np.zeros(_DENSE), np.zeros(0)
    levels = int(y.max())
    w, gw = np.zeros(SLOTS), np.full(SLOTS, 1e-6)
    d, gd = np.zeros(_DENSE), np.full(_DENSE, 1e-6)
    rate = np.array([(y >= k).mean() for k in range(1, levels + 1)])
    first = -np.log(np.clip(rate, 1e-3, 1 - 1e-3) / (1 - np.clip(rate, 1e-3, 1 - 1e-3)))
    base, gaps = first[0], np.log(np.maximum(np.diff(first), 1e-2))
    rows = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        slot, _, value, dense = features(raw, np.array([0, len(raw)]))
        at, inv = np.unique(slot, return_inverse=True)
        rows.append((at.astype(np.int32), np.bincount(inv, weights=value, minlength=len(at)), dense[0]))
    rng = np.random.default_rng(3)
    step = 0.2
    g_base, g_gaps = 1.0, np.ones(len(gaps))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, dense = rows[i]
            cuts = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            slope = sigmoid(w[at] @ x + d @ dense - cuts) - (y[i] >= np.arange(1, levels + 1))
            g = slope.sum() * x + 1e-4 * w[at]
            gw[at] += g * g
            w[at] -= step * g / np.sqrt(gw[at])
            g = slope.sum() * dense
            gd += g * g
            d -= step * g / np.sqrt(gd)
            g = -slope.sum()
            g_base += g * g
            base -= step * g / np.sqrt(g_base)
            if len(gaps):
                g = -np.cumsum(slope[::-1])[::-1][1:] * np.exp(gaps)
                g_gaps += g * g
                gaps -= step * g / np.sqrt(g_gaps)
    return w.astype(np.float32), d, base + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def grader(shared, select_grade: int | None):
    def grade(batches):
        w, d, cuts = shared.value
        for batch in batches:
            expected, tail = np.zeros(batch.num_rows), np.ones(batch.num_rows)
            for first, data, offsets in X.pieces(batch.column("text")):
                if not len(cuts):
                    break
                slot, row, value, dense = features(data, offsets)
                n = len(offsets) - 1
                score = np.bincount(row, weights=w[slot] * value, minlength=n) + dense @ d
                p = sigmoid(score[:, None] - cuts[None, :])
                expected[first:first + n] = p.sum(axis=1)
                tail[first:first + n] = p[:, min((select_grade or len(cuts)), len(cuts)) - 1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected), pa.array(tail)], ["doc_id", "expected_grade", "tail"])
    return grade


def quality(docs: DataFrame, labels: DataFrame, select_grade: int | None = 1, keep_tail: float = KEEP_TAIL,
            max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, expected_grade, tail, keep)`` for every row."""
    graded = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality").isNull(), F.lit(None))
                           .when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    sample = labelled_sample(docs, graded, "grade", max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(sample, max_rows, fit))
    out = docs.select("doc_id", "text").mapInArrow(grader(shared, select_grade), "doc_id long, expected_grade double, tail double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail",
                      (F.col("tail") >= keep_tail).alias("keep"))
