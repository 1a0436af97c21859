"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with elastic-net
penalties, then calibrated by one temperature.

Features are the character n-grams of lengths 1 to ``GRAM`` of the lower-cased
text (by code point), hashed to ``SLOTS``; their value is (share among the text's n-grams of that length) * idf.  Idf,
weights and temperature come from the training sample alone.

Cases: ``und`` with score 0 for a text that is null or has no letter; with no
labelled rows every text is ``und``; null ids are predicted, never learned
from; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .training import Ftrl, fitted, held_out, labelled_sample

SLOTS = 1 << 16
GRAM = 4
MAX_TRAIN_ROWS = 6_000  # rows a model is fitted on, at most
MAX_PER_LANG = 1_500
EPOCHS = 4
UNDETERMINED = "und"
_MAYBE = re.compile(r"[^\W\d_]")
_BASE = X.U(0x2545F4914F6CDD1D)
PIECE_CHARS = 1 << 18  # characters whose n-grams are made at once
_MULTS = [X.U(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def has_letter(text: str) -> bool:
    """Whether a character of a letter category is there (number signs and the
    like pass the pattern, not the category)."""
    return any(unicodedata.category(m.group())[0] == "L" for m in _MAYBE.finditer(text))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray, offsets: np.ndarray):
    """For each length: slot and row of every character n-gram inside a row."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = points.astype(X.U) + X.U(1)
    code = np.zeros(len(wide), X.U)
    for n in range(1, GRAM + 1):
        m = len(wide) - n + 1
        if m <= 0:
            return
        code = code[:m] * _BASE + wide[n - 1:n - 1 + m]
        slot = ((code * _MULTS[n - 1]) >> X.U(48)).astype(np.uint16)
        same = rows[:m] == rows[n - 1:]
        if same.all():
            yield slot, rows[:m]
        else:
            yield slot[same], rows[:m][same]


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and their tf."""
    points = code_points(text)
    tf = np.zeros(SLOTS)
    for slot, _ in grams(points, np.array([0, len(points)])):
        tf += np.bincount(slot, minlength=SLOTS) / max(len(slot), 1)
    at = np.flatnonzero(tf)
    return at.astype(np.int32), tf[at]


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS):
    """``(names, table slots x langs, bias, temperature)``."""
    pairs = [(t, v) for t, v in zip(texts, langs) if has_letter(t)]
    names = sorted({v for _, v in pairs})
    k = len(names)
    if not k:
        return names, np.zeros((SLOTS, 1), np.float32), np.zeros(1), 1.0
    y = np.array([names.index(v) for _, v in pairs])
    sets = [sparse(t) for t, _ in pairs]
    df = np.zeros(SLOTS)
    for at, _ in sets:
        df[at] += 1
    idf = np.log((1 + len(sets)) / (1 + df)) + 0.05
    model = Ftrl(SLOTS + 1, k, alpha=2.0, l1=0.002, l2=0.01)
    rng = np.random.default_rng(11)
    check = rng.random(len(sets)) < 0.1  # for the temperature
    rows = [(np.append(at, SLOTS), np.append(tf * idf[at] * 100, 0.3)) for at, tf in sets]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            if check[i] and k > 1:
                continue
            at, x = rows[i]
            p = softmax(x @ model.weights(at))
            p[y[i]] -= 1
            model.step(at, x, p)
    w = model.weights()
    scores = np.array([x @ w[at] for at, x in rows])[check]
    temperature = 1.0
    if len(scores):
        truth = y[check]
        loss = [(-np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean(), t) for t in np.geomspace(0.25, 8, 41)]
        temperature = float(min(loss)[1])
    return names, (w[:-1] * idf[:, None] * 100).astype(np.float32), w[-1] * 0.3, temperature


def _pieces(texts, letters: np.ndarray):
    """Code points of the texts with a letter, their starts and rows, about
    PIECE_CHARS at a time.  A longer text comes in several pieces that overlap
    by GRAM - 1; its n-grams at a seam count in both."""
    held, at, size = [], [], 0

    def piece():
        return np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])]), np.array(at)

    for i, t in enumerate(texts):
        t = t.as_py()
        if not t or not has_letter(t):
            continue
        letters[i] = True
        points = code_points(t)
        for a in range(0, max(len(points) - GRAM + 1, 1), PIECE_CHARS):
            part = points[a:a + PIECE_CHARS + GRAM - 1]
            if held and size + len(part) > PIECE_CHARS:
                yield piece()
                held, at, size = [], [], 0
            held.append(part)
            at.append(i)
            size += len(part)
    if held:
        yield piece()


def predictor(shared):
    def predict(batches):
        names, table, bias, temperature = shared.value
        columns = [np.ascontiguousarray(table[:, c]) for c in range(len(names))]
        for batch in batches:
            lang = np.full(batch.num_rows, UNDETERMINED, object)
            score = np.zeros(batch.num_rows)
            # occurrences and their summed weights, by row and length
            count = np.zeros((GRAM, batch.num_rows))
            total = np.zeros((len(names), GRAM, batch.num_rows))
            letters = np.zeros(batch.num_rows, bool)
            for points, starts, at in _pieces(batch.column("text"), letters):
                for n, (slot, rows) in enumerate(grams(points, starts)):
                    count[n] += np.bincount(at[rows], minlength=batch.num_rows)
                    for c, w in enumerate(columns):
                        total[c, n] += np.bincount(at[rows], weights=w[slot], minlength=batch.num_rows)
            if names and letters.any():
                p = softmax(((total / np.maximum(count, 1)).sum(axis=1).T + bias) / temperature)
                best = p.argmax(axis=1)
                score[letters] = p[np.arange(len(best)), best][letters]
                lang[letters] = np.array(names, object)[best[letters]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
    return predict


def language(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, per_lang: int = MAX_PER_LANG) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``."""
    sample = labelled_sample(docs, docs.select("doc_id", "lang").where(F.col("lang").isNotNull()), "lang", max_rows, per_lang)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(sample, max_rows, fit))
    out = docs.select("doc_id", "text").mapInArrow(predictor(shared), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
