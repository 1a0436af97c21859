"""Bounded training samples and the FTRL-proximal learner.

A classifier is fitted on at most ``max_rows`` labelled rows: the rows with
the smallest hash of their id, so the sample does not depend on file order
and does not grow with the corpus.  One task fits the model; the driver sees the
model alone.  Scoring then runs over every row in tasks, with the weights
broadcast (their size is fixed by the number of hash slots).
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HELD_OUT_FOLDS, HELD_OUT = 4, 2
BUCKET_BITS = 12  # of the hash, of which rows are counted before the smallest are taken


def held_out(doc_id: Column) -> Column:
    """True for the fold no model learns from (a null id is in the fold)."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == HELD_OUT
    return F.coalesce(fold, F.lit(True))


def near_smallest(ids: DataFrame, per_label: int) -> DataFrame:
    """Of each label the ``per_label`` rows of smallest ``rank_by`` and no more
    others than a few buckets of ``rank_by`` hold, found by counts alone."""
    bucket = F.shiftright("rank_by", 64 - BUCKET_BITS)  # rises with rank_by
    counts = ids.groupBy("label", bucket.alias("bucket")).count()
    before = F.sum("count").over(Window.partitionBy("label").orderBy("bucket")) - F.col("count")
    wanted = counts.withColumn("before", before).where(F.col("before") < per_label).select("label", "bucket")
    # at most 2 ** BUCKET_BITS rows a label, whatever the corpus
    return ids.withColumn("bucket", bucket).join(F.broadcast(wanted), ["label", "bucket"], "left_semi").select(*ids.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, per_label: int | None = None) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``max_rows`` rows outside the
    held-out fold: those with the smallest hash of the id, of each label value
    at most ``per_label``.  Rows without id, label or text are not learned
    from; of an id's several labels the largest counts."""
    ids = (labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("label"))
           .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("label").alias("label"))
           .withColumn("rank_by", F.xxhash64("doc_id")))
    if per_label:
        ids = (near_smallest(ids, per_label).withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("rank_by", "doc_id")))
               .where(F.col("nth") <= per_label).drop("nth"))
    ids = ids.orderBy("rank_by", "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    # the sample has at most max_rows narrow rows, whatever the corpus
    return texts.join(F.broadcast(ids.select("doc_id", "label")), "doc_id")


def fitted(sample: DataFrame, max_rows: int, fit: Callable[[list[str], list], tuple]) -> tuple:
    """``fit(texts, labels)`` over the sample's rows in a fixed order, run in one
    task (the sample is bounded; repeated rows that exceed the bound are left
    out); only what it returns reaches the driver."""
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_rows).select("text", "label")

    def run(batches):
        texts, labels = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            labels += batch.column("label").to_pylist()
        packed = zlib.compress(pickle.dumps(fit(texts, labels)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["model"])

    got = rows.mapInArrow(run, "model binary").collect()
    return pickle.loads(zlib.decompress(got[0].model)) if got else fit([], [])


class Ftrl:
    """FTRL-proximal with per-coordinate rates, L1 and L2, for one or more
    linear scores (``classes``) over hashed slots."""

    def __init__(self, slots: int, classes: int = 1, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z = np.zeros((slots, classes))
        self.n = np.zeros((slots, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, at: np.ndarray, x: np.ndarray, slope) -> None:
        """One example: distinct slots ``at`` with values ``x`` and the loss
        slope by score."""
        w = self.weights(at)
        g = x[:, None] * np.atleast_1d(slope)[None, :]
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
