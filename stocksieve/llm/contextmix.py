"""Language-model scores by online logistic context mixing.

The model predicts a text bit by bit.  Each of ``ORDERS`` predictors hashes the
last 1 to 5 bytes and the bits of the byte so far to a slot with the numbers of
0s and 1s that followed in the learned texts; the logarithm of their odds is
its vote.  Votes are added with weights of a set that a gate picks (the longest
context known, how often it was seen, and the place of the bit in its byte).  An
adaptive probability map refines the sum: for the byte so far and the mixed
probability it knows how often a 1 really followed.  A text's end is one zero
byte after it, so texts of all lengths share one distribution.

Learning, over all documents of the learned folds:

1. Tasks count windows (a byte and the five before it, zeros before the
   start), Spark adds them up: that table grows with the corpus.
2. Windows are dealt to blocks of slots by their context and added to the
   blocks' counts.  The slots (``BLOCKS`` blocks) have a fixed size.
3. Weights follow the gradient online, batch after batch of a partition's
   windows, and are averaged over the partitions by the occurrences each set
   saw; then the map is counted.  In both an occurrence is left out of the
   counts that predict it.

A text's score adds the learned logarithms over its windows; a worker remembers
those of windows it has met.

The base score takes words as tokens.  Their counts come from the same
documents: tokens with a ``HOT_SHARE``-th of all occurrences (so at most so
many) are broadcast, all others are joined on the token.

Cases: a null or empty text has its end alone; a null id counts as held out;
repeated rows count and are scored each; with nothing to learn from every bit
has probability 1/2 and every token is unknown; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .components import scratch, staged

FOLDS, HELD_OUT = 5, 1
ORDERS = 5
BLOCKS = (16, 64, 64, 128, 256)  # of slots, by order
BLOCK = 1 << 14
HOT_SHARE = 1 << 19
HELD_WORDS = 500_000
HELD_WINDOWS = 2_000_000  # windows a task holds before it merges them or passes them on
WINDOW_BYTES = 1 << 20  # bytes whose windows are made at once
KNOWN_BITS = 23
HELD_TOKENS = 100_000  # rows of tokens a task holds before it passes them on
DELTA = 0.3  # added to both counts of a slot
GATES = (ORDERS + 1) * 4 * 8
RATE = 0.02
BATCH = 4096
STEPS = 33  # of the map, half a unit of log odds each
MAP_PRIOR = 16.0
FLOOR = 1.0 / 65536
_UNSEEN = 255

U = np.uint64
_FIRST_BLOCK = np.concatenate([[0], np.cumsum(BLOCKS)])
_ORDER_MIX = [U(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_NODE_MIX = U(0xBF58476D1CE4E5B9)
_MASK = [U((1 << 8 * k) - 1) for k in range(ORDERS + 2)]
_WORD_END = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(X.LOWER)
END = b""  # the token at the end of a text; no word is empty


def held_out(doc_id: Column) -> Column:
    """True for the fold nothing is learned from (a null id is in it)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


# ---------------------------------------------------------------- tokens

def words(text: str | None) -> Iterator[list[bytes]]:
    """The text's words, A-Z lower-cased, a bounded part of it at a time."""
    raw = (text or "").encode().translate(_LOWER)
    a = 0
    while a < len(raw):
        stop = _WORD_END.search(raw, a + 4 * WINDOW_BYTES)
        b = stop.end() if stop else len(raw)
        yield raw[a:b].split()
        a = b


def _token_rows(batches):
    held: Counter = Counter()

    def out():
        words = list(held)
        for a in range(0, len(words), 50_000):
            part = words[a:a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([held[w] for w in part], pa.int64())], ["token", "c"])

    for batch in batches:
        for t in batch.column("text"):
            for part in words(t.as_py()):
                held.update(part)
            held[END] += 1
            if len(held) > HELD_WORDS:
                yield from out()
                held.clear()
    yield from out()


# ---------------------------------------------------------------- windows

def windows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of the texts' bytes and ends, and the rows they are in."""
    for first, data, offsets in X.pieces(texts):
        data = np.insert(data, offsets[1:], 0)
        starts = offsets[:-1] + np.arange(len(offsets) - 1)
        for a in range(0, len(data), WINDOW_BYTES):
            b, lead = min(a + WINDOW_BYTES, len(data)), min(a, ORDERS)
            own = data[a - lead:b].astype(U)
            w = own.copy()
            for j in range(1, ORDERS + 1):
                w[j:] |= own[:-j] << U(8 * j)
            w, at = w[lead:], np.arange(a, b)
            row = np.searchsorted(starts, at, side="right") - 1
            early = np.flatnonzero(at - starts[row] < ORDERS)  # their first bytes lie before the text
            age = at[early] - starts[row[early]]
            w[early] &= np.array(_MASK, U)[age + 1]
            yield w, row + first


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(n, new)


def _window_rows(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["window", "n"])

    for batch in batches:
        for w, _ in windows(batch.column("text")):
            held.append(np.unique(w, return_counts=True))
            size += len(held[-1][0])
            if size > HELD_WINDOWS:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > HELD_WINDOWS // 2:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*_summed(*map(np.concatenate, zip(*held))))


# ---------------------------------------------------------------- predictors

def _context(grams: np.ndarray, k: int) -> np.ndarray:
    """Hash of the context of windows cut to order k."""
    return X.mix((grams >> U(8)) * _ORDER_MIX[k - 1] + U(k))


def _block(context: np.ndarray, k: int) -> np.ndarray:
    return _FIRST_BLOCK[k - 1] + ((context >> U(32)) % U(BLOCKS[k - 1])).astype(np.int64)


def _place(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    h = (context ^ (node.astype(U) * _NODE_MIX)) * _ORDER_MIX[0]
    return (h >> U(50)).astype(np.int64)


def _gram_rows(batches):
    """Windows to the grams of all orders, with the block of their context."""
    for batch in batches:
        w = batch.column("window").to_numpy(zero_copy_only=False).view(U)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        for k in range(1, ORDERS + 1):
            keys, m = _summed(w & _MASK[k + 1], n) if len(w) else (w, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_block(_context(keys, k), k).astype(np.int32)), pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(m)],
                ["block", "k", "gram", "n"])


def _slot_rows(batches):
    """Grams, dealt out by block, to blocks of counts (two half floats a slot:
    counts beyond their range keep their ratio)."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        block, k, gram, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "k", "gram", "n"))
        order = np.argsort(block, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1], [True]])) if len(order) else []
        for a, b in zip(bounds, bounds[1:]):
            own = order[a:b]
            keys, m = gram[own].view(U), n[own].astype(float)
            context, byte = _context(keys, int(k[own[0]])), keys & U(255)
            counts = held.setdefault(int(block[own[0]]), np.zeros(2 * BLOCK))
            for j in range(8):
                node, bit = (U(1) << U(j)) | (byte >> U(8 - j)), (byte >> U(7 - j)) & U(1)
                counts += np.bincount(2 * _place(context, node) + bit.astype(np.int64), weights=m, minlength=2 * BLOCK)
    for block, counts in held.items():
        pair = counts.reshape(-1, 2)
        pair = pair * np.minimum(1, 60000 / np.maximum(pair.max(axis=1), 1))[:, None]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pair.astype(np.float16).tobytes()], pa.binary())], ["block", "counts"])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _vote(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of counts of 0s and 1s, and how sure they are."""
    total = pair.sum(axis=1)
    sure = np.where(total > 0, np.minimum(np.log2(np.maximum(total, 1)), 3), _UNSEEN).astype(np.uint8)
    return np.log((pair[:, 1] + DELTA) / (pair[:, 0] + DELTA)), sure


class Model:
    """Slots, gated weights and the map; all of a fixed size."""

    def __init__(self, slots: np.ndarray | None, weights: np.ndarray | None = None, refined: np.ndarray | None = None,
                 votes: np.ndarray | None = None, sure: np.ndarray | None = None):
        self.slots, self.refined, self.votes, self.sure = slots, refined, votes, sure
        self.weights = weights if weights is not None else np.full((GATES, ORDERS + 1), 0.3) * ([1.0] * ORDERS + [0.0])

    def ready(self) -> tuple:
        """What scoring needs: weights, map, and in place of a slot's counts its
        vote and how sure it is."""
        votes, sure = np.empty(len(self.slots), np.float16), np.empty(len(self.slots), np.uint8)
        for a in range(0, len(votes), 1 << 18):
            part = slice(a, a + (1 << 18))
            votes[part], sure[part] = _vote(self.slots[part].astype(np.float32))
        return self.weights, self.refined, votes, sure

    def bits(self, w: np.ndarray) -> Iterator[tuple]:
        """For each bit of the windows' last bytes: node, bit, votes and gate.
        A model that still counts takes one occurrence of the window from all
        counts."""
        left_out = self.votes is None
        byte = w & U(255)
        contexts = [_context(w & _MASK[k + 1], k) for k in range(1, ORDERS + 1)]
        bases = [_block(c, k) * BLOCK for k, c in enumerate(contexts, 1)]
        at = np.arange(len(w))
        for j in range(8):
            node, bit = (U(1) << U(j)) | (byte >> U(8 - j)), ((byte >> U(7 - j)) & U(1)).astype(np.int64)
            votes = np.ones((len(w), ORDERS + 1))
            gate = np.zeros(len(w), np.int64)
            for k in range(ORDERS):
                slot = bases[k] + _place(contexts[k], node)
                if left_out:
                    pair = self.slots[slot].astype(np.float32)
                    pair[at, bit] = np.maximum(pair[at, bit] - 1, 0)
                    votes[:, k], sure = _vote(pair)
                else:
                    votes[:, k], sure = self.votes[slot], self.sure[slot]
                known = sure != _UNSEEN
                gate[known] = (k + 1) * 4 + sure[known]
            yield node.astype(np.int64), bit, votes, gate * 8 + j

    def mixed(self, votes: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return logistic(np.einsum("ik,ik->i", votes, self.weights[gate]))

    def learn(self, w: np.ndarray, n: np.ndarray, steps: np.ndarray, mass: np.ndarray) -> None:
        for node, bit, votes, gate in self.bits(w):
            slope = (bit - self.mixed(votes, gate)) * n
            total = np.bincount(gate, weights=n, minlength=GATES)
            g = np.stack([np.bincount(gate, weights=slope * votes[:, k], minlength=GATES) for k in range(ORDERS + 1)], axis=1)
            g /= np.maximum(total, 1)[:, None]
            steps += g * g
            self.weights = self.weights + RATE * g / np.sqrt(steps + 1e-6)
            mass += total

    def step_of(self, p: np.ndarray) -> np.ndarray:
        x = np.log(p / (1 - p))
        return np.clip(np.rint(2 * x) + STEPS // 2, 0, STEPS - 1).astype(np.int64)

    def log10(self, w: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last byte after the others."""
        out = np.zeros(len(w))
        for node, bit, votes, gate in self.bits(w):
            p = np.clip(self.mixed(votes, gate), FLOOR, 1 - FLOOR)
            if self.refined is not None:
                n = self.refined[node, self.step_of(p)]
                p = (p + (n[:, 1] + MAP_PRIOR * p) / (n.sum(axis=1) + MAP_PRIOR)) / 2
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out


def _learned(shared):
    def learn(batches):
        model = Model(shared.value)
        steps, mass = np.zeros((GATES, ORDERS + 1)), np.zeros(GATES)
        for batch in batches:
            w = batch.column("window").to_numpy(zero_copy_only=False).view(U)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            for a in range(0, len(w), BATCH):
                model.learn(w[a:a + BATCH], n[a:a + BATCH], steps, mass)
        at = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(mass[at]), pa.array((model.weights[at] * mass[at, None]).tolist(), pa.list_(pa.float64()))],
                                         ["gate", "mass", "w"])
    return learn


def _map_rows(shared, weights):
    def count(batches):
        model, counts = Model(shared.value, weights), np.zeros((256, STEPS, 2))
        for batch in batches:
            w = batch.column("window").to_numpy(zero_copy_only=False).view(U)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            for a in range(0, len(w), 8 * BATCH):
                part, m = w[a:a + 8 * BATCH], n[a:a + 8 * BATCH]
                for node, bit, votes, gate in model.bits(part):
                    p = np.clip(model.mixed(votes, gate), FLOOR, 1 - FLOOR)
                    np.add.at(counts, (node, model.step_of(p), bit), m)
        at = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays([*(pa.array(at[:, c].astype(np.int32)) for c in range(3)), pa.array(counts[tuple(at.T)])], ["node", "step", "bit", "n"])
    return count


def fit(docs: DataFrame) -> Model:
    """The model of all ``docs (text)``."""
    sc = docs.sparkSession.sparkContext
    with scratch(docs.sparkSession) as stage:
        counted = docs.select("text").mapInArrow(_window_rows, "window long, n long").groupBy("window").agg(F.sum("n").alias("n"))
        counted = stage(counted, "windows")
        grams = counted.mapInArrow(_gram_rows, "block int, k int, gram long, n long").repartition("block")
        slots = np.zeros((int(_FIRST_BLOCK[-1]) * BLOCK, 2), np.float16)
        for r in grams.mapInArrow(_slot_rows, "block int, counts binary").toLocalIterator():
            slots[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.float16).reshape(-1, 2)
        shared = sc.broadcast(slots)
        model = Model(slots)
        part = F.posexplode("w").alias("k", "v")
        sums = counted.mapInArrow(_learned(shared), "gate int, mass double, w array<double>").select("gate", "mass", part)
        for r in sums.groupBy("gate", "k").agg(F.sum("v").alias("v"), F.sum("mass").alias("mass")).collect():  # GATES * 6 rows
            model.weights[r.gate, r.k] = r.v / r.mass
        model.refined = np.zeros((256, STEPS, 2))
        sums = counted.mapInArrow(_map_rows(shared, model.weights), "node int, step int, bit int, n double").groupBy("node", "step", "bit").agg(F.sum("n").alias("n"))
        for r in sums.collect():  # at most 256 * STEPS * 2 rows
            model.refined[r.node, r.step, r.bit] = r.n
        shared.destroy()
    return model


# ---------------------------------------------------------------- scores

class Memory:
    """Log probabilities of windows met before, in a table of fixed size.  A
    window's 48 bits are mixed one to one; the first say where it is kept, the
    others tell it from those kept there before."""

    def __init__(self, model: Model):
        self.model = model
        self.tags = np.full(1 << KNOWN_BITS, _NO_TAG, np.uint32)  # a tag has 48 - KNOWN_BITS bits
        self.values = np.zeros(1 << KNOWN_BITS, np.float32)

    def _at(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (w * _ORDER_MIX[1]) & _MASK[ORDERS + 1]
        h = ((h ^ (h >> U(24))) * _ORDER_MIX[2]) & _MASK[ORDERS + 1]
        return (h >> U(48 - KNOWN_BITS)).astype(np.int64), (h & U((1 << 48 - KNOWN_BITS) - 1)).astype(np.uint32)

    def __call__(self, w: np.ndarray) -> np.ndarray:
        slot, tag = self._at(w)
        out = self.values[slot].astype(float)
        new = np.flatnonzero(self.tags[slot] != tag)
        if len(new):
            fresh, back = np.unique(w[new], return_inverse=True)
            found = np.concatenate([self.model.log10(fresh[a:a + (1 << 15)]) for a in range(0, len(fresh), 1 << 15)]).astype(np.float32)
            out[new] = found[back]
            slot, tag = self._at(fresh)
            self.tags[slot], self.values[slot] = tag, found  # of equal places the last, in both
        return out


_NO_TAG = (1 << 32) - 1
_memory: list = []  # of a worker: the model broadcast last, and what it remembers


def memory_of(shared: tuple) -> Memory:
    """The same memory for all tasks of a worker."""
    if not _memory or _memory[0] is not shared:
        _memory[:] = [shared, Memory(Model(None, *shared[:4]))]
    return _memory[1]


_ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                   ("base_score", pa.float64()), ("score", pa.float64()), ("token", pa.binary()), ("n", pa.int64())])
_ROWS_DDL = "row long, doc_id long, n_bytes long, n_tokens long, n_known long, base_score double, score double, token binary, n long"


def _part(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _ROWS], schema=_ROWS)


def _tokens(at: list, token: list, count: list) -> pa.RecordBatch:
    return _part(len(at), row=pa.array(at, pa.int64()), token=pa.array(token, pa.binary()), n=pa.array(count, pa.int64()))


def _scored(shared):
    """Documents to one row each and one for every token that isn't broadcast."""
    def score(batches):
        recall, hot = memory_of(shared.value), shared.value[4]
        for batch in batches:
            rows, texts = batch.column("row").to_pylist(), batch.column("text")
            lm = np.zeros(len(rows))
            for w, at in windows(texts):
                first = at[0]
                lm[first:at[-1] + 1] += np.bincount(at - first, weights=recall(w))
            n_tokens, n_known, base, n_bytes = [], [], [], []
            at, token, count = [], [], []
            for row, t in zip(rows, texts):
                t = t.as_py() or ""
                own = Counter((END,))
                for part in words(t):
                    own.update(part)
                known, sum_ = 0, 0.0
                for word, n in own.items():
                    log = hot.get(word)
                    if log is None:
                        at.append(row)
                        token.append(word)
                        count.append(n)
                    else:
                        known += n
                        sum_ += n * log
                n_tokens.append(own.total())
                n_known.append(known)
                base.append(sum_)
                n_bytes.append(len(t.encode()))
                if len(at) > HELD_TOKENS:
                    yield _tokens(at, token, count)
                    at, token, count = [], [], []
            yield _part(len(rows), row=batch.column("row"), doc_id=batch.column("doc_id"), n_bytes=pa.array(n_bytes, pa.int64()),
                        n_tokens=pa.array(n_tokens, pa.int64()), n_known=pa.array(n_known, pa.int64()), base_score=pa.array(base, pa.float64()), score=pa.array(lm))
            if at:
                yield _tokens(at, token, count)
    return score


def mixing_scores(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte)`` of every row of ``docs``."""
    spark = docs.sparkSession
    learned = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = staged(learned.mapInArrow(_token_rows, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "token_counts")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, out_of = size["n"], size["n"] + 0.5 * (size["v"] + 1)
    hot = counts.where(F.col("c") * HOT_SHARE >= total)  # at most HOT_SHARE tokens
    logs = {bytes(r.token): float(np.log10((r.c + 0.5) / out_of)) for r in hot.toLocalIterator()}
    model = fit(learned)
    shared = spark.sparkContext.broadcast((*model.ready(), logs))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(rows.mapInArrow(_scored(shared), _ROWS_DDL), "mixing_scores")
    shared.destroy()
    c = F.coalesce("c", F.lit(0))
    rare = rows.where(F.col("token").isNotNull()).select("row", "token", "n").join(counts.where(F.col("c") * HOT_SHARE < total), "token", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(out_of))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
    scored = rows.where(F.col("token").isNull()).drop("token", "n").join(rare, "row", "left")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_bytes", "n_tokens",
                         (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                         (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
                         (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
