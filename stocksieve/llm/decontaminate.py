"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and their marks, composed and case-folded by
Unicode; punctuation, symbols and spaces of any script part them and invisible
format characters do not count.  Documents and benchmark
items are joined on shared seeds (``SEED`` consecutive tokens).  For each pair
that shares a seed the longest common run of unmarked tokens is found by
running Karp-Rabin (hashes of runs of a given length, the length falling from
the longest possible to ``SEED``), marked as a tile, and so on until no run of
``SEED`` tokens is left.  Coverage is the share of the item's tokens under
tiles, so a passage with its parts in another order is still found.

The benchmark is the stated query set: it is read in blocks of at most
``BLOCK_TOKENS`` tokens, each broadcast (about 8 bytes a token) to one pass
over all documents, so the broadcast has a fixed bound and a benchmark of any
size works.

Cases: items shorter than ``SEED`` tokens match only as a whole; null or empty
texts match nothing; repeated rows give repeated results; equal long tiles are
taken from the left; other columns are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

SEED = 5
COVERAGE = 0.6
BLOCK_TOKENS = 1 << 20


class _Signs(dict):
    """What ``str.translate`` makes of a character beyond ASCII: separators a
    space, format characters nothing."""

    def __missing__(self, code: int):
        kind = unicodedata.category(chr(code)) if code > 127 else "L"
        self[code] = None if kind == "Cf" else " " if kind[0] in "PSZ" or kind == "Cc" else code
        return self[code]


_SIGNS = _Signs()


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in folded case with their offsets."""
    raw = data.tobytes()
    if raw.isascii():
        return X.LOWER[data], offsets
    rows = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        row = raw[a:b]
        if not row.isascii():
            row = unicodedata.normalize("NFC", row.decode("utf-8", "replace").casefold()).translate(_SIGNS).encode()
        rows.append(row.lower())
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, offsets = folded(data, offsets)
    starts, ends, rows = X.word_bounds(low, offsets, X.PUNCT)
    return X.word_hashes(low, starts, ends), rows


def runs(a: np.ndarray, n: int) -> np.ndarray:
    return X.gram_hashes(a, np.zeros(len(a), np.int64), n)[0]


def _room(free: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of n free tokens."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[n:] == taken[:-n])


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiling of two token arrays: ``(doc start, item start, length)``,
    longest first, never overlapping in either."""
    out: list[tuple[int, int, int]] = []
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)

    def common(n: int):
        at_d, at_i = _room(free_doc, n), _room(free_item, n)
        hd, hi = runs(doc, n)[at_d], runs(item, n)[at_i]
        both = np.isin(hd, hi)
        return at_d[both], hd[both], at_i, hi

    length = min(len(doc), len(item))
    while length >= max(least, 1):
        at_d, hd, at_i, hi = common(length)
        for d, h in zip(at_d, hd):
            for i in at_i[hi == h]:
                if free_doc[d:d + length].all() and free_item[i:i + length].all() and np.array_equal(doc[d:d + length], item[i:i + length]):
                    out.append((int(d), int(i), length))
                    free_doc[d:d + length] = False
                    free_item[i:i + length] = False
                    break
        if len(at_d):
            length -= 1
            continue
        # no run of this length: halve towards the longest that has one
        none, some = length, max(least, 1) - 1
        while none - some > 1:
            mid = (none + some) // 2
            none, some = (none, mid) if len(common(mid)[0]) else (mid, some)
        length = some
    return out


class Block:
    """A block of items with the index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str | None], seed: int):
        self.ids, self.seed, self.items = ids, seed, []
        first: list[tuple[np.ndarray, int]] = []
        for k, t in enumerate(texts):
            raw = np.frombuffer((t or "").encode(), np.uint8)
            item = tokens(raw, np.array([0, len(raw)]))[0]
            self.items.append(item)
            first.append((runs(item, min(seed, len(item))) if len(item) else item, k))
        keys = np.concatenate([a for a, _ in first]) if first else np.zeros(0, X.U)
        owner = np.concatenate([np.full(len(a), k) for a, k in first]) if first else np.zeros(0, int)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.lengths = sorted({min(seed, len(i)) for i in self.items if len(i)})

    def matches(self, data: np.ndarray, offsets: np.ndarray, coverage: float = 0.0):
        """``(row, item index, matched, length, tiles)`` of every pair that
        shares a seed.  Tiles lie on tokens that seeds cover, so only those
        are tiled, with a barrier between stretches; a pair whose seeds cover
        too little of the item for ``coverage`` is left out at once."""
        words, rows = tokens(data, offsets)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        hits: dict[tuple[int, int], list[int]] = {}
        for n in self.lengths:
            h, at, start = seeds_at(words, rows, n)
            lo, hi = np.searchsorted(self.keys, h), np.searchsorted(self.keys, h, side="right")
            for p in np.flatnonzero(hi > lo):
                for k in self.owner[lo[p]:hi[p]]:
                    if min(self.seed, len(self.items[k])) == n:
                        hits.setdefault((int(at[p]), int(k)), []).append(int(start[p] - bounds[at[p]]))
        for (row, k), places in sorted(hits.items()):
            item, doc = self.items[k], words[bounds[row]:bounds[row + 1]]
            n = min(self.seed, len(item))
            covered = np.zeros(len(doc) + 1, bool)
            for d in range(n):
                covered[np.array(places) + d] = True
            part = np.flatnonzero(covered[:-1])
            if np.isin(item, doc[part]).sum() < coverage * len(item):
                continue
            gaps = np.flatnonzero(np.diff(part) > 1) + 1
            barred = np.insert(doc[part], gaps, X.U(0))
            found = tiles(barred, item, n)
            yield row, k, sum(t[2] for t in found), len(item), len(found)


def seeds_at(words: np.ndarray, rows: np.ndarray, n: int):
    """Hash, row and first word of every run of n words."""
    h, at = X.gram_hashes(words, rows, n)
    start = np.flatnonzero(rows[:len(words) - n + 1] == rows[n - 1:]) if len(words) >= n else np.zeros(0, np.int64)
    return h, at, start


def blocks(benchmark: DataFrame, block_tokens: int):
    """Bounded blocks of items, one at a time.  Items are numbered by the
    running sum of their lengths in the order of ids within hash groups."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    count = int(total // (2 * block_tokens)) + 1
    for b in range(count):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).orderBy("item_id", "text").toArrow()
        if rows.num_rows:
            yield rows.column("item_id").to_pylist(), rows.column("text").to_pylist()


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE,
          block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(doc_id, item_id, matched, item_tokens, n_tiles, coverage)`` of every
    pair whose coverage reaches the threshold.  One pass over the documents a
    block; no shuffle."""
    return _pairs(docs, benchmark, seed, coverage, block_tokens).drop("row")


def _pairs(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``leaks`` with a number of the document's row, the same in every pass."""
    spark = docs.sparkSession
    out = None
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    for ids, texts in blocks(benchmark, block_tokens):
        shared = spark.sparkContext.broadcast(Block(ids, texts, seed))

        def match(batches, shared=shared):
            block = shared.value
            for batch in batches:
                ids, numbers = batch.column("doc_id"), batch.column("row")
                got = []
                for first, data, offsets in X.pieces(batch.column("text")):
                    got += [(numbers[first + row].as_py(), ids[first + row].as_py(), block.ids[k], m, n, t, m / n)
                            for row, k, m, n, t in block.matches(data, offsets, coverage) if n and m / n >= coverage]
                yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, g)) for g in got], _OUT)

        part = docs.mapInArrow(match, _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], _SCHEMA)


_SCHEMA = "row long, doc_id long, item_id long, matched long, item_tokens long, n_tiles long, coverage double"
_OUT = pa.schema([(n, pa.int64()) for n in ("row", "doc_id", "item_id", "matched", "item_tokens", "n_tiles")] + [("coverage", pa.float64())])


def best_leak(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per leaking row of ``docs`` (repeated rows and null ids are rows
    of their own): the item it covers most (ties: the smaller item id) and how
    many items it leaks."""
    pairs = _pairs(docs, benchmark, **how)
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("minus_id"), "matched", "item_tokens", "n_tiles"))
    return (pairs.groupBy("row", "doc_id").agg(best.alias("b"), F.count_distinct("item_id").alias("n_items"))
            .select("doc_id", (-F.col("b.minus_id")).alias("item_id"), F.col("b.matched").alias("matched"),
                    F.col("b.item_tokens").alias("item_tokens"), F.col("b.n_tiles").alias("n_tiles"),
                    F.col("b.coverage").alias("coverage"), "n_items"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE,
               block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs`` (all their columns) that leak no item: a filter
    pass a block, nothing joined."""
    spark = docs.sparkSession
    for ids, texts in blocks(benchmark, block_tokens):
        shared = spark.sparkContext.broadcast(Block(ids, texts, seed))

        def keep(batches, shared=shared):
            block = shared.value
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                for first, data, offsets in X.pieces(batch.column("text")):
                    for row, _, m, n, _ in block.matches(data, offsets, coverage):
                        if n and m / n >= coverage:
                            ok[first + row] = False
                yield batch.filter(pa.array(ok))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
