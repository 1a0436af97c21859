"""Token counts without materialising ids.

1. A task cuts its documents into white-space chunks (the tokenizer's split
   rule never crosses white space) and numbers the distinct chunks; the
   library's own normaliser and pre-tokeniser run once per distinct chunk of a
   block of documents.  That gives each document's pre-token frequencies, kept
   as one posting list per (pre-token, block).
2. The distinct pre-tokens of the corpus are counted once each: the BPE model
   says how many pieces one has.
3. Postings are joined to those counts on the pre-token and pieces * frequency
   is summed by document.

Steps 2 and 3 share one shuffle: postings are dealt out and sorted by
pre-token, so a task meets all postings of a pre-token together, counts its
pieces once and applies them (a merge join whose right side is made on the
spot).  A common pre-token has one posting row per block, not one per document,
and the sums go up to documents through a partial aggregation.

Special strings inside a text are one piece each, as the library does by
default.  Cases: null or empty text has 0 bytes and 0 tokens; a null id or a
repeated row is a document of its own; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path

TOKENIZER_FILE = "word_bpe_49k.json"
LIMIT = 2048
BLOCK_DOCS = 16384  # documents of a posting block, at most (a place has two bytes)
BLOCK_BYTES = 32 << 20
KNOWN_CHUNKS = 200_000  # chunks whose pre-tokens a task remembers
#: Unicode White_Space, without the four separators that str.split adds
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
SPECIAL = "\0"  # starts the key of a special string; its rest is the string


def load(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def specials(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class Splitter:
    """Pre-tokens of a white-space chunk, as the library cuts them."""

    def __init__(self, tokenizer):
        self.normalizer, self.pre = tokenizer.normalizer, tokenizer.pre_tokenizer
        found = specials(tokenizer)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")") if found else None
        self.found = set(found)

    def __call__(self, chunk: str) -> list[str]:
        parts = self.special.split(chunk) if self.special else [chunk]
        out = []
        for p in parts:
            if p in self.found:
                out.append(SPECIAL + p)
            elif p:
                out += [s for s, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(p))]
        return out


def chunks(text: str) -> list[str]:
    return [c for c in _SPACE.split(text) if c] if _ODD.search(text) else text.split()


_POSTED = pa.schema([("pre_token", pa.string()), ("posting", pa.binary()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("row", pa.int64())])
_POSTED_DDL = "pre_token string, posting binary, doc_id long, n_bytes long, row long"
_MOST = 255  # a larger frequency is kept as several entries


def _batch(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _POSTED], schema=_POSTED)


def block_postings(base: int, texts: list[str], split: Splitter, known: dict):
    """Posting rows of one block: ``(pre_token, posting)``; a posting is the
    block's first row (8 bytes), two-byte places in the block, one-byte
    frequencies."""
    numbers: dict[str, int] = {}
    docs, ids, counts = [], [], []
    for k, t in enumerate(texts):  # occurrences are held for one document at a time
        own = np.array([numbers.setdefault(c, len(numbers)) for c in chunks(t)], np.int32)
        own, n = np.unique(own, return_counts=True)
        docs.append(np.full(len(own), k, np.int32))
        ids.append(own)
        counts.append(n.astype(np.int32))
    if not numbers:
        return
    doc, chunk, n = np.concatenate(docs), np.concatenate(ids), np.concatenate(counts)
    del docs, ids, counts
    pres: dict[str, int] = {}
    flat, size = [], np.zeros(len(numbers), np.int64)
    for k, c in enumerate(numbers):
        got = known.get(c)
        if got is None:
            got = split(c)
            if len(known) < KNOWN_CHUNKS:
                known[c] = got
        size[k] = len(got)
        flat += [pres.setdefault(p, len(pres)) for p in got]
    # each (document, chunk) pair becomes one pair for each pre-token of the chunk
    flat, first = np.array(flat, np.int64), np.concatenate([[0], np.cumsum(size)])
    times = size[chunk]
    take = np.repeat(first[chunk] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    key = flat[take] * len(texts) + np.repeat(doc, times)
    del take
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.repeat(n, times)[order]
    if not len(key):
        return
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n, key = np.add.reduceat(n, new), key[new]
    times = -(-n // _MOST)  # entries of a pair
    last = np.cumsum(times) - 1
    key, n_left = np.repeat(key, times), n - (times - 1) * _MOST
    n = np.full(len(key), _MOST)
    n[last] = n_left
    bounds = np.searchsorted(key // len(texts), np.arange(len(pres) + 1))
    head, rows, freqs = np.array([base], "<i8").tobytes(), (key % len(texts)).astype("<u2").tobytes(), n.astype("u1").tobytes()
    names = list(pres)
    for a in range(0, len(names), 20_000):
        part = range(a, min(a + 20_000, len(names)))
        packed = [head + rows[2 * bounds[k]:2 * bounds[k + 1]] + freqs[bounds[k]:bounds[k + 1]] for k in part]
        yield _batch(len(part), pre_token=pa.array(names[a:a + 20_000]), posting=pa.array(packed, pa.binary()))


def postings(path: str):
    """``(row, doc_id, text)`` batches to posting rows and one row for each
    document (without a pre-token)."""
    def post(batches):
        split, known = Splitter(load(path)), {}
        base, texts, size = 0, [], 0
        for batch in batches:
            got = batch.column("text").to_pylist()
            places = []
            for row, t in zip(batch.column("row").to_pylist(), got):
                if texts and (size + len(t) > BLOCK_BYTES or len(texts) >= BLOCK_DOCS):
                    yield from block_postings(base, texts, split, known)
                    texts, size = [], 0
                if not texts:
                    base = row
                places.append(base + len(texts))
                texts.append(t)
                size += len(t)
            yield _batch(len(places), doc_id=batch.column("doc_id"), row=pa.array(places, pa.int64()),
                         n_bytes=pa.array([len(t.encode()) for t in got], pa.int64()))
        if texts:
            yield from block_postings(base, texts, split, known)

    return post


def sums(path: str):
    """Postings sorted by pre-token to sums of pieces by document row."""
    def add(batches):
        model = load(path).model
        last, pieces = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            each = []
            for p in batch.column("pre_token").to_pylist():
                if p != last:
                    last, pieces = p, 1 if p.startswith(SPECIAL) else len(model.tokenize(p))
                each.append(pieces)
            packed = batch.column("posting").to_pylist()
            sizes = np.array([(len(x) - 8) // 3 for x in packed])
            base = np.frombuffer(b"".join([x[:8] for x in packed]), "<i8")
            row = np.frombuffer(b"".join([x[8:8 + 2 * k] for x, k in zip(packed, sizes.tolist())]), "<u2") + np.repeat(base, sizes)
            n = np.frombuffer(b"".join([x[8 + 2 * k:] for x, k in zip(packed, sizes.tolist())]), "u1") * np.repeat(np.array(each, np.int64), sizes)
            order = np.argsort(row, kind="stable")
            row, n = row[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(row[new]), pa.array(np.add.reduceat(n, new))], ["row", "n"])
    return add


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row."""
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                           F.coalesce("text", F.lit("")).alias("text"))
    # written once: documents and postings of one pass agree on the row numbers
    path = shared_path(spark, "tokens", unique=True)
    numbered.mapInArrow(postings(tokenizer_path), _POSTED_DDL).write.option("compression", "zstd").parquet(path)
    posted = spark.read.schema(_POSTED_DDL).parquet(path)
    together = posted.where(F.col("pre_token").isNotNull()).select("pre_token", "posting").repartition("pre_token").sortWithinPartitions("pre_token")
    total = together.mapInArrow(sums(tokenizer_path), "row long, n long").groupBy("row").agg(F.sum("n").alias("n_tokens"))
    n = F.coalesce("n_tokens", F.lit(0)).cast("long")
    return (posted.where(F.col("pre_token").isNull()).select("doc_id", "n_bytes", "row").join(total, "row", "left")
            .select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit")))
