"""Spelling variant grouping: words one edit apart by a variable-length gram
index.

1. Words: a task counts the letter runs of its documents, Spark adds up.
2. Gram dictionary: grams of ``SHORT`` to ``LONG`` letters of the distinct
   words are counted; the frequent ones stay (a count of at least
   ``MIN_GRAM`` and of a ``GRAM_SHARE``-th of all, so at most ``GRAM_SHARE`` a
   length, which bounds what is broadcast).  A rare long gram is pruned: its
   shorter prefix is selective already.
3. A word is decomposed: at each place the longest gram of the dictionary (or
   the SHORT letters that stand there), unless it lies in an earlier one.
4. For each word, the most grams that one edit can affect (``affected``): those
   it overlaps, those on its left that a dictionary gram could stretch over it,
   those on its right that such a gram could swallow.  Any other gram of a word
   also stands in its near words, with the same letters before it (edit on its
   right) or after it (edit on its left).
5. So near words share one of the affected + 1 rarest grams of each, together
   with all letters on one side: a word is listed under these only.  A word of
   which one edit can affect all grams is listed under all; two such words meet
   by the lists of their SHORT-letter grams, of which one edit never affects all.
6. Lists are merged and every pair verified.  A list of more than
   ``LIST_WORDS`` words (by a histogram of list keys) is parted by what is left
   of the word when one letter of the other side is dropped, and by the word
   itself: near words share one of these, and only as many words as the alphabet
   allows can, however many the list has.

Cases: null texts have no words; a null id counts as the empty string; repeated
rows count again; of equally frequent near words the smallest in code-point
order is the form; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import scratch, staged
from .sketch import histogram

MIN_LETTERS = 6
MIN_COUNT = 5
FORM_RATIO = 5
NOISE = 199  # one (document, run) in so many loses a letter
SHORT, LONG = 3, 6
MIN_GRAM = 32
GRAM_SHARE = 1 << 14
LIST_WORDS = 64
LIST_BITS = 20
HELD_WORDS = 400_000  # words a task holds before it passes their counts on
_WHOLE = 1 << 22  # letters of a text whose runs are listed at once
_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LETTERS)
_LOWER = {c: c + 32 for c in range(65, 91)}


# ---------------------------------------------------------------- words

def _runs(text: str) -> Iterator[str]:
    """Runs of at least MIN_LETTERS (a shorter one never makes a word)."""
    return _RUN.findall(text) if len(text) <= _WHOLE else (m.group() for m in _RUN.finditer(text))


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def noised(prefix: int, run: str) -> str:
    """``run`` without the letter that its document's crc picks, if any."""
    h = zlib.crc32(run.encode(), prefix)
    if h % NOISE:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def counted(batches):
    held: Counter = Counter()

    def out():
        words = list(held)
        for a in range(0, len(words), 50_000):
            part = words[a:a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py()
            if not text:
                continue
            prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(_runs(text)).items():
                word = noised(prefix, lowered(run))
                if len(word) >= MIN_LETTERS:
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield from out()
                held.clear()
    yield from out()


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of the words that occur often enough."""
    part = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- grams

def _grams(batches):
    held: Counter = Counter()
    for batch in batches:
        for w in batch.column("word").to_pylist():
            for q in range(SHORT, LONG + 1):
                held.update([w[p:p + q] for p in range(len(w) - q + 1)])
        if len(held) > HELD_WORDS:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])
            held.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])


def gram_dictionary(words: DataFrame, min_gram: int = MIN_GRAM) -> dict[str, int]:
    """The frequent grams and their counts, at most GRAM_SHARE of a length."""
    grams = words.select("word").mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    with scratch(words.sparkSession) as stage:
        grams = stage(grams.where(F.col("n") >= min_gram), "grams")
        total = {r["q"]: r["n"] for r in grams.groupBy(F.length("gram").alias("q")).agg(F.sum("n").alias("n")).collect()}
        enough = F.lit(False)
        for q, n in total.items():
            enough = enough | ((F.length("gram") == q) & (F.col("n") * GRAM_SHARE >= n))
        return {r["gram"]: r["n"] for r in grams.where(enough).collect()}


class Index:
    """Decomposition by a gram dictionary, and what one edit can affect."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.grams = {g for g in counts if len(g) > SHORT}
        self.heads = {g[:k] for g in self.grams for k in range(SHORT, len(g))}
        self.tails = {g[-k:] for g in self.grams for k in range(SHORT, len(g))}

    def decompose(self, w: str) -> list[tuple[int, int]]:
        """``(start, end)`` of the word's grams."""
        out, reach = [], 0
        for p in range(len(w) - SHORT + 1):
            e = p + SHORT
            for q in range(min(LONG, len(w) - p), SHORT, -1):
                if w[p:p + q] in self.grams:
                    e = p + q
                    break
            if e > reach:
                out.append((p, e))
                reach = e
        return out

    def _left(self, w: str, i: int) -> int:
        """Smallest start from which a gram could stretch over the edit before
        letter i."""
        for a in range(max(0, i - LONG + 1), i - SHORT + 1):
            if w[a:i] in self.heads:
                return a
        return i - SHORT + 1

    def _right(self, w: str, i: int) -> int:
        """Largest end that a gram from before letter i could reach."""
        for e in range(min(len(w), i + LONG - 1), i + SHORT - 1, -1):
            if w[i:e] in self.tails:
                return e
        return i + SHORT - 1

    def affected(self, w: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit can affect."""
        most = 0
        for i in range(len(w) + 1):
            a, b = self._left(w, i), self._right(w, i)
            # a letter put in before letter i
            most = max(most, sum((p < i < e) or (e <= i and p >= a) or (p >= i and e <= b) for p, e in grams))
            if i < len(w):  # letter i replaced or dropped
                b = self._right(w, i + 1)
                most = max(most, sum((p <= i < e) or (e <= i and p >= a) or (p > i and e <= b) for p, e in grams))
        return most

    def _listed(self, w: str, grams, most: int, tag: str) -> Iterator[tuple[str, str, int]]:
        """Of the ``most + 1`` rarest grams: the list key, and the letters
        beyond the shared side with the side they are on."""
        rank = sorted((self.counts.get(w[p:e], 0), w[p:e], p, e) for p, e in grams)
        if most + 1 < len(rank):  # equal grams go together
            last = rank[most][:2]
            rank = [r for r in rank if r[:2] <= last]
        for _, g, p, e in rank:
            yield f"{tag}<{g}<{w[:p]}", w[e:], 1
            yield f"{tag}>{g}>{w[e:]}", w[:p], 0

    def lists(self, w: str) -> Iterator[tuple[str, str, int]]:
        grams = self.decompose(w)
        most = self.affected(w, grams)
        yield from self._listed(w, grams, most, "v")
        if most >= len(grams):  # an edit may leave none of them
            short = [(p, p + SHORT) for p in range(len(w) - SHORT + 1)]
            yield from self._listed(w, short, SHORT, "s")


def key64(key: str) -> int:
    raw = key.encode()
    return zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x9E3779B9)


def _keys(shared):
    def keys(batch):
        index = shared.value
        yield np.array([key64(k) for w in batch.column("word").to_pylist() for k, _, _ in index.lists(w)], np.uint64)
    return keys


def postings(shared, sizes, longest: int):
    """Words to rows of the lists they are in; a long list's rows go by what
    is left of the other side without one letter."""
    def post(batches):
        index, size = shared.value, sizes.value
        mask = len(size) - 1
        for batch in batches:
            keys, at = [], []
            for i, w in enumerate(batch.column("word").to_pylist()):
                own = set()
                for key, rest, _ in index.lists(w):
                    k = key64(key)
                    if size[k & mask] <= longest:
                        own.add(k)
                    else:
                        own.update(key64(f"{key}|{rest[:j]}{rest[j + 1:]}") for j in range(len(rest)))
                        own.add(key64(f"{key}|{rest}"))
                keys += own
                at += [i] * len(own)
            rows = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), rows.column("word"), rows.column("n")], ["key", "word", "n"])
    return post


# ---------------------------------------------------------------- pairs

def near(a: str, b: str) -> bool:
    """Exactly one inserted, dropped or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def merged(batches):
    """Rows sorted by list key to near words, both ways round.  A list is
    short: longer ones were parted before."""
    last, words = None, []

    def pairs():
        by_size: dict[int, list] = {}
        for w in words:
            by_size.setdefault(len(w[0]), []).append(w)
        for size, some in by_size.items():
            for k, (a, n) in enumerate(some):
                for b, m in (*some[k + 1:], *by_size.get(size + 1, ())):
                    if near(a, b):
                        yield a, b, m
                        yield b, a, n

    def out(found):
        columns = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["word", "other", "m"])

    for batch in batches:
        found = []
        for key, w, n in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n"))):
            if key != last:
                found += pairs()
                last, words = key, []
            words.append((w, n))
        yield out(found)
    yield out(list(pairs()))


def near_words(words: DataFrame, min_gram: int = MIN_GRAM, longest: int = LIST_WORDS) -> DataFrame:
    """``(word, other, m)`` for every two near words, both ways; m is the
    other's count."""
    sc = words.sparkSession.sparkContext
    index = sc.broadcast(Index(gram_dictionary(words, min_gram)))
    sizes = sc.broadcast(histogram(words.select("word"), _keys(index), LIST_BITS))
    rows = words.select("word", "n").mapInArrow(postings(index, sizes, longest), "key long, word string, n long")
    rows = rows.repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(merged, "word string, other string, m long").distinct()


def roots(forms: DataFrame, stage) -> DataFrame:
    """``(word, root)`` of the words that have a form.  A form is FORM_RATIO
    times as frequent as its word, so the longest chain has a logarithm of the
    largest count as length; each round takes one step of all open chains."""
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    open_, done = stage(forms.select("word", F.col("form").alias("root")), "open"), []
    while not open_.isEmpty():
        moved = stage(open_.join(step, "root", "left"), "moved")
        done.append(moved.where(F.col("next").isNull()).select("word", "root"))
        open_ = moved.where(F.col("next").isNotNull()).select("word", F.col("next").alias("root"))
    out = forms.select("word", F.col("form").alias("root")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def spelling_groups(docs: DataFrame, min_gram: int = MIN_GRAM, longest: int = LIST_WORDS) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word."""
    with scratch(docs.sparkSession) as stage:
        words = stage(word_counts(docs), "words")
        pairs = near_words(words, min_gram, longest)
        best = F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best")
        by_word = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
        joined = words.join(by_word, "word", "left")
        m = -F.col("best.m")
        formed = m >= FORM_RATIO * F.col("n")
        found = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"),
                                    F.when(formed, m).alias("form_n")), "found")
        to_root = roots(stage(found.where(F.col("form").isNotNull()).select("word", "form"), "forms"), stage)
        return staged(found.join(to_root, "word", "left").withColumn("root", F.coalesce("root", "word")), "spelling")
