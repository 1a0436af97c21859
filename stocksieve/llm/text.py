"""Vectorised text helpers shared by the operators (numpy over Arrow buffers).

A task works on the UTF-8 buffer of an Arrow string column directly: word
bounds come from a byte lookup, word hashes from prefix sums of a polynomial
over the bytes (mod 2**64), so no Python object is made per word.  Batches are
cut into pieces of about ``PIECE_BYTES`` so the numpy temporaries stay small;
a text longer than that is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_BYTE = (np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(U) << U(1)) | U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# white space of the word rule [^\x20\x09-\x0D]+
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# separators of the feature words: every ASCII byte that is no letter or digit
PUNCT = np.ones(256, dtype=bool)
PUNCT[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    PUNCT[_a:_b] = False

_pow_cache: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, up to n."""
    if len(_pow_cache[0]) <= n:
        size = max(n + 1, PIECE_BYTES + 1)
        for k, base in enumerate((_MULT, _INV)):
            p = np.full(size, base, U)
            p[0] = 1
            _pow_cache[k] = np.multiply.accumulate(p)
    return _pow_cache[0], _pow_cache[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive rows of about ``limit``
    bytes; nulls are empty.  offsets has one entry more than rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_large_binary(texts.type) and not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, n + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:n + 1] = ~sep[data]
    step = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = step[0::2], step[1::2]
    # a word that runs over the start of a row is cut there
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    cuts = cuts[inside[cuts] & inside[cuts + 1]] if len(cuts) else cuts
    if len(cuts):
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def gram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of n consecutive words of one row."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.full(m, U((n * 0xD6E8FEB86659FD93) & (2**64 - 1)))
    for k in range(n):
        h = (h ^ (h >> U(29))) * U(_MULT) + words[k:k + m]
    ok = rows[:m] == rows[n - 1:]
    return mix(h[ok]), rows[:m][ok]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of every row, back to
    back, and the offsets of the rows.  Letters A-Z count as a-z.  A row of
    fewer words has its whole sequence as one shingle, a row without words
    none."""
    low = LOWER[data]
    starts, ends, rows = word_bounds(low, offsets)
    words = word_hashes(low, starts, ends)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    h, at = gram_hashes(words, rows, n)
    for k in range(1, n):  # short rows: their only k-gram is the whole text
        short = np.flatnonzero(count == k)
        if len(short):
            hk, atk = gram_hashes(words, rows, k)
            own = np.isin(atk, short)
            h, at = np.concatenate([h, hk[own]]), np.concatenate([at, atk[own]])
    order = np.argsort(at, kind="stable")
    h, at = h[order], at[order]
    bounds = np.searchsorted(at, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1], bounds[1:]):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, at = h[keep], at[keep]
    return h, np.searchsorted(at, np.arange(len(offsets)))
