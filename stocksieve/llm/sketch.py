"""Fixed-size histograms and bit filters of hashes over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .components import lean

_BLOCK = 1 << 14
_SCHEMA = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
_DDL = "block int, counts binary"


def _rows(counts: np.ndarray):
    for k in range(len(counts) // _BLOCK):
        part = counts[k * _BLOCK:(k + 1) * _BLOCK]
        if part.any():
            yield pa.RecordBatch.from_pylist([{"block": k, "counts": part.tobytes()}], _SCHEMA)


def histogram(df: DataFrame, hashes: Callable, bits: int) -> np.ndarray:
    """How many hashes fall in each of ``2**bits`` slots (by their low bits).
    ``hashes`` gives a batch's arrays of uint64.  A task sends its non-empty
    blocks of slots, blocks are added up, and 4 * 2**bits bytes reach the
    driver, whatever the table's size."""
    size = max(1 << bits, _BLOCK)

    def count(batches):
        counts = np.zeros(size, np.uint32)
        for batch in batches:
            for h in hashes(batch):
                counts += np.bincount((h & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=size).astype(np.uint32)
        yield from _rows(counts)

    return _gathered(df.mapInArrow(count, _DDL), np.add, np.uint32, size)


def presence(df: DataFrame, hashes: Callable, bits: int) -> np.ndarray:
    """In which of ``2**bits`` slots hashes fall, eight slots a byte: an eighth
    of ``2**bits`` bytes reach the driver.  ``present`` reads it."""
    size = max((1 << bits) // 8, _BLOCK)

    def mark(batches):
        found = np.zeros(8 * size, bool)
        for batch in batches:
            for h in hashes(batch):
                found[_slot(h, size)] = True
        yield from _rows(np.packbits(found, bitorder="little"))

    return _gathered(df.mapInArrow(mark, _DDL), np.bitwise_or, np.uint8, size)


def _slot(h: np.ndarray, size: int) -> np.ndarray:
    return (h & np.uint64(8 * size - 1)).astype(np.int64)


def present(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the slots of hashes are marked."""
    slot = _slot(h, len(marks))
    return (marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _gathered(parts: DataFrame, both: Callable, kind: type, size: int) -> np.ndarray:
    """The tasks' blocks, those of one place put together by ``both``."""
    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(raw, kind)
                held[k] = both(held[k], part) if k in held else part
        for k, part in held.items():
            yield pa.RecordBatch.from_pylist([{"block": k, "counts": part.tobytes()}], _SCHEMA)

    with lean(parts.sparkSession):
        got = parts.repartition("block").mapInArrow(add, _DDL).toArrow()
    out = np.zeros(size, kind)
    for k, raw in zip(got.column("block").to_pylist(), got.column("counts")):
        out[k * _BLOCK:(k + 1) * _BLOCK] = np.frombuffer(raw.as_buffer(), kind)
    return out
