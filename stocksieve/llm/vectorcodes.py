"""Vector code compression: product quantisation with one 256-entry codebook a
part, over integer components.

Per-dimension value dictionaries: vectors are kept in blocks of ``BLOCK_ROWS``
rows; a block holds, for each dimension, its distinct integers and one two-byte
dictionary code a row.  A pass tabulates, for each dimension, the squared
differences of the block's distinct integers to all entries; the distance of a
part is then a gather from that table by dictionary code and an add, for each
of its dimensions.  Blocks are written once and read by every pass; a task
keeps one block and the sums of its entries, so what it needs does not grow
with the table.  Codebooks (256 entries, whatever the table's size) are all
that reaches the driver.

Cases: rows whose vector is null or holds a null or non-finite component are
dropped; vectors of another length than the commonest (ties: the longest) have
null code and error; a length that 4 does not divide gives the first parts one
component more; with fewer than 256 kept rows a codebook has as many entries;
null ids come last among the smallest, equal ids are told apart by their
vector; repeated rows are rows of their own; components are held to a bound
(about 2**30 / sqrt(length)) at which no sum of squares leaves a long; a
label's sum beyond a long is null.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import staged

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK_ROWS = 4096  # places in a block's dictionaries have two bytes
_STRIP = 512  # rows whose distances are held at once
_GROUP = 16  # entries of a row of partial sums
HOT_SHARE = 1000  # a label with a thousandth of the rows is joined by broadcast: at most so many labels


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding as doubles, label)`` of the rows that count."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull()).where(~bad).select("vec_id", x.alias("embedding"), "label")


def integers(flat: np.ndarray, limit: int) -> np.ndarray:
    return np.clip(np.floor(flat * SCALE), -limit, limit).astype(np.int64)


def component_limit(length: int) -> int:
    return math.isqrt((1 << 60) // max(length, 1))


def part_bounds(length: int) -> list[int]:
    each, more = divmod(length, PARTS)
    return [k * each + min(k, more) for k in range(PARTS + 1)]


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def blocks(length: int):
    """Vectors to rows of one block: ids, labels, the distinct integers of each
    dimension back to back, their number, and codes by dimension."""
    limit = component_limit(length)

    def encode(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                x = integers(_matrix(part.column("embedding"), length), limit)
                values, sizes, codes = [], [], []
                for d in range(length):
                    distinct, code = np.unique(x[:, d], return_inverse=True)
                    values.append(distinct)
                    sizes.append(len(distinct))
                    codes.append(code.astype("<u2"))
                joined = [np.concatenate(v).astype(k).tobytes() if v else b"" for v, k in ((values, "<i8"), (codes, "<u2"))]
                row = {"ids": [part.column("vec_id")], "labels": [part.column("label")]}
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), row[k][0]) for k in ("ids", "labels")]
                    + [pa.array([joined[0]], pa.binary()), pa.array([np.array(sizes, "<i4").tobytes()], pa.binary()), pa.array([joined[1]], pa.binary())],
                    ["ids", "labels", "dictionary", "sizes", "codes"])
    return encode


class Block:
    def __init__(self, length: int, batch: pa.RecordBatch, k: int):
        self.ids, self.labels = batch.column("ids")[k].values, batch.column("labels")[k].values
        at = np.concatenate([[0], np.cumsum(np.frombuffer(batch.column("sizes")[k].as_buffer(), "<i4"))])
        flat = np.frombuffer(batch.column("dictionary")[k].as_buffer(), "<i8")
        self.values = [flat[at[d]:at[d + 1]] for d in range(length)]
        self.codes = np.frombuffer(batch.column("codes")[k].as_buffer(), "<u2").reshape(length, len(self.ids))

    def nearest(self, book: np.ndarray, bounds: list[int]):
        """For each part: its rows' nearest entries and squared distances."""
        for a, b in zip(bounds, bounds[1:]):
            n, m = len(self.ids), len(book)
            tables = [(self.values[d][:, None] - book[None, :, d]) ** 2 for d in range(a, b)]
            narrow = sum(int(t.max()) for t in tables) < 1 << 31
            tables = [t.astype(np.int32) if narrow else t for t in tables]
            best, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(0, n, _STRIP):
                rows = slice(i, min(i + _STRIP, n))
                far = np.zeros((rows.stop - i, m), np.int32 if narrow else np.int64)
                term = np.empty_like(far)
                for d, table in zip(range(a, b), tables):
                    np.take(table, self.codes[d, rows], axis=0, out=term, mode="clip")
                    far += term
                best[rows] = far.argmin(axis=1)  # the first of equal ones
                error[rows] = far[np.arange(len(far)), best[rows]]
            yield best, error


def _blocks(length: int, batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(length, batch, k)


_SUMS = "part int, entries int, sums binary"


def partial_sums(length: int, shared):
    """Per task: for every entry the number of its parts and their sum, in rows
    of ``_GROUP`` entries."""
    bounds = part_bounds(length)

    def add(batches):
        book = shared.value
        sums = [np.zeros((ENTRIES, b - a + 1), np.int64) for a, b in zip(bounds, bounds[1:])]
        for block in _blocks(length, batches):
            for part, (best, _) in enumerate(block.nearest(book, bounds)):
                sums[part][:, 0] += np.bincount(best, minlength=ENTRIES)
                for d in range(bounds[part], bounds[part + 1]):
                    # exact: at most 4,096 values below 2**31
                    own = np.bincount(best, weights=block.values[d][block.codes[d]], minlength=ENTRIES)
                    sums[part][:, 1 + d - bounds[part]] += own.astype(np.int64)
        for part, found in enumerate(sums):
            for g in range(0, ENTRIES, _GROUP):
                if found[g:g + _GROUP, 0].any():
                    yield pa.RecordBatch.from_pylist([{"part": part, "entries": g, "sums": found[g:g + _GROUP].tobytes()}], _sums_schema())
    return add


def _sums_schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("entries", pa.int32()), ("sums", pa.binary())])


def _added(batches):
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            key, x = (row["part"], row["entries"]), np.frombuffer(row["sums"], np.int64)
            held[key] = held[key] + x if key in held else x
    for (part, g), x in held.items():
        yield pa.RecordBatch.from_pylist([{"part": part, "entries": g, "sums": x.tobytes()}], _sums_schema())


def next_book(packed: DataFrame, book: np.ndarray, length: int) -> np.ndarray:
    """The codebooks after one round; entries without parts stay."""
    shared = packed.sparkSession.sparkContext.broadcast(book)
    partial = packed.mapInArrow(partial_sums(length, shared), _SUMS)
    rows = partial.repartition("part", "entries").mapInArrow(_added, _SUMS).collect()  # 64 rows
    shared.destroy()
    bounds, out = part_bounds(length), book.copy()
    for r in rows:
        a, b = bounds[r.part], bounds[r.part + 1]
        x = np.frombuffer(r.sums, np.int64).reshape(_GROUP, b - a + 1)
        for entry in np.flatnonzero(x[:, 0]):
            out[r.entries + entry, a:b] = x[entry, 1:] // x[entry, 0]  # floor
    return out


def assigned(length: int, shared):
    bounds = part_bounds(length)

    def assign(batches):
        book = shared.value
        for block in _blocks(length, batches):
            found = list(block.nearest(book, bounds))
            codes = np.stack([best for best, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            error = sum(e for _, e in found)
            size = 2 * PARTS
            yield pa.RecordBatch.from_arrays(
                [block.ids, block.labels, pa.array([codes[k:k + size] for k in range(0, len(codes), size)]), pa.array(error)],
                ["vec_id", "label", "code", "error"])
    return assign


def books_digest(book: np.ndarray, length: int) -> str:
    bounds = part_bounds(length)
    numbers = [str(v) for a, b in zip(bounds, bounds[1:]) for v in book[:, a:b].ravel().tolist()]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def first_book(kept: DataFrame, length: int) -> np.ndarray:
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding", "label").limit(ENTRIES).toArrow()
    return integers(_matrix(first.column("embedding").combine_chunks(), length), component_limit(length))


def with_label_sums(rows: DataFrame) -> DataFrame:
    """``rows`` with the sum of ``error`` over equal labels (nulls together).  A
    label with a thousandth of all rows has its sum broadcast (at most a
    thousand can); all others meet their sums in a join without hot keys."""
    same = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key"), F.col("label").isNull().alias("none")]
    total = rows.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    total = staged(total.select(*same, "label_error", "n"), "label_errors")
    most = total.agg(F.sum("n").alias("all")).first()["all"] or 0
    hot = total.where(F.col("n") * HOT_SHARE >= most).select("key", "none", "label_error")
    keyed = rows.select("*", *same).join(F.broadcast(hot), ["key", "none"], "left").withColumn("hot", F.col("label_error").isNotNull())
    rest = keyed.where(~F.col("hot")).drop("label_error").join(total.where(F.col("n") * HOT_SHARE < most).drop("n"), ["key", "none"], "left")
    columns = ["vec_id", "code", "error", "label", "label_error"]
    return keyed.where("hot").select(*columns).unionByName(rest.select(*columns))


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, code, error, label, label_error, codebooks_sha256)`` of every
    kept row."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors)
    sizes = kept.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = sizes["length"] if sizes else 0
    own = kept.where(F.size("embedding") == length)
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    packed = own.mapInArrow(blocks(length), f"ids array<{id_type}>, labels array<{label_type}>, dictionary binary, sizes binary, codes binary")
    packed = staged(packed, "vector_blocks")
    book = first_book(own, length)
    if len(book):
        for _ in range(rounds):
            book = next_book(packed, book, length)
    shared = spark.sparkContext.broadcast(book)
    done = packed.mapInArrow(assigned(length, shared), f"vec_id {id_type}, label {label_type}, code string, error long")
    other = kept.where(F.size("embedding") != length).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = with_label_sums(staged(done.unionByName(other), "vector_codes"))
    return out.withColumn("codebooks_sha256", F.lit(books_digest(book, length)))
