"""N-gram Jaccard join: every pair of documents whose sets of 5-word shingles
have 100 * intersection >= 75 * union, as classes and components.

1. ``signatures``: each document's set size, the hash of its set (documents of
   one set are a class; only classes go on), a parity bitmap of the set and a
   few minima of the set under different orders.
2. ``stars``: classes that share a minimum are held against one of them, the
   one whose minima are the most shared: of near copies of one text mostly that
   text itself.  That is one row a class and minimum, grouped by a partial
   maximum, and ties large groups of near copies together before any pairs are
   looked at.
3. ``runs``: classes that can be linked share one of the first
   ``n - ceil(0.75 n) + 1`` shingles of their sets in any common order.  The
   order puts shingles of crowded slots of a corpus-wide histogram last, then
   goes by hash, so passages that many documents share hardly ever count.  With
   ``k`` more shingles each, linked classes share ``k + 1`` of them (``spare``):
   classes that share fewer with all others go, so a shingle that unlike texts
   have by chance makes no rows, however many texts there are.  Only shingles
   shared by classes that step 2 has not tied together stay.
4. ``tiles``: the classes of a shingle lie in order of size; each is held
   against those whose size is within the band that 0.75 allows, through the
   bitmaps: a bit that differs is a shingle that one of the two lacks, so
   ``7 * differing bits <= n1 + n2`` must hold for a pair to be linked.  A
   first pass over the tiles sends only as many passing pairs as would tie a
   tile's classes together (fewer than its rows); what they tie is left out of
   the second, which sends every pair that passes between components.  A row
   brings along the first ``EARLIER`` tiles of its class: a pair whose lists
   share an earlier tile was sent there; any that several tiles still send is
   made one by ``distinct``.
5. Pairs that pass are intersected exactly (sorted arrays of 64-bit hashes).
6. Components over the links; a document's is its smallest reachable doc_id.

The bitmap of a set has two to four bits a shingle; two sets of different width
are compared at the smaller width, to which the larger folds by xor.

Cases: documents without words have n_shingles 0 and are their own component;
one with under five words has its whole sequence as its only shingle; null ids
take part, and a component without any id is null; repeated rows fall in one
class; other columns are not read.  Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .components import components, followed, scratch, staged, with_field
from .sketch import histogram, presence, present

SHINGLE = 5
SLOT_BITS = 20  # of the histogram of shingles: 4 MB
FILTER_BITS = 22  # of the filter of wanted classes: 0.5 MB
MINIMA = 6
CROWDED = 4  # times the mean slot
SPARE = 8  # one shingle in so many is sent beyond the prefix
EARLIER = 16  # tiles of a class by which pairs met before are known
_SALTS = [X.U((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64) for k in range(MINIMA)]
_CLASS = X.U(0xD1B54A32D192ED03)
_MEMBER = "key long, cls long, n int, early boolean"


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - (3 * n + 3) // 4 + 1


def spare(n: np.ndarray) -> np.ndarray:
    """How many shingles a set of n sends beyond ``prefix_size``."""
    return n // SPARE


def least_shared(n: Column) -> Column:
    """How many of the shingles that a set of n sends a set linked with it sends
    too, at least: one more than the smallest such set spares."""
    return F.floor(F.floor((3 * n + 3) / 4) / SPARE) + 1


def width(n: int) -> int:
    """Bits of the bitmap of a set of n: a power of two."""
    return min(1 << 16, max(64, 1 << int(2 * n - 1).bit_length()))


def class_hash(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of each sorted set, 0 for the empty one."""
    place = np.arange(len(sets)) - np.repeat(bounds[:-1], np.diff(bounds))
    terms = X.mix(sets + place.astype(X.U) * _CLASS)
    sums = np.concatenate([np.zeros(1, X.U), np.cumsum(terms, dtype=X.U)])
    n = np.diff(bounds)
    return np.where(n > 0, X.mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(X.U)), X.U(0)).view(np.int64)


def parity(s: np.ndarray) -> bytes:
    """Bitmap whose bit is set when an odd number of shingles fall on it."""
    w = width(len(s))
    odd = np.bincount(((s >> X.U(7)) & X.U(w - 1)).astype(np.int64), minlength=w) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sets(batch):
    """``(first row, sets, bounds)`` of a batch's pieces."""
    for first, data, offsets in X.pieces(batch.column("text")):
        yield first, *X.shingle_sets(data, offsets, SHINGLE)


def _signatures(batches):
    for batch in batches:
        for first, sets, bounds in _sets(batch):
            n = np.diff(bounds)
            rows = len(n)
            maps = [parity(sets[a:b]) if b > a else b"" for a, b in zip(bounds[:-1], bounds[1:])]
            full = n > 0
            minima = np.zeros((rows, MINIMA), X.U)
            if full.any():
                for k, salt in enumerate(_SALTS):
                    minima[full, k] = np.minimum.reduceat(X.mix(sets ^ salt), bounds[:-1][full])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(first, rows), pa.array(class_hash(sets, bounds)), pa.array(n.astype(np.int64)),
                pa.array(maps, pa.binary()), pa.array(list(minima.view(np.int64)), pa.list_(pa.int64()))],
                ["doc_id", "cls", "n", "bits", "minima"])


def _shingles(batch):
    for _, sets, _ in _sets(batch):
        yield sets


def _prefixes(shared):
    def rows(batches):
        crowd = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, sets, bounds in _sets(batch):
                n = np.diff(bounds)
                cls = class_hash(sets, bounds)
                fresh = np.zeros(len(n), bool)
                for i in np.flatnonzero(n > 0):
                    c = int(cls[i])
                    if c not in seen:  # copies within a task are sent once
                        seen.add(c)
                        fresh[i] = True
                row = np.repeat(np.arange(len(n)), n)
                keep = fresh[row]
                sets, row = sets[keep], row[keep]
                rank = crowd[(sets & X.U(len(crowd) - 1)).astype(np.int64)]
                order = np.lexsort((sets, rank, row))
                sets, row = sets[order], row[order]
                first = np.searchsorted(row, np.arange(len(n)))
                place = np.arange(len(row)) - first[row]
                early = place < prefix_size(n)[row]
                keep = place < (prefix_size(n) + spare(n))[row]
                sets, row, early = sets[keep], row[keep], early[keep]
                yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64)), pa.array(cls[row]), pa.array(n[row].astype(np.int32)), pa.array(early)],
                                                 ["key", "cls", "n", "early"])
    return rows


def _signed(table, cls: np.ndarray, double: np.ndarray, start: np.ndarray):
    """The rows with ``same``, one number of the classes of their key."""
    terms = np.where(double, X.U(0), X.mix(cls.view(X.U) ^ _CLASS))
    sums = X.mix(np.add.reduceat(terms, start))
    return table.append_column("same", pa.array(np.repeat(sums, np.diff(np.append(start, len(cls)))).view(np.int64)))


def _shared_runs(column: str, names: list[str]):
    """From rows sorted by key: those of keys with two or more values of a
    column.  Rows pass through; only a key's rows before its second value wait,
    and of those alike in that column and in cls one does."""
    def rows(batches):
        held = None  # of the last key: rows still waiting, and the value
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            if held is not None:
                batch = pa.concat_tables([held, batch])
            key = batch.column("key").to_numpy()
            value = batch.column(column).to_numpy()
            if not len(key):
                continue
            new = np.concatenate([[True], key[1:] != key[:-1]])
            start = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            mixed = np.logical_or.reduceat(value != value[start][run], start)
            cls = batch.column("cls").to_numpy()
            double = np.concatenate([[False], (key[1:] == key[:-1]) & (cls[1:] == cls[:-1])])
            last = run == run[-1]
            batch = _signed(batch, cls, double, start)
            out = batch.filter(pa.array(mixed[run] & ~double & ~last)).select(names)
            yield from out.to_batches()
            # the last key may go on in the next batch
            held = batch.filter(pa.array(last & ~double)).drop_columns(["same"])
        if held is not None and held.num_rows and len(np.unique(held.column(column).to_numpy())) > 1:
            held = _signed(held, held.column("cls").to_numpy(), np.zeros(held.num_rows, bool), np.zeros(1, np.int64))
            yield from held.select(names).to_batches()
    return rows


def _matrix(maps: list[bytes], w: int) -> np.ndarray:
    """Bitmaps at width w (folded from twice that) as words."""
    out = np.empty((len(maps), w // 64), X.U)
    for k, m in enumerate(maps):
        words = np.frombuffer(m, X.U)
        while len(words) > w // 64:
            words = words[:len(words) // 2] ^ words[len(words) // 2:]
        out[k] = words
    return out


def tile_pairs(cls: np.ndarray, n: np.ndarray, root: np.ndarray, maps: list[bytes]):
    """Index pairs of one tile (sorted by size) that the bitmaps let pass."""
    widths = np.array([8 * len(m) for m in maps])
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        upper = int(np.searchsorted(n, (4 * n[rows[-1]]) // 3, side="right"))
        near = np.arange(rows[0], max(upper, rows[-1] + 1))
        at = _matrix([maps[j] for j in near], int(w))
        for i in rows:
            end = int(np.searchsorted(n, (4 * n[i]) // 3, side="right"))
            j = np.arange(i + 1, end)
            j = j[root[j] != root[i]]
            if len(j):
                apart = np.bitwise_count(at[j - rows[0]] ^ at[i - rows[0]]).sum(axis=1, dtype=np.int64)
                for k in j[7 * apart <= n[j] + n[i]]:
                    yield i, k


def _forest(pairs, root: np.ndarray):
    """Of the pairs those that join trees not joined before."""
    up = {int(r): int(r) for r in root}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in pairs:
        x, y = top(int(root[i])), top(int(root[j]))
        if x != y:
            up[x] = y
            yield i, j


def _unmet(pairs, start: int, key: int, firsts: pa.ListArray):
    """The pairs of a tile (its rows begin at start) that no smaller tile known
    of both has sent."""
    bounds, keys = firsts.offsets.to_numpy(), firsts.values.to_numpy()
    known: dict[int, frozenset] = {}
    for pair in pairs:
        for i in pair:
            if i not in known:
                own = keys[bounds[start + i]:bounds[start + i + 1]]
                known[i] = frozenset(own[own < key].tolist())
        if known[pair[0]].isdisjoint(known[pair[1]]):
            yield pair


def _tiles(every: bool):
    """Rows sorted by key and size to the pairs of classes that pass: every
    one not known to be sent before, or those that tie a tile's classes."""
    def pairs(table):
        key = table.column("key").to_numpy()
        cls, n, root = (table.column(c).to_numpy() for c in ("cls", "n", "root"))
        maps = table.column("bits").to_pylist()
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        firsts = pa.concat_arrays(table.column("firsts").chunks) if every else None
        found = set()
        for a, b in zip(start, [*start[1:], len(key)]):
            passing = tile_pairs(cls[a:b], n[a:b], root[a:b], maps[a:b])
            for i, j in _unmet(passing, a, int(key[a]), firsts) if every else _forest(passing, root[a:b]):
                (x, r), (y, q) = sorted([(int(cls[a + i]), int(root[a + i])), (int(cls[a + j]), int(root[a + j]))])
                found.add((x, y, min(r, q), max(r, q)))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(4)], ["a", "b", "low", "high"])

    def tiles(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            key = table.column("key").to_numpy()
            before = np.flatnonzero(key != key[-1])  # the last key may go on in the next batch
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield pairs(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield pairs(held)

    return tiles


def _wanted_sets(shared):
    def rows(batches):
        wanted = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, sets, bounds in _sets(batch):
                cls = class_hash(sets, bounds)
                hit = np.flatnonzero(present(wanted, cls.view(X.U)) & (np.diff(bounds) > 0))
                take = []
                for i in hit:
                    if int(cls[i]) not in seen:
                        seen.add(int(cls[i]))
                        take.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(cls[take]), pa.array([sets[bounds[i]:bounds[i + 1]].tobytes() for i in take], pa.binary())], ["cls", "members"])
    return rows


def _intersect(batches):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = (np.frombuffer(v.as_buffer(), X.U) for v in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("low"), batch.column("high")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(docs: DataFrame, pairs: DataFrame, stage) -> DataFrame:
    """Links ``(a, b)`` between components: ``(low, high)`` of the pairs
    ``(a, b, low, high)`` whose classes a and b are linked.  Sets are made
    again from the texts, for the classes that occur in a pair (a fixed-size
    filter keeps nearly all others out, the joins the rest)."""
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    shared = spark.sparkContext.broadcast(presence(ends, lambda batch: [batch.column("cls").to_numpy().view(X.U)], FILTER_BITS))
    sets = docs.select("text").mapInArrow(_wanted_sets(shared), "cls long, members binary").join(ends, "cls", "left_semi").dropDuplicates(["cls"])
    sets = stage(sets, "sets")
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("set_a")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("members").alias("set_b")), "b").select("low", "high", "set_a", "set_b")
    return both.mapInArrow(_intersect, "a long, b long")


def _bounded(batches):
    """Pairs with both bitmaps that the bound lets pass, and how many bits
    differ."""
    for batch in batches:
        apart = np.array([int(np.bitwise_count(_matrix([x], w) ^ _matrix([y], w)).sum())
                          for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
                          for w in [8 * min(len(x), len(y))]], np.int64)
        keep = 7 * apart <= batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("centre"), pa.array(apart)], ["cls", "centre", "apart"]).filter(pa.array(keep))


def stars(classes: DataFrame, stage) -> DataFrame:
    """Pairs ``(a, b, low, high)``: a class and its star's centre.  The classes of a
    minimum have as centre the one whose minima are the most shared; of a
    class's centres the nearest by bitmaps is taken, so there are no more pairs
    than classes."""
    each = classes.select("cls", F.posexplode("minima").alias("order", "least"))
    shared = each.groupBy("order", "least").agg(F.count("*").alias("size")).where("size > 1")
    each = stage(each.join(shared, ["order", "least"]), "minima")
    known = stage(each.groupBy("cls").agg(F.sum("size").alias("known")), "known")
    centre = each.join(known, "cls").groupBy("order", "least").agg(F.max(F.struct("known", "cls")).alias("m"))
    centre = centre.select("order", "least", F.col("m.cls").alias("centre"))
    pairs = each.join(centre, ["order", "least"]).where("cls <> centre").select("cls", "centre").distinct()
    sized = classes.select("cls", "n", "bits")
    pairs = pairs.join(sized.toDF("cls", "n_a", "bits_a"), "cls").join(sized.toDF("centre", "n_b", "bits_b"), "centre")
    pairs = pairs.where((F.col("n_a") * 4 >= F.col("n_b") * 3) & (F.col("n_b") * 4 >= F.col("n_a") * 3))
    near = pairs.select("cls", "centre", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_bounded, "cls long, centre long, apart long")
    near = near.groupBy("cls").agg(F.min(F.struct("apart", "centre")).alias("m"))
    near = near.select(F.least("cls", "m.centre").alias("a"), F.greatest("cls", "m.centre").alias("b")).distinct()
    return near.select("a", "b", F.col("a").alias("low"), F.col("b").alias("high"))


def _linkable(runs: DataFrame) -> DataFrame:
    """The early rows of the classes that share enough to be linked."""
    met = runs.groupBy("cls").agg(F.count("*").alias("met"), F.first("n").alias("n"))
    return runs.where("early").join(met.where(F.col("met") >= least_shared(F.col("n"))).select("cls"), "cls", "left_semi").select("key", "cls", "n")


def _apart(members: DataFrame, classes: DataFrame, roots: DataFrame, every: bool, stage) -> DataFrame:
    """The rows of the shingles that different components share, with bitmaps
    (and, for every pair, the class's smallest such shingles), sorted by
    shingle and size."""
    rooted = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("root"))
    rooted = rooted.repartition("key").sortWithinPartitions("key", "cls")
    apart = stage(rooted.mapInArrow(_shared_runs("root", ["key", "cls", "n", "root", "same"]), "key long, cls long, n int, root long, same long"), "runs-apart")
    # shingles with the same classes make the same tile: one of them is enough
    one = apart.groupBy("same").agg(F.min("key").alias("key"))
    apart = apart.join(one, ["same", "key"], "left_semi")
    names = ["key", "cls", F.col("n").cast("long").alias("n"), "root"]
    if every:  # dealt by class, as the join below is
        place = F.row_number().over(Window.partitionBy("cls").orderBy("key"))
        first = F.when(place <= EARLIER, F.col("key"))
        names.append("firsts")
        apart = apart.withColumn("first", first).withColumn("firsts", F.collect_list("first").over(Window.partitionBy("cls")))
    tiles = apart.join(classes.select("cls", "bits"), "cls").select(*names, "bits")
    return tiles.repartition("key").sortWithinPartitions("key", "n", "cls")


def grouped(docs: DataFrame) -> DataFrame:
    """``(doc_id, cls, n, root, first_id, component_id)`` for every row: the
    class of its set, the class that stands for its component, the smallest
    ids of both (null where n is 0: such rows are in no class)."""
    signed = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                    .mapInArrow(_signatures, "doc_id long, cls long, n long, bits binary, minima array<long>"), "signatures")
    with scratch(docs.sparkSession) as stage:
        placed = staged(_placed(docs, signed, stage), "placed")
    return signed.select("doc_id", "cls", "n").join(placed, "cls", "left")


def _placed(docs: DataFrame, signed: DataFrame, stage) -> DataFrame:
    """``(cls, root, first_id, component_id)`` of every class.  ``stage`` holds
    what all steps need, a scratch of its own what one step does."""
    spark = docs.sparkSession
    texts = docs.select("text")
    # members of a class have the same set, so any one's bitmap serves
    classes = signed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"),
                                                     F.first("bits").alias("bits"), F.first("minima").alias("minima"))
    classes = stage(classes, "classes")
    with scratch(spark) as own:
        pairs = stage(stars(classes, own), "star-pairs")
    roots = _tied(docs, pairs, None, stage)

    counts = histogram(texts, _shingles, SLOT_BITS)
    mean = max(1.0, counts.sum() / max(1, np.count_nonzero(counts)))
    crowd = np.floor(np.log2(np.maximum(counts / (CROWDED * mean), 0.5))).astype(np.int8)  # -1: not crowded
    keys = texts.mapInArrow(_prefixes(spark.sparkContext.broadcast(crowd)), _MEMBER)
    keys = keys.repartition("key").sortWithinPartitions("key", "cls")
    with scratch(spark) as own:
        members = stage(_linkable(own(keys.mapInArrow(_shared_runs("cls", ["key", "cls", "n", "early"]), _MEMBER), "runs")), "members")
    for every in (False, True):
        with scratch(spark) as own:
            more = _apart(members, classes, roots, every, own).mapInArrow(_tiles(every), "a long, b long, low long, high long")
            if every:
                more = more.distinct()
            else:  # one pair for two components is enough to try
                more = more.groupBy("low", "high").agg(F.min(F.struct("a", "b")).alias("m")).select("m.a", "m.b", "low", "high")
            more = stage(more, "tile-pairs")
        roots = _tied(docs, more, roots, stage)
    placed = classes.select("cls", "first_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "first_id", F.coalesce("root", "cls").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return placed.join(smallest, "root").select("cls", "root", "first_id", "component_id")


def _tied(docs: DataFrame, pairs: DataFrame, roots: DataFrame | None, stage) -> DataFrame:
    """``roots`` of the classes that have a link, after those among ``pairs``."""
    with scratch(docs.sparkSession) as own:
        found = components(own(verified(docs, pairs, own), "links"))
        if roots is not None:
            found = followed(roots, found).unionByName(found.join(roots, "node", "left_anti"))
        return stage(found, "roots")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, class_id)`` for every row."""
    own = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id"))
    return grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), own("component_id").alias("component_id"),
                                own("first_id").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all their columns) without near copies: of each
    component the document of smallest id stays (a null id comes last), of its
    repeated rows one; rows without words all stay."""
    names = docs.columns
    rows = staged(grouped(docs).where("n > 0"), "grouped")
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("m"))
    chosen = chosen.select(F.col("m.doc_id").alias("id_kept"), F.col("m.cls").alias("cls_kept"))

    def marked(batches):
        for batch in batches:
            cls = [class_hash(sets, bounds) for _, sets, bounds in _sets(pa.record_batch([batch.column("carried").field("text")], ["text"]))]
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(np.concatenate(cls) if cls else np.zeros(0, np.int64))], ["carried", "cls"])

    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("carried"))
    carried = carried.mapInArrow(marked, with_field(carried.schema, "cls", T.LongType()))
    kept = carried.where("cls <> 0").join(chosen, (F.col("cls") == F.col("cls_kept")) & F.col("carried.doc_id").eqNullSafe(F.col("id_kept")), "left_semi")
    kept = kept.groupBy("cls", F.col("carried.doc_id").alias("id")).agg(F.min("carried").alias("carried"))
    every = kept.select("carried").unionByName(carried.where("cls = 0").select("carried"))
    return every.select(*[F.col("carried")[c].alias(c) for c in names])
