"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled within their source by the md5 of their id.  Copy e of
a document (e = 0, 1, ...) has the virtual finish time

    (e * words of its source + words of the source up to and with it) / target

where target is what the source is due.  The copies of all sources are put in
order of that time, and the mix is cut at its total budget: each source has
then had its share, to within one document.

Targets: sources in order of code point (null last) weigh 5, 2, 1, 5, 2, ...
and share all words by weight; a target stops at ``MAX_COPIES`` times its
source's words and the excess goes to the others by weight.

DataFrame operations only.  Running sums are two-level: a group of the shuffle
(source, the first characters of the md5) is summed first, the sums of a
source's groups are accumulated over at most ``16**GROUP_CHARS`` rows, and only
then documents within a group, so a source with a third of all rows is spread
over its groups.  The cut works the same way over slices of virtual time.

Cases: null or empty text has size 0 and takes 0; a null source is a source of
its own, last in order; a null id is shuffled as the empty text; repeated rows
are documents of their own; a table without words takes nothing (target 0);
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import row_number_by_range
from ..session import shared_path

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
GROUP_CHARS = 3  # 4,096 groups of the shuffle a source
SLICES = 4096  # of virtual time
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words: the runs of white space between words, and one."""
    inner = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.coalesce(inner, F.lit("")) == "", 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(source, source_size, weight, target)`` of ``(source, source_size)``.

    The level is the words a weight of 1 is due.  Sources whose cap lies under
    their due are capped, the rest's level rises, until no more are; each
    round sends one row of sums to the driver."""
    ranked = row_number_by_range(sizes, "source", "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    due = ranked.select("source", "source_size", weight.alias("weight"))
    path = shared_path(sizes.sparkSession, "mix-sources", unique=True)
    due.write.parquet(path)
    due = sizes.sparkSession.read.parquet(path)
    cap = F.col("source_size") * max_copies
    total, level, capped = None, 0.0, -1
    while True:
        # words and weights are whole numbers: the sums are exact
        is_capped = F.lit(False) if total is None else cap < F.lit(level) * F.col("weight")
        row = due.agg(F.sum("source_size").alias("total"), F.sum(F.when(is_capped, cap).otherwise(0)).alias("caps"),
                      F.sum(F.when(is_capped, 0).otherwise(F.col("weight"))).alias("open"),
                      F.count(F.when(is_capped, 1)).alias("n")).first()
        total = row["total"] or 0
        if row["n"] == capped or not row["open"]:
            break
        capped = row["n"]
        level = float(total - row["caps"]) / float(row["open"])
    return due.select("source", "source_size", "weight", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(doc_id, size, source, source_size, target, copies, taken)`` for
    every row of ``docs``."""
    spark = docs.sparkSession
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), order.alias("shuffle"))
    path = shared_path(spark, "mix-sized", unique=True)
    sized.write.parquet(path)  # texts are read once; every step below reads four narrow columns
    sized = spark.read.parquet(path).withColumn("part", F.substring("shuffle", 1, GROUP_CHARS))

    due = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies)
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))
    # repeated rows are told apart by a number; they are alike, so any order serves
    inside = Window.partitionBy("source", "part").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("here", F.sum("size").over(inside))
    placed = (placed.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
              .join(due.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t")))
              .select("doc_id", "source", "size", "shuffle", "source_size", "target", (F.col("before") + F.col("here")).alias("upto")))

    copies = placed.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))))
    finish = (F.col("copy") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
    copies = copies.withColumn("finish", finish).where(F.col("finish") <= 1.0)
    # cut at the total budget, which is the sum of the sources' targets
    slice_ = F.floor(F.col("finish") * SLICES)
    copies = copies.withColumn("slice", slice_)
    slices = copies.groupBy("slice").agg(F.sum("size").alias("words"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES + 1 rows at most
    slices = slices.select(F.col("slice").alias("l"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("slice").orderBy("finish", F.col("source").asc_nulls_last(), "shuffle", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    budget = due.agg(F.round(F.sum("target")).cast("long").alias("budget"))
    taken = (copies.withColumn("run", F.sum("size").over(within)).join(F.broadcast(slices), F.col("slice") == F.col("l"))
             .join(F.broadcast(budget), F.col("earlier") + F.col("run") <= F.col("budget"))
             .groupBy("source", "shuffle", "doc_id", "upto").agg(F.count("*").alias("copies")))
    keys = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in ("source", "shuffle", "doc_id", "upto")]
    taken = taken.select(*[F.col(c).alias(f"k_{c}") for c in ("source", "shuffle", "doc_id", "upto")], "copies")
    n = F.coalesce("copies", F.lit(0)).cast("long")
    out = placed.where("size > 0").join(taken, keys, "left").select(
        "doc_id", "size", "source", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))
    none = placed.where("size = 0").select("doc_id", "size", "source", "source_size", "target", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken"))
    return out.unionByName(none)
