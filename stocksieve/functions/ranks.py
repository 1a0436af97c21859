"""Global numbering without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path


def row_number_by_range(df: DataFrame, order: str, out: str) -> DataFrame:
    """Number the rows of ``df`` from 0 in ascending order of a column (null
    last).  Over distinct values this is ``dense_rank() - 1``."""
    return numbered(df, [F.col(order).asc_nulls_last()], out)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number the rows of ``df`` from 0 in a total order.  The frame is
    range-sorted and written once; a row's number is its place in its partition
    plus the rows of the partitions before it, so the only window runs over one
    row a partition."""
    spark = df.sparkSession
    path = shared_path(spark, "ranked", unique=True)
    (df.orderBy(*order)
       .withColumn("__at", F.monotonically_increasing_id())
       .withColumn("__part", F.shiftright("__at", 33))
       .withColumn("__place", F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33))
       .drop("__at").write.parquet(path))
    placed = spark.read.parquet(path)
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
             .select("__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before")))
    return (placed.join(F.broadcast(parts), F.col("__part") == F.col("__p"))  # one row a partition
            .withColumn(out, F.col("__before") + F.col("__place")).drop("__part", "__p", "__place", "__before"))
