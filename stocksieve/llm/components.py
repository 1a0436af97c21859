"""Connected components of a link table, as joins and partial aggregations."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path

MAX_ROUNDS = 60


#: Spark then removes a query's shuffle files when the query ends, and cuts what
#: it hands to Python by bytes, so rows of long texts or large sets come few at a time
_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def lean(spark: SparkSession):
    """Settings of a query that runs inside the block."""
    before = {k: spark.conf.get(k, None) for k in _LEAN}
    for k, v in _LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with lean(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lost executors
    read files, they don't run the plan anew.  Its shuffle files go once it is
    written."""
    return _written(df, shared_path(df.sparkSession, name, unique=True))


@contextmanager
def scratch(spark: SparkSession):
    """A ``staged`` whose tables are removed when the block ends; what outlives
    the block must be staged outside it."""
    folder = shared_path(spark, "scratch", unique=True)
    count = 0

    def stage(df: DataFrame, name: str) -> DataFrame:
        nonlocal count
        count += 1
        return _written(df, f"{folder}/{count}-{name}")

    try:
        yield stage
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links (a, b)``: root is the
    smallest node reachable.

    Each round every node takes its smallest neighbour as label (a partial
    minimum, so a node with very many links is no bottleneck), then its
    label's label.  Links are then read between labels: those within one label
    go, equal ones become one, so a round handles only what the one before
    left open.  At the end the rounds' labels are followed from the last to
    the first."""
    with scratch(links.sparkSession) as stage:
        return staged(_settled(links, stage), "roots")


def _between(a: str, b: str) -> list:
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def _settled(links: DataFrame, stage) -> DataFrame:
    rounds = []
    links = stage(links.select(*_between("a", "b")).where("low < high").distinct(), "links")
    while not links.isEmpty():
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
        near = links.select(F.col("high").alias("node"), "low").unionByName(links.select(F.col("low").alias("node"), "low"))
        near = stage(near.groupBy("node").agg(F.min("low").alias("root")), "near")
        jump = near.join(near.toDF("root", "next"), "root").select("node", F.col("next").alias("root"))
        label = stage(jump, "labels")
        rounds.append(label)
        links = links.join(label.toDF("low", "a"), "low").join(label.toDF("high", "b"), "high")
        links = stage(links.select(*_between("a", "b")).where("low < high").distinct(), "links")
    if not rounds:
        return links.toDF("node", "root")
    roots = rounds.pop()
    while rounds:
        roots = followed(rounds.pop(), roots)
    return roots


def followed(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """``labels (node, root)`` with each root replaced by its own in ``roots``,
    where it has one."""
    top = roots.toDF("root", "top")
    return labels.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
