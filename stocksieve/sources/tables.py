"""Readers for the driver tables (one parquet file per table).

Reads are lazy: column pruning and filter pushdown happen when the plan is
optimised, so callers never ``select('*')`` more than they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# Large tables whose rows feed per-row heavy work (text/HTML parsing, wide
# derivations).  Tables that are aggregated straight after the scan
# (events, conversations) gain nothing from spreading: the partial
# aggregate already shrinks them inside the scan task.
FACT_TABLES = {"lineitem", "orders", "documents", "pages"}


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Give row-local work at least one task per core.

    A scan yields one partition per file split; a small file with a single
    row group is one task however many cores there are.  When the scan has
    fewer partitions than the default parallelism, a round-robin
    repartition spreads it (filters and column pruning still reach the
    scan: both are pushed below the repartition).  On a cluster reading
    many splits the condition is false and the plan is untouched."""
    try:
        cores = spark.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access: leave the scan as is
        return df
    return df.repartition(cores) if splits < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in DRIVER_TABLES:
        raise KeyError(f"unknown driver table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(spark, df) if name in FACT_TABLES else df


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in DRIVER_TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]

    def get(self, name: str) -> DataFrame:
        return getattr(self, name)
