"""Incremental ingest of landed pages into the snapshot store.

Landed page files arrive in a folder through the day.  A file-source
stream picks up only new files (tracked in the checkpoint), parses them
with the same row-local parsers as the batch path and writes each
micro-batch into the snapshot store.  Each batch lands in its own
``batch=<id>`` sub-folder written in overwrite mode, so a replayed batch
(after a failure, ``foreachBatch`` is at-least-once) replaces its own
output instead of duplicating it.  ``trigger(availableNow=True)`` turns
the stream into a restartable catch-up job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.snapshots import PARTITION, prepare_for_write

LANDED_PAGE_SCHEMA = T.StructType([
    T.StructField("date_insert", T.DateType(), True),
    T.StructField("page", T.IntegerType(), True),
    T.StructField("html", T.StringType(), True),
])


def batch_writer(target: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        (prepare_for_write(batch).write.mode("overwrite")
         .partitionBy(PARTITION).parquet(f"{target}/batch={batch_id}"))
    return write


def ingest_landed(spark: SparkSession, landing: str, target: str, checkpoint: str,
                  parse: Callable[[DataFrame], DataFrame],
                  schema: T.StructType = LANDED_PAGE_SCHEMA, max_files: int = 64) -> None:
    """Run the landing -> snapshot stream until all present files are done."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .parquet(landing))
    query = (parse(stream).writeStream
             .foreachBatch(batch_writer(target))
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """All batches of the target as one table (``batch`` folder dropped)."""
    df = spark.read.option("mergeSchema", "true").option("basePath", target).parquet(f"{target}/batch=*")
    return df.drop("batch")
