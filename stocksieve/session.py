"""Spark session setup and the shared working folder.

Everything in the library is lazy DataFrame code; this module only decides
the session knobs (AQE, shuffle width, broadcast threshold) and where
written intermediate tables live.  On a cluster the shared folder comes
from ``spark.checkpoint.dir``; a private temp folder is only created when
that setting is absent (tests, a laptop).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.util import inheritable_thread_target

# Settings that matter at scale.  AQE re-plans joins from real shuffle sizes
# (broadcast conversion, skew-split) and coalesces small post-shuffle
# partitions; the static broadcast threshold only applies to relations whose
# size estimate is known to be small.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.mergeSchema": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "stocksieve", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    The cluster's value is always used when present.  Only when it is unset
    (local tests) a private folder is created and registered.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext handle (remote session)
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return configured
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="stocksieve-ckpt-")
    sc.setCheckpointDir(local)
    return local


def shared_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path under the shared folder for written tables (lineage cuts,
    snapshot stores built inside a query)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    pieces = ["stocksieve", *parts]
    if unique:
        pieces.append(uuid.uuid4().hex)
    return "/".join([base, *pieces])


def side_by_side(spark: SparkSession, work: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Results of jobs that need nothing of one another, submitted at once: the
    tasks of one fill the cores that the last tasks and small stages of another
    leave free.  All have ended when it returns or raises."""
    with ThreadPoolExecutor(max(len(work), 1)) as pool:
        # a copy of the caller's job properties for every thread
        jobs = {name: pool.submit(inheritable_thread_target(spark)(run)) for name, run in work.items()}
    return {name: job.result() for name, job in jobs.items()}


def bench_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
