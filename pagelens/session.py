"""Spark session defaults for the engine.

Settings that matter at scale:
* AQE on (coalesce small shuffles, split skewed join partitions).
* ``requireAllClusterKeysForCoPartition=false`` so joins on (page_id, x)
  reuse an existing page_id hash partitioning instead of re-shuffling.
* small Arrow batches: one batch of pages is parsed in one Python call, so
  a few huge pages never hold a worker's memory hostage.
* the checkpoint directory comes from the cluster (``spark.checkpoint.dir``);
  only when it is unset (local tests) a directory under /tmp is used.
"""

from __future__ import annotations

import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.session.timeZone": "UTC",
    # the plans are wide (many derived columns): constraint propagation only
    # adds optimizer time here, no pruning
    "spark.sql.constraintPropagation.enabled": "false",
    # the JVM never compiles a method of more than 8,000 bytes: a stage with a
    # larger one runs operator by operator, whose code is cut into small methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # work tables are Parquet a tenth of their rows' size: without this, sides
    # of 100 MB and more count as small and are broadcast
    "spark.sql.sources.fileCompressionFactor": "10",
    # work tables are one sorted file per bucket: windows, joins and grouped
    # arrays by page, frame and element read them in order, without a sort
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "pagelens") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
               .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Apply runtime SQL settings to an existing session (e.g. the driver's)."""
    for k, v in DEFAULT_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: keep what is there
            pass
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory named by the session.

    Only a local-mode session (tests, a laptop) without one gets a temporary
    directory; on a cluster a machine-local folder would be lost with its
    executor, so an unset ``spark.checkpoint.dir`` is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:  # set once per context: setting it again would nest a new folder below
        return current
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store) for this cluster")
        current = tempfile.mkdtemp(prefix="pagelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir()


def together(*steps) -> list:
    """Results of steps (functions without arguments) that start Spark jobs and do not need each other: their jobs share the cluster, so
    that the planning and the last tasks of one are filled with tasks of another."""
    session = SparkSession.getActiveSession()
    inherit = inheritable_thread_target(session) if session else inheritable_thread_target
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inherit(step)) for step in steps]]
