"""The nodes table. One row per kept node with its provenance, bucketed and sorted by page, a partition per run.

A run (one batch extraction, one micro-batch of a stream) owns the partition ``run_id``: writing it again replaces it, so
a repeated run leaves no second copy. Buckets are by ``page_id``: aggregates, windows and joins by page read the table
without an exchange, over any number of runs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.operators.assemble import NODE_FIELDS
from pagelens.schema import SCHEMA_VERSION

KEY = ["page_id", "frame_key", "doc_order"]


def node_rows(ex) -> DataFrame:
    """Kept nodes of an extraction with url, time of capture and schema version; ``node_no`` counts a page's nodes."""
    w = Window.partitionBy("page_id").orderBy("frame_key", "doc_order", "eid")
    nodes = ex.kept_nodes.withColumn("node_no", F.row_number().over(w).cast("long"))
    meta = ex.page_meta.select("page_id", "url", "captured_at")
    return nodes.join(meta, "page_id").select(*KEY, "node_no", "frame_id", "url", "captured_at", F.lit(SCHEMA_VERSION).alias("schema_version"), *NODE_FIELDS)


def write_nodes(ex, table: str, run_id: str, buckets: int = 64, path: str | None = None) -> None:
    """Write an extraction's nodes as run ``run_id`` of ``table``; see ``write_rows``."""
    write_rows(node_rows(ex), table, run_id, buckets, path)


def write_rows(rows: DataFrame, table: str, run_id: str, buckets: int = 64, path: str | None = None) -> None:
    """Write ``rows`` as run ``run_id`` of ``table``, which is made on first use (at ``path``, if given).

    ``buckets`` is set when the table is made: about the table's size over 256 MB. A run without nodes leaves an empty run.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"run id {run_id!r}: letters, digits, '_', '.' and '-' only")
    spark = rows.sparkSession
    if not spark.catalog.tableExists(table):
        made = rows.limit(0).withColumn("run_id", F.lit("")).write.partitionBy("run_id").bucketBy(buckets, "page_id").sortBy(*KEY).format("parquet")
        (made.option("path", path) if path else made).saveAsTable(table)
    else:  # the table's own number of buckets counts
        described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
        buckets = int(described["Num Buckets"])
    # one file per bucket and run: rows are dealt to tasks as the buckets are
    rows = rows.repartition(buckets, "page_id")
    names = ", ".join(c for c in spark.table(table).columns if c != "run_id")
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (run_id = '{run_id}') SELECT {names} FROM {{rows}}", rows=rows)
    # a table at a path of its own learns of the run's folder here; one in the warehouse has it already
    spark.catalog.refreshTable(table)


def read_nodes(spark: SparkSession, table: str, runs: list[str] | None = None, latest: bool = False) -> DataFrame:
    """Rows of the nodes table, of ``runs`` only (partitions pruned) or of all.

    ``latest``: of several captures of a page only the newest (then the run id that sorts last). No exchange is added.
    """
    rows = spark.table(table)
    if runs is not None:
        rows = rows.where(F.col("run_id").isin(runs))
    if latest:
        w = Window.partitionBy("page_id")
        newest = F.max(F.struct("captured_at", "run_id")).over(w)
        rows = rows.withColumn("_newest", newest).where(F.struct("captured_at", "run_id") == F.col("_newest")).drop("_newest")
    return rows
