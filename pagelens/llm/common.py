"""Helpers shared by the operators of this package.

* word hashing: texts cross to Python as binary Arrow columns; words become
  64-bit hashes once per distinct word, everything behind that is numpy over a
  whole Arrow batch.
* work tables: intermediate results go to Parquet under the shared folder that
  the cluster names in ``spark.checkpoint.dir``, so a lost executor costs a
  re-read and not a re-run. ``release`` deletes them.
* connected components and block splitting for hot groups.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CACHE_WORDS = 500_000
BATCH_CHARS = 4_000_000


# --- work tables -----------------------------------------------------------

_TABLES: list[tuple[SparkSession, str]] = []
_SHIPPED: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pagelens-llm-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    _TABLES.append((spark, path))
    return path


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a work table and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    # finished steps leave shuffle files until the JVM collects its references to them
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession | None = None) -> None:
    """Delete the work tables of finished operator calls. Results still to be computed need theirs."""
    for item in list(_TABLES):
        if spark is None or item[0] is spark:
            _TABLES.remove(item)
            try:
                delete(*item)
            except Exception:  # the session has ended: the cluster's folder is cleaned by its owner
                pass


atexit.register(release)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark context."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="pagelens-py-"), "pagelens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED["app"] = sc.applicationId


# --- Arrow plumbing --------------------------------------------------------

def texts(docs: DataFrame, key: str = "doc_id", *more: str) -> DataFrame:
    """(key, text as binary, more...): only what an operator needs, whatever else the table holds."""
    ship(docs.sparkSession)
    return docs.select(F.col(key), F.col("text").cast("binary").alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Split batches so that one slice holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = np.diff(np.asarray(offsets_of(batch.column(column))))
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def offsets_of(col: pa.Array) -> np.ndarray:
    """Offsets of a binary or list column, also when it is a slice."""
    kind = np.int64 if pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, kind)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch] | None],
               schema: str, order: list[str] | None = None) -> DataFrame:
    """Shuffle by ``keys`` and call ``fn`` once per group; groups must be bounded by the caller."""
    spark_df = df.repartition(*keys).sortWithinPartitions(*keys, *(order or []))

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(k)) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(c[a] for c in cols)
                if held and key != last:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from fn(pa.Table.from_batches(held))

    return spark_df.mapInArrow(run, schema)


# --- words -----------------------------------------------------------------

class WordHash(dict):
    """Word -> 64-bit hash, each distinct word hashed once; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hash_words(blobs: list[bytes | None], cache: WordHash, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets per text); words are runs without blank or tab..CR."""
    look = cache.__getitem__
    parts, counts = [], np.zeros(len(blobs) + 1, np.int64)
    for i, blob in enumerate(blobs):
        words = (blob.translate(LOWER) if lower else blob).split() if blob else ()
        counts[i + 1] = len(words)
        if words:
            parts.append(np.fromiter(map(look, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(counts)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes over the flat array (runs over text borders included)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, out, done, power, block = 0x9E3779B97F4A7C15, None, 0, 1, h
    bits = size
    while bits:  # runs by doubling: each step joins two halves
        if bits & 1:
            piece = block[done:done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(base, power, 2**64)) + piece
            done += power
        if bits > 1:
            block = block[:len(block) - power] * np.uint64(pow(base, power, 2**64)) + block[power:]
        power, bits = power * 2, bits >> 1
    return mix(out + np.uint64(size))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# --- hot groups and components ---------------------------------------------

def block_pairs(df: DataFrame, size: str, member: str, least: int = 128, most: int = 4096, parts: int = 20) -> DataFrame:
    """Deal the members of each group over blocks so that every pair meets in exactly one (block_a, block_b).

    ``size`` names the column with the group's size. Adds block_a <= block_b and ``block`` (the member's own);
    a group of up to ``least`` members is one block. No member is dropped; a task never holds over two blocks.
    """
    per = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col(size) / parts)))
    blocks = F.ceil(F.col(size) / per).cast("int")
    own = F.when(F.col(size) <= least, F.lit(0)).otherwise(F.pmod(F.xxhash64(member), blocks)).cast("int")
    df = df.withColumn("block", own).withColumn("_other", F.explode(F.when(F.col(size) <= least, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))))
    return (df.withColumn("block_a", F.least("block", "_other")).withColumn("block_b", F.greatest("block", "_other"))
            .drop("_other"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component = smallest node reachable) for every node of ``edges``.

    Contraction: in each round every node moves to the neighbour (or itself) with the smallest random
    priority, edges between the new labels go on. Priorities are drawn anew per round, so chains shrink by a
    constant factor whatever their ids. Only minima are aggregated, never neighbour lists.
    """
    live = stage(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
                 .where("a is not null and b is not null and a <> b").distinct(), "edges")
    labels = None
    for turn in range(64):
        if live.isEmpty():
            break
        both = live.union(live.select("b", "a"))
        near = both.groupBy(F.col("a").alias("u")).agg(F.min(F.struct(F.xxhash64(F.col("b"), F.lit(turn)).alias("p"), F.col("b").alias("v"))).alias("m"))
        moves = stage(near.select("u", F.when(F.xxhash64(F.col("u"), F.lit(turn)) < F.col("m.p"), F.col("u")).otherwise(F.col("m.v")).alias("to")), "moves")
        if labels is None:
            labels = moves.select(F.col("u").alias("node"), F.col("to").alias("label"))
        else:
            labels = stage(labels.join(moves, labels["label"] == moves["u"], "left")
                           .select("node", F.coalesce("to", "label").alias("label")), "labels")
        ma, mb = moves.select(F.col("u").alias("a"), F.col("to").alias("x")), moves.select(F.col("u").alias("b"), F.col("to").alias("y"))
        live = stage(live.join(ma, "a").join(mb, "b").where("x <> y")
                     .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
