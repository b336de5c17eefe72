"""Structured Streaming: captured pages arriving as files -> extracts.

The extraction of one page is stateless, so each micro-batch runs the batch
plan through ``foreachBatch``. Output is written per batch id with overwrite
semantics (``.../batch_id=N``), so a batch replayed after a failure replaces
its own output instead of duplicating it. Re-delivered captures of the same
(url, captured_at) are dropped with a watermark when the source carries
``captured_at``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from pagelens.operators.nodes_table import write_nodes
from pagelens.operators.report import fingerprint
from pagelens.plans.extract import ExtractOptions, Extraction
from pagelens.schema import PAGES_SCHEMA
from pagelens.session import ensure_checkpoint_dir


def read_page_stream(spark: SparkSession, source_dir: str, schema=PAGES_SCHEMA, max_files: int = 64) -> DataFrame:
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    if "captured_at" in schema.fieldNames():
        s = s.withWatermark("captured_at", "1 hour").dropDuplicatesWithinWatermark(["url", "captured_at"])
    return s


def extract_batch(batch: DataFrame, batch_id: int, sink_dir: str, opts: ExtractOptions, nodes_table: str | None = None, nodes_path: str | None = None) -> None:
    """Write one micro-batch's extracts, fingerprints and nodes; nodes go to the bucketed ``nodes_table`` if one is named."""
    ex = Extraction(batch, opts)
    out = f"{sink_dir.rstrip('/')}/batch_id={batch_id}"
    ex.extracts.write.mode("overwrite").parquet(f"{out}/extracts")
    # A6 input for the drift stream: one fingerprint per capture (captured_at excluded)
    (ex.extracts.select(F.col("page_metadata.url").alias("url"),
                        F.to_timestamp(F.col("page_metadata.captured_at")).alias("captured_at"),
                        fingerprint(ex.extracts).alias("fp"))
     .write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/fingerprints/batch_id={batch_id}"))
    if nodes_table is not None:
        write_nodes(ex, nodes_table, f"batch-{batch_id}", path=nodes_path)
        return
    (ex.kept_nodes.select("page_id", "frame_id", "doc_order", "kind", "tag", "role", "accessible_name",
                          "primary_locator", "fallback_locators", "properties", "context_note")
     .write.mode("overwrite").parquet(f"{out}/nodes"))


def start(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_location: str | None = None,
          available_now: bool = False, nodes_table: str | None = None, nodes_path: str | None = None, **opts):
    """Start the streaming extraction; returns the StreamingQuery."""
    options = ExtractOptions(**opts)
    ckpt = checkpoint_location or os.path.join(ensure_checkpoint_dir(spark), "pagelens-stream")
    w = (read_page_stream(spark, source_dir).writeStream
         .foreachBatch(lambda df, bid: extract_batch(df, bid, sink_dir, options, nodes_table, nodes_path))
         .option("checkpointLocation", ckpt))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


FP_SCHEMA = "url string, captured_at timestamp, fp string, batch_id long"
DRIFT_SCHEMA = "url string, captured_at timestamp, fp string, status string, revision int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _drift_processor(horizon_us: int):
    """State per url: its captures of the last ``horizon_us`` with their status, and the newest capture before those.

    The class stands in here so that it travels to the workers by value.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Drift(StatefulProcessor):
        def init(self, handle):
            self.recent = handle.getMapState("recent", "at long, batch long, fp string", "status string, revision int")
            self.before = handle.getValueState("before", "at long, batch long, fp string")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            recent = {tuple(k): tuple(v) for k, v in self.recent.iterator()}
            before = tuple(self.before.get()) if self.before.exists() else None
            out, new = [], set()
            for pdf in rows:  # a url's rows of one trigger may come in several pieces
                for at, batch, fp in zip(pdf["at"].tolist(), pdf["batch_id"].tolist(), pdf["fp"].tolist()):
                    new.add((int(at), int(batch), fp))
            for p in sorted(p for p in new if before is not None and p <= before):
                out.append((*p, "late", 1))
            new = sorted(p for p in new if p not in recent and (before is None or p > before))

            last = before[2] if before else None
            for p in sorted([*recent, *new]):
                status = "first" if last is None else "same" if p[2] == last else "changed"
                old, revision = recent.get(p, (None, 0))
                if status != old:  # new, or a capture has come in between
                    recent[p] = (status, revision + 1)
                    self.recent.updateValue(p, recent[p])
                    out.append((*p, status, revision + 1))
                last = p[2]

            order = sorted(recent)
            past = [p for p in order if p[0] < order[-1][0] - horizon_us] if order else []
            for p in past:
                self.recent.removeKey(p)
            if past:
                self.before.update(past[-1])
            yield pd.DataFrame({"url": [key[0]] * len(out), "captured_at": pd.to_datetime([o[0] if o[0] >= 0 else None for o in out], unit="us"),
                                "fp": [o[2] for o in out], "status": [o[3] for o in out], "revision": pd.Series([o[4] for o in out], dtype="int32")})

        def close(self):
            pass

    return Drift()


def drift_stream(spark: SparkSession, sink_dir: str, horizon: str = "7 days", max_files: int | None = None) -> DataFrame:
    """A6 over a stream: is a capture's extract (captured_at removed) the same as that of the capture before it?

    Rows: url, captured_at, fp, status (first, same, changed, late), revision. Captures are ordered by captured_at, then
    by batch and fingerprint; null captured_at comes first. A capture that arrives between two known ones gives its own
    row and, where the later one's status turns, that row again with the next ``revision``: the highest revision per
    capture does not depend on the order of arrival. State per url is bounded by its captures within ``horizon`` of the
    newest one and one capture before; what arrives older than that capture is reported as ``late`` and compared with nothing.
    A capture delivered again within the horizon gives no row. Rows without url count as captures of one null url.

    Needs the RocksDB state store, which is set for the session.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # the interval's length by Spark's own interval parser
    micros = spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {horizon}")).alias("us")).first().us
    reader = spark.readStream.schema(FP_SCHEMA).option("basePath", f"{sink_dir.rstrip('/')}/fingerprints")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    fps = reader.parquet(f"{sink_dir.rstrip('/')}/fingerprints").select(
        "url", F.coalesce(F.unix_micros("captured_at"), F.lit(-1).cast("long")).alias("at"),
        F.coalesce("batch_id", F.lit(-1).cast("long")).alias("batch_id"), F.coalesce("fp", F.lit("")).alias("fp"))
    return fps.groupBy("url").transformWithStateInPandas(
        _drift_processor(micros), outputStructType=DRIFT_SCHEMA, outputMode="Append", timeMode="None")
