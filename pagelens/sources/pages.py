"""S1 page source, S3 structural parse and S5 parse-error rows."""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.schema import PARSED_SCHEMA
from pagelens.sources.htmltree import parse_page


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages (page_id, url, html)."""
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


_ARROW_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("frame_id", pa.int32()), ("eid", pa.int32()), ("last_eid", pa.int32()),
    ("parent_eid", pa.int32()), ("depth", pa.int32()),
    ("sib_index", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("t_start", pa.int32()), ("t_end", pa.int32()), ("m_start", pa.int32()), ("m_end", pa.int32()),
    ("in_shadow", pa.bool_()), ("root_id", pa.int32()), ("shadow_mode", pa.string()),
    ("parent_frame_id", pa.int32()), ("host_eid", pa.int32()), ("frame_key", pa.list_(pa.int32())),
    ("frame_url", pa.string()), ("text", pa.string()), ("mtext", pa.string()),
    ("error_code", pa.string()), ("error_message", pa.string()),
])
_ROWS_PER_OUTPUT_BATCH = 20000


_ATTRS = _ARROW_SCHEMA.get_field_index("attrs")


class _Rows:
    """Rows of one output batch, column by column; attributes flat, as a map column holds them."""

    def __init__(self):
        self.cols = [[] for _ in _ARROW_SCHEMA]
        self.keys, self.values, self.offsets = [], [], []

    def __len__(self):
        return len(self.offsets)

    def frame(self, page_id, frame_id, parent_fid, host_eid, key, furl, text, mtext, rows):
        n = len(rows)
        for d in (part := list(zip(*rows)))[6]:
            self.offsets.append(len(self.keys))
            self.keys += d
            self.values += d.values()
        part[2] = [None if p < 0 else p for p in part[2]]
        rest = [None] * (n - 1)  # the root, which stands first, carries what belongs to the frame
        of_frame = [[x, *rest] for x in (parent_fid, host_eid, key, furl, text, mtext)]
        for i, values in enumerate([[page_id] * n, [frame_id] * n, *part, *of_frame, [None] * n, [None] * n]):
            if i != _ATTRS:
                self.cols[i] += values

    def error(self, page_id, url, message):
        row = [page_id, 0, -1, -1, None, None, None, None, None, None, None, None, None,
               None, None, None, None, None, None, url, None, None, "internal_error", message]
        self.offsets.append(None)
        for i, value in enumerate(row):
            if i != _ATTRS:
                self.cols[i].append(value)

    def batch(self):
        arrays = [None if i == _ATTRS else pa.array(c, type=_ARROW_SCHEMA.field(i).type) for i, c in enumerate(self.cols)]
        arrays[_ATTRS] = pa.MapArray.from_arrays(pa.array([*self.offsets, len(self.keys)], pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW_SCHEMA)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Rows()
    for batch in batches:
        ids = batch.column("page_id").to_pylist()
        urls = batch.column("url").to_pylist()
        docs = batch.column("html").to_pylist()
        for page_id, url, doc in zip(ids, urls, docs):
            try:
                frames = parse_page(doc or "", url or "")
            except Exception as exc:  # S5: a page that cannot be parsed becomes an error row
                out.error(page_id, url, (str(exc) or type(exc).__name__).split("\n")[0])
                continue
            for frame in frames:
                out.frame(page_id, *frame)
            if len(out) >= _ROWS_PER_OUTPUT_BATCH:
                yield out.batch()
                out = _Rows()
    if len(out):
        yield out.batch()


def _ship_kernel_by_value() -> None:
    """Send the parse kernel with the task itself, so Python workers need no
    installed copy of this package (cluster nodes only need pyspark + pyarrow)."""
    from pyspark import cloudpickle

    import pagelens.sources.htmltree as kernel
    import pagelens.sources.pages as me
    for mod in (kernel, me):
        try:
            cloudpickle.register_pickle_by_value(mod)
        except (ValueError, AttributeError):
            pass


def parse_pages(pages: DataFrame) -> DataFrame:
    """S3: one narrow Arrow-batched Python stage, no shuffle.

    The html column is consumed here and never travels further.
    """
    _ship_kernel_by_value()
    src = pages.select("page_id", "url", "html")
    # The parse is the CPU-heavy stage: when the input has few splits for the
    # cluster's cores (a few large files), spread the pages round-robin
    # first. Large inputs already have many more splits than cores and are
    # parsed where they are read, without a shuffle of the html.
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if src.rdd.getNumPartitions() < cores * 4:
        src = src.repartition(cores * 4)
    return src.mapInArrow(_parse_batches, PARSED_SCHEMA)


def split_parsed(parsed: DataFrame):
    """Split the parse output into (elements, frames, parse_errors)."""
    ok = parsed.filter(F.col("error_code").isNull())
    elements = ok.drop("parent_frame_id", "host_eid", "frame_key", "frame_url", "text", "mtext",
                       "error_code", "error_message")
    frames = ok.filter(F.col("eid") == 0).select(
        "page_id", "frame_id", "parent_frame_id", "host_eid", "frame_key", "frame_url", "text", "mtext")
    errors = parsed.filter(F.col("error_code").isNotNull()).select(
        "page_id", F.col("frame_url").alias("url"),
        F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message"),
                 F.lit(None).cast("string").alias("hint")).alias("error"))
    return elements, frames, errors
