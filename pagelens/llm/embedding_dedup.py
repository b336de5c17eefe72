"""Operator 10: near-duplicate embeddings by randomised-rotation binary codes.

Vectors are compared within a label. Signs of randomly rotated vectors give binary codes; bands of the sign bits are
the index (every row is in all bands; at a cosine of 0.98 a pair meets in one of 16 bands of 14 bits with
probability 0.9997, and nearer pairs more surely). Inside a band's bucket the first rotation's code and its stored
correction factor <code, vector> give an unbiased estimate of the inner product with a confidence bound; pairs whose
upper bound stays below the threshold are dropped, all others are computed exactly in double precision. A pair is
counted in the first band where it meets. Equal vectors form one row with a count; large buckets are dealt over
bounded pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common as C

BANDS, BAND_BITS, SEED = 16, 14, 20240229
CONFIDENCE = 6.0  # standard errors of the estimate


def rotations(dim: int) -> np.ndarray:
    """dim x (BANDS * BAND_BITS) directions, orthonormal in blocks of dim."""
    rng = np.random.default_rng([SEED, dim])
    n = -(-max(BANDS * BAND_BITS, dim) // dim)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)], axis=1)


def band_keys(unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    bits = (unit @ turn[:, :BANDS * BAND_BITS] >= 0).reshape(len(unit), BANDS, BAND_BITS)
    return bits @ (1 << np.arange(BAND_BITS))


def _facts():
    """Digest of every usable vector (finite, not zero, no nulls); None for the others."""
    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                ok = v and None not in v
                a = np.array(v, np.float64) if ok else None
                ok = ok and np.isfinite(a).all() and np.isfinite(s := a @ a) and s > 0
                out.append((xxhash.xxh3_128_digest((a + 0.0).tobytes()), a.tobytes()) if ok else (None, None))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([x for x, _ in out], pa.binary()),
                                              pa.array([x for _, x in out], pa.binary())], ["vec_id", "label", "digest", "vec"])
    return run


def unit_rows(vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([np.frombuffer(v, np.float64) for v in vectors])
    norm = np.sqrt((a * a).sum(axis=1))
    return a, norm


def _bands():
    def run(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            dims = np.array([len(v) // 8 for v in vecs])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in turns:
                    turns[dim] = rotations(dim)
                a, norm = unit_rows([vecs[i] for i in at])
                keys = band_keys(a / norm[:, None], turns[dim])
                take = pa.array(np.repeat(at, BANDS))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(take), batch.column("label").take(take), pa.array(np.full(len(at) * BANDS, dim, np.int32)),
                     pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(at))), pa.array(keys.reshape(-1).astype(np.int32))],
                    ["node", "label", "dim", "band", "key"])
    return run


def linked(a, norm, keys, turn, band, rows, cols, threshold):
    """Pairs (i, j) of ``rows`` x ``cols`` with cosine >= threshold whose first common band is ``band``."""
    dim = a.shape[1]
    unit = a / norm[:, None]
    rotated = unit @ turn[:, :dim]
    code = np.where(rotated >= 0, 1.0, -1.0)
    factor = np.abs(rotated).sum(axis=1) / np.sqrt(dim)  # <code / sqrt(dim), vector>
    slack = CONFIDENCE * np.sqrt(np.maximum(0.0, 1 - factor ** 2) / factor ** 2 / max(1, dim - 1))
    for s in range(0, len(rows), 512):
        r = rows[s:s + 512]
        estimate = (rotated[r] @ code[cols].T) / np.sqrt(dim) / factor[cols]
        i, j = np.nonzero(estimate + slack[cols] >= threshold)
        i, j = r[i], cols[j]
        for t in range(0, len(i), 200_000):
            x, y = i[t:t + 200_000], j[t:t + 200_000]
            exact = np.einsum("ij,ij->i", a[x], a[y]) / (norm[x] * norm[y])
            near = exact >= threshold
            x, y = x[near], y[near]
            first = (keys[x] == keys[y]).argmax(axis=1) == band
            yield x[first], y[first]


def _links(threshold):
    turns: dict[int, np.ndarray] = {}

    def run(table: pa.Table):
        one, two, band, dim = (table.column(c)[0].as_py() for c in ("block_a", "block_b", "band", "dim"))
        block, node, copies = (np.asarray(table.column(c)) for c in ("block", "node", "copies"))
        if one != two and block.min() == block.max() or len(node) < 2:
            return
        if dim not in turns:
            turns[dim] = rotations(dim)
        a, norm = unit_rows(table.column("vec").to_pylist())
        keys = band_keys(a / norm[:, None], turns[dim])
        rows, cols = np.flatnonzero(block == one), np.flatnonzero(block == two)
        links, root = np.zeros(len(node), np.int64), list(range(len(node)))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for x, y in linked(a, norm, keys, turns[dim], band, rows, cols, threshold):
            if one == two:
                x, y = x[x < y], y[x < y]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            for i, j in zip(x.tolist(), y.tolist()):
                i, j = top(i), top(j)
                if i != j:
                    root[max(i, j)] = min(i, j)
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[[top(i) for i in some.tolist()]]), pa.array(links[some])],
                                             ["node", "root", "links"])
    return run


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, label, embedding).

    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths; their component_id is their own vec_id. Repeated rows are rows of their own and equal
    vectors link. A null vec_id links like others but names no component. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    C.ship(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    facts = vectors.mapInArrow(_facts(), "vec_id long, label long, digest binary, vec binary")
    facts = C.stage(facts.withColumn("digest", F.when(F.col("label").isNotNull(), F.col("digest"))), "vectors")
    classes = C.stage(facts.where("digest is not null").groupBy("label", "digest").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
                      .withColumn("node", F.xxhash64("label", "digest")), "classes")
    keyed = C.stage(classes.select("node", "label", "vec").mapInArrow(_bands(), "node long, label long, dim int, band int, key int"), "bands")
    bucket = ["label", "dim", "band", "key"]
    sizes = keyed.groupBy(*bucket).agg(F.count("*").alias("members")).where("members > 1")
    dealt = C.block_pairs(keyed.join(sizes, bucket).join(classes.select("node", "copies", "vec"), "node"), "members", "node")
    dealt = dealt.select(*bucket, "block_a", "block_b", "block", "node", "copies", "vec")
    found = C.stage(C.map_groups(dealt, [*bucket, "block_a", "block_b"], _links(threshold), "node long, root long, links long"), "links")
    label = C.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = classes.join(links, "node", "left").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(least, "component").select("label", "digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = facts.select("vec_id", "label", "digest").join(classes, ["label", "digest"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
