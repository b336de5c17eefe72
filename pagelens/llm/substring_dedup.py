"""Operator 9: removal of repeated word spans with suffix automata of reference shards.

A window is ``length`` consecutive words; each word covered by a window whose sequence also starts earlier (by
doc_id, then position) goes. The reference of a document is everything before it, so the whole corpus is both
reference and stream and cannot be broadcast. Reference shards are therefore cut by content:

1. each window has a fingerprint, its smallest gram hash; equal windows have equal fingerprints. Consecutive windows
   with the same fingerprint occurrence form a run, and the run's words its context;
2. runs whose fingerprint occurs once in the corpus are done;
3. the contexts of a fingerprint form a reference shard. They are streamed in reference order through the shard's
   suffix automaton; the matching statistics give the windows that exist earlier, unmatched contexts are added;
4. a fingerprint with over ``HOT_RUNS`` runs (a line that a third of all documents has) is not collected: its
   windows are counted one by one with an aggregation that combines before the shuffle, which is exact as well;
5. the removed spans are joined back to the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from . import common as C

HOT_RUNS = 1000
LAST_ID = (1 << 63) - 1
WHOLE = (1 << 31) - 1  # end of a span over all words
BROADCAST_ROWS = 1_000_000


def gram_size(length: int) -> int:
    return max(1, length * 2 // 5)


def runs(blobs, cache: C.WordHash, length: int):
    """(fingerprint, text number, first start, windows) of every run, and the word hashes with their offsets."""
    h, off = C.hash_words(blobs, cache, lower=False)
    gram = gram_size(length)
    per = length - gram + 1
    g = C.windows(h, gram)
    starts = len(h) - length + 1
    if starts <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z, h, off
    at = np.empty(starts, np.int64)
    view = sliding_window_view(g, per)
    for a in range(0, starts, 65536):  # the leftmost smallest gram
        at[a:a + 65536] = view[a:a + 65536].argmin(axis=1)
    at += np.arange(starts)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:starts]
    fits = np.arange(starts) + length <= off[doc + 1]
    first = np.ones(starts, bool)
    first[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~fits[:-1]
    first &= fits
    begin = np.flatnonzero(first)
    # a run ends where the next begins or where windows stop fitting
    fit_sum = np.concatenate([[0], np.cumsum(fits)])
    nxt = np.append(begin[1:], starts)
    count = fit_sum[nxt] - fit_sum[begin]
    return g[at[begin]], doc[begin], begin - off[doc[begin]], count, h, off


def _counts(length):
    def run(batches):
        cache = C.WordHash()
        for batch in C.slices(batches):
            f, n = np.unique(runs(batch.column("text").to_pylist(), cache, length)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(f)), pa.array(n)], ["f", "runs"])
    return run


def _runs(length):
    def run(batches):
        cache = C.WordHash()
        for batch in C.slices(batches):
            f, doc, lo, n, _, _ = runs(batch.column("text").to_pylist(), cache, length)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(C.signed(f)), batch.column("d").take(take), batch.column("th").take(take),
                 pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], ["f", "d", "th", "lo", "n"])
    return run


def stretch_hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the words start..stop for many stretches at once, from sums of h[i] * B^i and inverse powers."""
    power, inverse = (np.full(len(h) + 1, x, np.uint64) for x in (BASE, pow(BASE, -1, 2**64)))
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1])])
    return C.mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))


BASE = 0x9E3779B97F4A7C15


def _contexts(length):
    """Per shared run its words; for runs of hot fingerprints the hashes of its windows instead."""
    def run(batches):
        cache = C.WordHash()
        for batch in C.slices(batches):
            blobs = batch.column("text").to_pylist()
            h, off = C.hash_words(blobs, cache, lower=False)
            found = batch.column("found")
            rows = found.flatten()
            f, lo, n = (np.asarray(rows.field(k)) for k in (0, 1, 2))
            hot = np.asarray(rows.field(3).cast(pa.int8())).astype(bool)
            doc = np.repeat(np.arange(len(blobs)), np.diff(C.offsets_of(found)))
            start = off[doc] + lo
            stop = start + n + length - 1
            words: list[bytes] = []
            for blob in blobs:
                words += blob.split()
            context = [None if x else b" ".join(words[a:b]) for x, a, b in zip(hot.tolist(), start.tolist(), stop.tolist())]
            w = C.signed(C.windows(h, length))
            size = np.where(hot, n, 0)
            ends = np.cumsum(size)
            index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(f), pa.array(C.signed(stretch_hashes(h, start, stop))), batch.column("d").take(take), batch.column("th").take(take),
                 pa.array(lo), pa.array(n), pa.array(context, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(w[index]))],
                ["key", "rc", "d", "th", "lo", "n", "words", "windows"])
    return run


class SuffixAutomaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and size[q] == size[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({}), link.append(0), size.append(size[last] + 1)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][w]
                if size[q] == size[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            else:
                cur, p = None, last
            clone = len(nxt)
            nxt.append(dict(nxt[q])), link.append(link[q]), size.append(size[p] + 1)
            link[q] = clone
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            if cur is None:
                last = clone
            else:
                link[cur] = clone
                last = cur

    def statistics(self, words):
        """Per word the length of the longest known sequence that ends there."""
        nxt, link, size = self.next, self.link, self.size
        state = got = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                got = size[state]
            if w in nxt[state]:
                state = nxt[state][w]
                got += 1
            yield got


def _shards(length):
    """Rows sorted by (key, rc, d, lo): the spans whose windows exist earlier in the shard."""
    def spans(f, rc, d, th, lo, n, words):
        group = np.ones(len(f), bool)
        group[1:] = (f[1:] != f[:-1]) | (rc[1:] != rc[:-1])
        lead = np.flatnonzero(group)[np.cumsum(group) - 1]  # the context's first occurrence
        copy = (d != d[lead]) | (lo != lo[lead])
        rows = [(d[copy], th[copy], lo[copy], n[copy])]
        heads = np.flatnonzero(group)
        fh = f[heads]
        many = np.zeros(len(heads), bool)
        same = fh[1:] == fh[:-1]
        many[1:] |= same
        many[:-1] |= same
        heads = heads[many]
        heads = heads[np.lexsort((lo[heads], d[heads], f[heads]))]
        odd, auto, key = [], None, None
        for i in heads.tolist():
            seq = words[i].as_py().split(b" ")
            if f[i] != key:
                key, auto = f[i], SuffixAutomaton()
                auto.add(seq)
                continue
            known = [got >= length for got in auto.statistics(seq)][length - 1:]
            if not all(known):
                auto.add(seq)
            odd += [(i, s) for s, k in enumerate(known) if k]
        if odd:
            at, s = np.array(odd, np.int64).T
            # rows of a repeated document tie with the first occurrence and share its spans
            rows.append((d[at], th[at], (lo[at] + s).astype(np.int32), np.ones(len(at), np.int32)))
        d, th, lo, n = (np.concatenate(x) for x in zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(th), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], ["d", "th", "lo", "n"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            f = np.asarray(table.column("key"))
            cut = int(np.searchsorted(f, f[-1]))  # the last shard may go on in the next batch
            rest = table.slice(cut)
            if cut:
                yield one(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield one(rest)

    def one(table):
        cols = [np.asarray(table.column(c)) for c in ("key", "rc", "d", "th", "lo", "n")]
        return spans(*cols, table.column("words"))

    return run


def _apply(length, extra):
    def run(batches):
        for batch in C.slices(batches):
            totals, gone, kept = [], [], []
            for blob, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                words = (blob or b"").split()
                if found:
                    mask = np.zeros(len(words) + 1, np.int32)
                    for x in found:
                        if x["hi"] == WHOLE and len(words) < length:
                            continue
                        mask[x["lo"]] += 1
                        mask[min(x["hi"], len(words))] -= 1
                    mask = np.cumsum(mask)
                    left = [w for w, m in zip(words, mask.tolist()) if not m]
                else:
                    left = words
                totals.append(len(words)), gone.append(len(words) - len(left)), kept.append(b" ".join(left))
            cols = [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols + ([batch.column("row")] if extra else []),
                                             ["doc_id", "n_words", "n_removed", "kept"] + ["row"] * extra)
    return run


def substring_dedup(docs: DataFrame, length: int = 20, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one blank) and, with ``carry``, those columns as ``row``.

    Null, empty and short texts have no window and lose nothing. Windows are judged on the input. Ids that repeat:
    (doc_id, position) decides, so equal rows of one id keep the same words. A null doc_id comes after all others.
    One row per input row; an empty table gives no rows; columns other than ``carry`` are not looked at.
    """
    C.ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                         *([F.struct(*carry).alias("row")] if carry else []))
    source = source.withColumn("d", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("th", F.hash("text"))
    # whole copies: all but the first go at once and take no part in what follows
    ids = C.stage(source.select("d", "th", F.xxhash64("text").alias("th8")), "ids")
    first = ids.groupBy("th8", "th").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    copies = C.stage(ids.join(first, ["th8", "th"]).where("d > first").select("d", "th").distinct(), "copies")
    small = copies.count() <= BROADCAST_ROWS
    slim = source.select("d", "th", "text").where("text is not null").join(F.broadcast(copies) if small else copies, ["d", "th"], "left_anti")
    shared = slim.select("text").mapInArrow(_counts(length), "f long, runs long").groupBy("f").agg(F.sum("runs").alias("runs")).where("runs > 1")
    shared = C.stage(shared.select("f", (F.col("runs") > HOT_RUNS).alias("hot")), "shared")
    found = (slim.mapInArrow(_runs(length), "f long, d long, th int, lo int, n int").join(shared, "f")
             .groupBy("d", "th").agg(F.collect_set(F.struct("f", "lo", "n", "hot")).alias("found")))
    found = C.stage(found, "runs")
    contexts = C.stage(slim.dropDuplicates(["d", "th"]).join(found, ["d", "th"]).mapInArrow(
        _contexts(length), "key long, rc long, d long, th int, lo int, n int, words binary, windows array<long>"), "contexts")
    cold = contexts.where("words is not null").drop("windows")
    spans = cold.repartition("key").sortWithinPartitions("key", "rc", "d", "lo").mapInArrow(_shards(length), "d long, th int, lo int, n int")
    # hot fingerprints: equal contexts after the first go whole, the first ones' windows are counted
    hot = contexts.where("words is null").select("key", "rc", "d", "th", "lo", "n", "windows")
    lead = hot.groupBy("key", "rc").agg(F.min(F.struct("d", "lo")).alias("first"))
    led = C.stage(hot.join(lead, ["key", "rc"]).withColumn("copy", (F.col("d") != F.col("first.d")) | (F.col("lo") != F.col("first.lo"))), "hot")
    each = led.where("not copy").select("d", "th", "lo", F.posexplode("windows").alias("i", "w")).select("d", "th", (F.col("lo") + F.col("i")).alias("lo"), "w")
    earliest = each.groupBy("w").agg(F.min(F.struct("d", "lo")).alias("first"), F.count("*").alias("k")).where("k > 1")
    late = each.join(earliest, "w").where((F.col("d") != F.col("first.d")) | (F.col("lo") != F.col("first.lo")))
    spans = spans.union(led.where("copy").select("d", "th", "lo", "n")).union(late.select("d", "th", "lo", F.lit(1)))
    spans = spans.union(copies.select("d", "th", F.lit(0), F.lit(WHOLE - length + 1)))
    gone = C.stage(spans.groupBy("d", "th").agg(F.collect_list(F.struct("lo", (F.col("lo") + (F.col("n") + (length - 1))).alias("hi"))).alias("found")), "spans")
    out = source.join(gone, ["d", "th"], "left").select("doc_id", "text", "found", *(["row"] if carry else []))
    schema = "doc_id long, n_words long, n_removed long, kept binary"
    if carry:
        schema += f", row {source.schema['row'].dataType.simpleString()}"
    return out.mapInArrow(_apply(length, bool(carry)), schema).withColumn("kept", F.col("kept").cast("string"))
