"""Operator 1: n-gram Jaccard self-join with prefix trees.

Sets of distinct word n-grams that agree for ``percent`` of their union are linked. Steps:

1. every text -> distinct 64-bit n-gram hashes; identical sets form one class;
2. heads: the 2e + 1 smallest hashes of a set, e = the n-grams that a linked partner may lack. Partners share at
   least min(e) + 1 head hashes, so a set with fewer head hashes known from other sets has no partner;
3. of the head, the rarest hashes in one global order (frequency, hash) form the signature; linked sets share at
   least one signature hash. Sets joined by signatures form candidate clusters;
4. each cluster's sets are sent to one task (large clusters: to bounded pairs of blocks), put into a trie in one
   order and probed by each set; subtrees fall when the remaining lengths cannot reach the overlap asked for;
5. links give components and link counts per class; copies take their class's values.

The bounds are exact: no link is lost and nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C

HOT_IN_TASK = 8
HOT_ROWS = 1000
BROADCAST_ROWS = 1_000_000
LISTED_ROWS = 500_000
FACTS = ["doc_id", "n", "digest", "class", "h", "rows"]


def needed(n, percent):
    """Elements that a linked partner shares at least: ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def shingle_sets(batch: pa.RecordBatch, cache: C.WordHash, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes per row; fewer words: the whole sequence as one; none: empty."""
    blobs = batch.column("text").to_pylist()
    h, off = C.hash_words(blobs, cache, lower=True)
    grams = C.windows(h, size)
    out = []
    for a, b in zip(off[:-1], off[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        elif b > a:
            out.append(C.windows(h[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _facts(size, percent):
    """One reading of the texts gives two kinds of rows: per document its id, set size, digest and class; and (h, rows) of the
    head hashes that the task meets often (n is null). A hash missing there is met less often in every task."""
    def run(batches):
        cache, seen, parts = C.WordHash(), set(), []
        for batch in C.slices(batches):
            sets = shingle_sets(batch, cache, size)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            classes = [_class_of(d) for d in digests]
            for s, k in zip(sets, classes):
                if k is not None and k not in seen:
                    if len(seen) < C.CACHE_WORDS:
                        seen.add(k)
                    parts += _head_rows([s], percent)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(classes, pa.int64()), none, none], FACTS)
        h, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keep = n >= HOT_IN_TASK
        none = pa.nulls(int(keep.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(none), pa.binary()), none, pa.array(C.signed(h[keep])), pa.array(n[keep])], FACTS)
    return run


def _class_of(digest: bytes | None) -> int | None:
    return int.from_bytes(digest[:8], "little", signed=True) if digest else None


def _head_rows(sets, percent):
    heads = [s[:2 * (len(s) - needed(len(s), percent)) + 1] for s in sets]
    return heads


def _heads(size, percent, listed=None):
    """(class, n, h, df) for every head hash; a task gives each set once while its memory of sets lasts. ``listed`` is a broadcast pair of sorted
    hot hashes and their frequencies; df is null for all others."""
    def run(batches):
        cache, seen = C.WordHash(), set()
        hot, freq = listed.value if listed is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in C.slices(batches):
            keys, lens, heads = [], [], []
            for s in shingle_sets(batch, cache, size):
                if not len(s):
                    continue
                k = _class_of(xxhash.xxh3_128_digest(s.tobytes()))
                if k in seen:
                    continue
                if len(seen) < C.CACHE_WORDS:
                    seen.add(k)
                keys.append(k), lens.append(len(s))
                heads += _head_rows([s], percent)
            if keys:
                reps = [len(x) for x in heads]
                h = C.signed(np.concatenate(heads))
                at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
                known = hot[at] == h if len(hot) else np.zeros(len(h), bool)
                df = freq[at] if len(hot) else np.zeros(len(h), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(keys, np.int64), reps)), pa.array(np.repeat(np.array(lens, np.int32), reps)),
                     pa.array(h), pa.array(df, mask=~known)], ["class", "n", "h", "df"])
    return run


def _members(size):
    """Sets of the documents that stand for their classes."""
    def run(batches):
        cache = C.WordHash()
        for batch in C.slices(batches):
            rows = list(zip(shingle_sets(batch, cache, size), batch.column("digest").to_pylist()))
            keep = [i for i, (s, d) in enumerate(rows) if xxhash.xxh3_128_digest(s.tobytes()) == d]
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("class"), part.column("copies"), part.column("cluster"), part.column("members"),
                 pa.array([rows[i][0].tobytes() for i in keep], pa.binary())],
                ["class", "copies", "cluster", "members", "set"])
    return run


class Trie:
    """Radix trie over sets given as increasing id arrays, laid out level by level."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.levels: list[dict] = []
        # one range of sorted sets that agree on `depth` elements -> a node per next distinct element
        todo = [(0, len(order), 0, -1)]
        arrays = [sets[i] for i in order]
        while todo:
            nodes, segs, ends, below = [], [], [], []
            for lo, hi, depth, parent in todo:
                i = lo
                while i < hi:
                    first = arrays[i]
                    if len(first) == depth:  # ends at the parent
                        i += 1
                        continue
                    j, head = i + 1, first[depth]
                    while j < hi and len(arrays[j]) > depth and arrays[j][depth] == head:
                        j += 1
                    last = arrays[j - 1]
                    m = min(len(first), len(last))
                    diff = np.flatnonzero(first[depth:m] != last[depth:m])
                    stop = depth + int(diff[0]) if len(diff) else m
                    me = len(nodes)
                    sizes = [len(arrays[x]) for x in range(i, j)]
                    nodes.append((parent, stop, min(sizes), max(sizes), int(first[stop - 1])))
                    segs.append(first[depth:stop])
                    ends += [(me, order[x]) for x in range(i, j) if len(arrays[x]) == stop]
                    if any(s > stop for s in sizes):
                        below.append((i, j, stop, me))
                    i = j
            if nodes:
                cols = np.array(nodes, np.int64).T
                self.levels.append({
                    "parent": cols[0], "depth": cols[1], "least": cols[2], "most": cols[3], "last": cols[4],
                    "elem": np.concatenate(segs), "start": np.concatenate([[0], np.cumsum([len(s) for s in segs])]),
                    "end_node": np.array([e[0] for e in ends], np.int64), "end_set": np.array([e[1] for e in ends], np.int64)})
            todo = below

    def probe(self, ids: np.ndarray, mask: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the stored sets that the probe links with. ``mask`` marks the probe's ids."""
        n = len(ids)
        found, alive, over = [], None, None
        for lv in self.levels:
            if alive is None:
                at = np.arange(len(lv["parent"]))
                got = np.zeros(len(at), np.int64)
            else:
                ok = alive[lv["parent"]]
                at = np.flatnonzero(ok)
                got = over[lv["parent"][at]]
            if not len(at):
                break
            start, size = lv["start"][at], lv["start"][at + 1] - lv["start"][at]
            ends = np.cumsum(size)
            index = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
            hits = np.concatenate([[0], np.cumsum(mask[lv["elem"][index]])])
            got = got + hits[ends] - hits[ends - size]
            left = n - np.searchsorted(ids, lv["last"][at], side="right")
            best = got + np.minimum(lv["most"][at] - lv["depth"][at], left)
            # overlap o suffices when 100 o >= percent (n + m - o), m at least the shortest set below
            good = (100 + percent) * best >= percent * (n + lv["least"][at])
            alive = np.zeros(len(lv["parent"]), bool)
            over = np.zeros(len(lv["parent"]), np.int64)
            alive[at[good]] = True
            over[at] = got
            if len(lv["end_node"]):
                e = alive[lv["end_node"]]
                node, sets = lv["end_node"][e], lv["end_set"][e]
                link = (100 + percent) * over[node] >= percent * (n + lv["depth"][node])
                found.append(sets[link])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def trie_links(sets: list[np.ndarray], side: np.ndarray, percent: int):
    """Pairs (i, numbers j) that link, each unordered pair once; with two sides only pairs across them."""
    flat = np.concatenate(sets)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))  # common elements first: long shared paths
    ids, at = [], 0
    for s in sets:
        ids.append(np.sort(rank[inverse[at:at + len(s)]]))
        at += len(s)
    two = side.min() != side.max()
    store = np.flatnonzero(side == side.max()) if two else np.arange(len(sets))
    trie = Trie([ids[i] for i in store])
    mask = np.zeros(len(values), bool)
    for i in (np.flatnonzero(side == side.min()) if two else range(len(sets))):
        mask[ids[i]] = True
        hits = store[trie.probe(ids[i], mask, percent)]
        mask[ids[i]] = False
        yield i, hits if two else hits[hits > i]


def _join(percent):
    def run(table: pa.Table):
        a, b = table.column("block_a")[0].as_py(), table.column("block_b")[0].as_py()
        # equal rows of one id both stand for their class: one is enough
        table = table.take(np.unique(np.asarray(table.column("class")), return_index=True)[1])
        block, node, copies = (np.asarray(table.column(c)) for c in ("block", "class", "copies"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        if a != b and block.min() == block.max():
            return
        root, links = list(range(len(sets))), np.zeros(len(sets), np.int64)

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, hits in trie_links(sets, block, percent):
            if len(hits):
                links[i] += copies[hits].sum()
                links[hits] += copies[i]
                for j in hits.tolist():
                    x, y = top(i), top(j)
                    root[max(x, y)] = min(x, y)
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[[top(i) for i in some.tolist()]]), pa.array(links[some])],
                                             ["class", "root", "links"])
    return run


def ngram_jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, kept (doc_id is its component's smallest).

    Null, empty and blank texts have no n-grams and link with nothing: component_id is their own id. Repeated rows
    are documents of their own (equal sets link). A null doc_id takes part, but only by its equal copies; the
    smallest non-null id names a component. An empty table gives no rows. Other columns are not looked at.
    """
    docs = C.texts(docs)
    read = C.stage(docs.mapInArrow(_facts(size, percent), "doc_id long, n long, digest binary, class long, h long, rows long"), "facts")
    facts = read.where("n is not null").drop("h", "rows")
    hot = C.stage(read.where("n is null").groupBy("h").agg(F.sum("rows").alias("df")).where(F.col("df") >= HOT_ROWS), "hot")
    # the often met hashes are known to be shared; the rest is counted by hash, in groups bounded by the hot rule
    row = "class long, n int, h long, df long"
    if hot.count() <= BROADCAST_ROWS:  # looked up where the heads are made: no row for it passes a join
        found = hot.orderBy("h").toArrow()
        listed = docs.sparkSession.sparkContext.broadcast((np.asarray(found.column("h")), np.asarray(found.column("df"))))
        heads = docs.select("text").mapInArrow(_heads(size, percent, listed), row)
    else:
        heads = docs.select("text").mapInArrow(_heads(size, percent), row).drop("df").join(hot, "h", "left")
    by_h = Window.partitionBy("h")
    cold = (heads.where("df is null").select("class", "n", "h", F.count("*").over(by_h).alias("df"),
                                             F.min("class").over(by_h).alias("lo"), F.max("class").over(by_h).alias("hi"))
            .where("lo <> hi").select("class", "n", "h", "df"))
    known = cold.union(heads.where("df is not null").select("class", "n", "h", "df").distinct())
    miss = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100))  # e
    least = F.ceil(F.col("n") * percent / F.lit(100))  # the shortest partner
    miss_least = least - F.ceil(least * percent / F.lit(100))
    head = 2 * miss + 1
    known = (known.groupBy("class", "n").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("known"))
             .where(F.size("known") >= miss_least + 1)
             # hashes of this set alone come first in the global order, then the shared ones by (df, h)
             .select("class", F.slice("known", F.lit(1), F.greatest(F.lit(0), 2 * miss - miss_least + 1 - (head - F.size("known"))).cast("int")).alias("known"))
             .select("class", F.col("known.h").alias("known")).where(F.size("known") > 0))
    sets = C.stage(known, "signature")
    # sets with the same smallest signature hash get one label; what follows has a row per (label, hash), so many
    # copies of one text cost a join row each, not one per hash
    first = sets.select("class", F.array_min("known").alias("pivot"))
    labels = C.stage(first.join(first.groupBy("pivot").agg(F.min("class").alias("label")), "pivot").select("class", "label"), "labels")
    shared = C.stage(sets.join(labels, "class").select("label", F.explode("known").alias("h")).distinct(), "shared")
    centre = shared.groupBy("h").agg(F.min("label").alias("centre"), F.count("*").alias("k")).where("k > 1")
    near = C.components(shared.join(centre, "h").select(F.col("label").alias("a"), F.col("centre").alias("b")))
    clusters = labels.join(near.withColumnRenamed("node", "label"), "label", "left").select("class", F.coalesce("component", "label").alias("cluster"))

    classes = C.stage(facts.where("digest is not null").groupBy("digest")
                      .agg(F.min("class").alias("class"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    grouped = classes.where("rep is not null").join(clusters, "class").select("digest", "class", "rep", "copies", "cluster")
    grouped = C.stage(grouped.join(grouped.groupBy("cluster").agg(F.count("*").alias("members")), "cluster").where("members > 1"), "grouped")
    listed = F.broadcast(grouped) if grouped.count() <= LISTED_ROWS else grouped  # else the texts are shuffled
    sets = (docs.join(listed, docs["doc_id"] == listed["rep"]).select("text", "digest", "class", "copies", "cluster", "members")
            .mapInArrow(_members(size), "class long, copies long, cluster long, members long, set binary"))
    dealt = C.block_pairs(sets, "members", "class").select("cluster", "block_a", "block_b", "block", "class", "copies", "set")
    found = C.stage(C.map_groups(dealt, ["cluster", "block_a", "block_b"], _join(percent), "class long, root long, links long"), "found")
    label = C.components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    classes = classes.join(links, "class", "left").join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(least, "component").select("digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = facts.join(classes, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
