"""Operator 6: hierarchical Pitman-Yor language model over words.

Restaurants: one per preceding training word and one for the start of a text, all sharing the unigram restaurant as
parent, whose base is uniform over the V training words and one unknown word.

1. texts are cut into words in blocks; per block the distinct (word, context) pairs with their training counts are dealt
   by word, so a word's customers in all restaurants meet in one task;
2. Gibbs sweeps over that table: each sweep seats the customers of every dish anew, one after the other, given the
   parent's predictive probability and the other dishes' tables of the last sweep. Draws are hashes of word, context and
   sweep, so scores don't depend on how the rows are partitioned. Every task sends the customers and tables of its contexts to tasks dealt
   by context, which add them up and send the totals back; only 8 numbers of the shared restaurant come to the driver;
3. after burn-in the predictive probabilities of the sweeps are averaged; blocks get them per distinct pair and add
   up their documents' logarithms.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C, units as U

BURN_IN, SAMPLES, SEED = 2, 3, 7
BLOCK_WORDS = 4_000_000
STRENGTH = 1.0
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text, as a context for the start of one


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _tokens(batch, cache):
    """Flat word hashes with an END after every text, and offsets."""
    h, off = C.hash_words(batch.column("text").to_pylist(), cache, lower=True)
    n = len(off) - 1
    out = np.empty(len(h) + n, np.uint64)
    ends = off[1:] + np.arange(n)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = h
    out[ends] = END
    return out, np.concatenate([[0], ends + 1]).astype(np.int64)


FIELDS = ["block", "part", "words", "word_at", "ctxs", "ctx_at", "n", "ids", "lens", "seq", "pair_parts"]
SCHEMA = ("block long, part int, words binary, word_at binary, ctxs binary, ctx_at binary, n binary, "
          "ids array<long>, lens array<int>, seq binary, pair_parts binary")
KINDS = [pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]


def _blocks(parts: int):
    """Per block and part: distinct words and contexts, and the pairs of places in them. The context is the word before."""
    def run(batches):
        cache, toks, ids, lens, train = C.WordHash(), [], [], [], []

        def close():
            t = np.concatenate(toks)
            w, wi = np.unique(t, return_inverse=True)
            ci = np.empty_like(wi)
            ci[1:] = wi[:-1]  # every text ends with END, so the next one starts after it
            ci[:1] = np.searchsorted(w, END)
            pair, seq, count = np.unique(wi.astype(np.int64) * len(w) + ci, return_inverse=True, return_counts=True)
            seen = np.bincount(seq, np.repeat(train, lens), len(pair)).astype(np.int64)
            rank = np.empty(len(pair), np.uint32)
            order = np.argsort(-count, kind="stable")
            rank[order] = np.arange(len(pair), dtype=np.uint32)
            words, contexts, seen = pair[order] // len(w), pair[order] % len(w), seen[order]
            part = (C.mix(w) % np.uint64(parts)).astype(np.uint32)[words]
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            out = {k: [] for k in FIELDS}
            block = uuid.uuid4().int >> 65

            def put(**v):
                for k in FIELDS:
                    out[k].append(v.get(k))

            for p in np.flatnonzero(np.diff(cuts)).tolist():
                s = by[cuts[p]:cuts[p + 1]]
                dw, at = np.unique(words[s], return_inverse=True)
                dc, ctx_at = np.unique(contexts[s], return_inverse=True)
                put(block=block, part=p, words=w[dw].tobytes(), word_at=U.planes(at), ctxs=w[dc].tobytes(), ctx_at=U.planes(ctx_at), n=U.planes(seen[s]))
            put(block=block, part=parts, ids=ids, lens=lens, seq=U.planes(rank[seq]), pair_parts=U.planes(part))
            return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(FIELDS, KINDS)], FIELDS)

        for batch in C.slices(batches):
            t, off = _tokens(batch, cache)
            docs = batch.column("doc_id").to_pylist()
            toks.append(t), ids.extend(docs), lens.extend(np.diff(off).tolist()), train.extend(0 if held_out(d) else 1 for d in docs)
            if sum(map(len, toks)) >= BLOCK_WORDS:
                yield close()
                toks, ids, lens, train = [], [], [], []
        if ids:
            yield close()
    return run


# --- the restaurants -------------------------------------------------------

MODEL = "part int, words binary, runs binary, ctxs binary, ctx binary, n binary, t binary, sums binary, kept binary"


def asked_pairs(row):
    """(word hash, context hash) of every pair of a block's row."""
    return (np.frombuffer(row["words"], np.uint64)[U.unplanes(row["word_at"])], np.frombuffer(row["ctxs"], np.uint64)[U.unplanes(row["ctx_at"])])


def _customers():
    """Rows sorted by part -> one row per part: its (word, context) customers, sorted by word; all contexts asked for."""
    def run(batches):
        now, held, asked = None, [], []

        def close():
            ctxs = np.unique(np.concatenate(asked))
            w, c, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            c = np.searchsorted(ctxs, c)
            order = np.lexsort((c, w))
            w, c, n = w[order], c[order], n[order]
            first = np.ones(len(w), bool)
            first[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
            n = np.add.reduceat(n, np.flatnonzero(first)) if len(n) else n
            return model_row(now, w[first], c[first], n, np.ones(len(n), np.int64), len(ctxs), None, ctxs=ctxs)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("part", "words", "word_at", "ctxs", "ctx_at", "n")}
                if held and row["part"] != now:
                    yield close()
                    held, asked = [], []
                now = row["part"]
                w, c = asked_pairs(row)
                n = U.unplanes(row["n"]).astype(np.int64)
                held.append((w[n > 0], c[n > 0], n[n > 0]))
                asked.append(np.frombuffer(row["ctxs"], np.uint64))
        if held:
            yield close()
    return run


def word_sums(w: np.ndarray, x: np.ndarray):
    """Sum of x per distinct word (w sorted): (first index, sums, index of the word per row)."""
    first = np.ones(len(w), bool)
    first[1:] = w[1:] != w[:-1]
    at = np.flatnonzero(first)
    return at, (np.add.reduceat(x, at) if len(at) else x[:0]), np.cumsum(first) - 1


def model_row(part, w, c, n, t, contexts, tau, kept=b"", ctxs=np.zeros(0, np.uint64)):
    """c: places in ctxs, the part's contexts. tau: the unigram restaurant's tables per distinct word, stored before the
    pairs' own tables. kept: tables of earlier samples, each followed by the contexts' tables over all parts."""
    at, customers, _ = word_sums(w, t)
    tau = np.ones(len(at), np.int64) if tau is None else tau
    sums = np.concatenate([np.bincount(c, n, contexts), np.bincount(c, t, contexts),
                           [tau.sum(), customers.sum(), len(at), (n == 1).sum(), (n == 2).sum(), (customers == 1).sum(), (customers == 2).sum()]]).astype("<f8")
    row = [part, w[at].tobytes(), U.planes(np.diff(np.append(at, len(w)))), ctxs.tobytes(), U.planes(c), U.planes(n), U.planes(np.concatenate([tau, t])), sums.tobytes(), kept]
    kinds = [pa.int32()] + [pa.binary()] * 8
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "words", "runs", "ctxs", "ctx", "n", "t", "sums", "kept"])


def read_row(row, tables=None):
    w, c = np.repeat(np.frombuffer(row["words"], np.uint64), U.unplanes(row["runs"])), U.unplanes(row["ctx"]).astype(np.int64)
    n, t = U.unplanes(row["n"]).astype(np.int64), U.unplanes(tables or row["t"]).astype(np.int64)
    at, _, index = word_sums(w, n)
    return w, c, n, t[len(at):], t[:len(at)], at, index


class Totals:
    """What a sweep needs from all parts: customers and tables per context and of the parent, discounts."""

    def __init__(self, sums: np.ndarray, contexts: int):
        self.c, self.t = sums[:contexts], sums[contexts:2 * contexts]
        self.tau, self.customers, self.vocabulary, n1, n2, m1, m2 = sums[2 * contexts:]
        self.d2 = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
        self.d1 = min(0.95, max(0.05, m1 / (m1 + 2 * m2))) if m1 else 0.5
        self.base = 1.0 / (self.vocabulary + 1)

    def parent(self, customers, tau):
        return (np.maximum(customers - self.d1 * tau, 0) + (STRENGTH + self.d1 * self.tau) * self.base) / (STRENGTH + self.customers)

    def child(self, c, n, t, parent):
        return (np.maximum(n - self.d2 * t, 0) + (STRENGTH + self.d2 * self.t[c]) * parent) / (STRENGTH + self.c[c])


def draws(key: np.ndarray, step) -> np.ndarray:
    """A number in (0, 1) per dish and step, from hashes alone: the same wherever the dish is seated."""
    with np.errstate(over="ignore"):
        h = C.mix(key + np.asarray(step).astype(np.uint64) * GOLDEN)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def dish_keys(w: np.ndarray, ctxs: np.ndarray | None, turn: int) -> np.ndarray:
    """Seeds of the dishes of a sweep, by word and context (None: the shared restaurant)."""
    with np.errstate(over="ignore"):
        key = w if ctxs is None else w ^ C.mix(ctxs + GOLDEN)
        return C.mix(key + np.uint64(2 * turn + (ctxs is None) + 1) * C.mix(np.array([SEED], np.uint64)))


def rise(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """log gamma(x + a) - log gamma(x) for x of 12 or more, without the cancellation of the two."""
    tail = lambda y: 1 / (12 * y) - 1 / (360 * y ** 3)
    return (x - 0.5) * np.log1p(a / x) + a * np.log(x + a) - a + tail(x + a) - tail(x)


def seat(n: np.ndarray, weight: np.ndarray, step: np.ndarray, d: float, key: np.ndarray, few: int = 2048) -> np.ndarray:
    """Tables of dishes with ``n`` customers, all seated anew one after the other.

    A customer who finds s seated at t tables opens the next one with weight a = weight + step * t against s - d * t, so
    weights move with every table. The first ``few`` customers are seated by a draw each. Beyond, one draw gives the next customer who opens a table: the chance that none does from s to m is
    exp(rise(s - d * t, a) - rise(m - d * t, a)), solved for m by Newton steps. Both ways have the same distribution.
    """
    by = np.argsort(-n, kind="stable")  # dishes with customers left are a prefix
    t, size, base, more, seed = np.ones(len(n), np.int64), n[by], weight[by], step[by], key[by]
    seated, own = 1, t.astype(np.float64)
    left = np.searchsorted(-size, -1)  # of more than 1 customer
    while left and seated < few:
        a = base[:left] + more[:left] * own[:left]
        own[:left] += draws(seed[:left], seated) * (a + (seated - d * own[:left])) < a
        seated += 1
        left = np.searchsorted(-size[:left], -seated)
    t[by] = own.astype(np.int64)
    live = by[:left]
    at = np.full(len(live), seated, np.int64)
    while len(live):
        a, off = weight[live] + step[live] * t[live], d * t[live]
        start, last = at - off, n[live] - off
        goal = rise(start, a) - np.log(draws(key[live], at))
        on = rise(last, a) > goal  # others reach their last customer without a new table
        live, at, a, off, start, last, goal = (v[on] for v in (live, at, a, off, start, last, goal))
        y = np.log(start)
        top = np.log(last)
        for _ in range(8):  # convex in log x: after the first step from above
            x = np.exp(y)
            slope = x * (np.log1p(a / x) - 0.5 / (x + a) + 0.5 / x)
            y_next = np.clip(y - (rise(x, a) - goal) / slope, np.log(start), top)
            if not len(y) or np.abs(y_next - y).max() < 1e-14:
                break
            y = y_next
        opened = np.clip(np.floor(np.exp(y) + off).astype(np.int64), at, n[live] - 1)
        t[live] += 1
        at = opened + 1
        on = n[live] > at
        live, at = live[on], at[on]
    return t


# --- totals per context ------------------------------------------------------

SUMS = "part int, q int, ctxs binary, c binary, t binary"


def _send(parts: int):
    """Model rows -> per part and task q, which adds up: contexts, their customers and tables."""
    def run(batches):
        for batch in batches:
            for part, ctxs, sums in zip(*(batch.column(k).to_pylist() for k in ("part", "ctxs", "sums"))):
                ctxs, sums = np.frombuffer(ctxs, np.uint64), np.frombuffer(sums, "<f8")
                to = dealt(ctxs, parts)
                out = []
                for q in np.unique(to).tolist():
                    at = np.flatnonzero(to == q)
                    out.append((part, q, ctxs[at].tobytes(), U.planes(sums[at]), U.planes(sums[len(ctxs) + at])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), [pa.int32(), pa.int32(), *[pa.binary()] * 3])], ["part", "q", "ctxs", "c", "t"])
    return run


def dealt(ctxs: np.ndarray, parts: int) -> np.ndarray:
    return (C.mix(ctxs) % np.uint64(parts)).astype(np.int64)


def _add_up():
    """Rows sorted by q -> the totals of the same contexts, one row for each that came."""
    def run(batches):
        now, held = None, []

        def close():
            h = np.concatenate([np.frombuffer(r[1], np.uint64) for r in held])
            _, at = np.unique(h, return_inverse=True)
            back = []
            for k in (2, 3):
                back.append(np.bincount(at, np.concatenate([U.unplanes(r[k]) for r in held])).astype("<i8")[at])
            ends = np.cumsum([len(r[1]) // 8 for r in held]).tolist()
            rows = [(r[0], now, None, U.pack([back[0][a:b].tobytes()]), U.pack([back[1][a:b].tobytes()])) for r, a, b in zip(held, [0, *ends], ends)]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), [pa.int32(), pa.int32(), *[pa.binary()] * 3])], ["part", "q", "ctxs", "c", "t"])

        for batch in batches:
            for part, q, *row in zip(*(batch.column(k).to_pylist() for k in ("part", "q", "ctxs", "c", "t"))):
                if held and q != now:
                    yield close()
                    held = []
                now = q
                held.append((part, *row))
        if held:
            yield close()
    return run


def with_totals(model: DataFrame, parts: int, *more: DataFrame) -> DataFrame:
    """Per part: its model row, the totals of its contexts (q, total_c, total_t), then its rows of ``more`` (with a block)."""
    sent = model.select("part", "ctxs", "sums").mapInArrow(_send(parts), SUMS)
    back = (sent.repartition("q").sortWithinPartitions("q").mapInArrow(_add_up(), SUMS)
            .select("part", "q", F.col("c").alias("total_c"), F.col("t").alias("total_t")))
    rows = model.drop("sums").unionByName(back, allowMissingColumns=True)
    order = ["part", F.col("q").asc_nulls_first()]
    for df in more:
        rows, order = rows.unionByName(df, allowMissingColumns=True), ["part", F.col("block").asc_nulls_first(), F.col("q").asc_nulls_first()]
    return rows.repartition("part").sortWithinPartitions(*order)


class Part:
    """A model row and the totals of its contexts as they come in."""

    def __init__(self, row):
        self.row, self.ctxs = row, np.frombuffer(row["ctxs"], np.uint64)
        self.c, self.t = np.zeros(len(self.ctxs)), np.zeros(len(self.ctxs))

    def take(self, row, parts: int):
        at = np.flatnonzero(dealt(self.ctxs, parts) == row["q"])
        self.c[at] = np.frombuffer(U.unpack(row["total_c"])[0], "<i8")
        self.t[at] = np.frombuffer(U.unpack(row["total_t"])[0], "<i8")

    def totals(self, shared, t=None) -> Totals:
        return Totals(np.concatenate([self.c, self.t if t is None else t, shared]), len(self.ctxs))

    def kept(self) -> list[bytes]:
        """Tables and contexts' tables of the samples so far, the last one with the totals that came in."""
        kept = U.unpack(self.row["kept"]) if self.row["kept"] else []
        return kept + [U.pack([self.t.astype("<i8").tobytes()])] if kept else []


def _sweep(shared: np.ndarray, parts: int, turn: int, keep: bool):
    def run(batches):
        part = None

        def close():
            totals = part.totals(shared)
            w, c, n, t, tau, at, index = read_row(part.row)
            customers = np.add.reduceat(t, at) if len(at) else t
            up = totals.parent(customers, tau)[index]
            t = seat(n, (STRENGTH + totals.d2 * (totals.t[c] - t)) * up, totals.d2 * up, totals.d2, dish_keys(w, part.ctxs[c], turn))
            customers = np.add.reduceat(t, at) if len(at) else t
            tau = seat(customers, (STRENGTH + totals.d1 * (totals.tau - tau)) * totals.base, np.full(len(at), totals.d1 * totals.base), totals.d1, dish_keys(w[at], None, turn))
            kept = part.kept()
            if keep:
                kept.append(U.planes(np.concatenate([tau, t])))
            return model_row(part.row["part"], w, c, n, t, len(part.ctxs), tau, U.pack(kept) if kept else b"", part.ctxs)

        for batch in batches:
            for row in batch.to_pylist():
                if row["q"] is not None:
                    part.take(row, parts)
                    continue
                if part:
                    yield close()
                part = Part(row)
        if part:
            yield close()
    return run


def _answers(shared: list[np.ndarray], parts: int):
    """Per part: its customers with the sampled tables, the totals, then the asking blocks -> log10 P and counts per asked pair."""
    def run(batches):
        part, models = None, None

        def samples():
            kept = part.kept()
            for tables, t, s in zip(kept[::2], kept[1::2], shared):
                w, c, n, own, tau, at, index = read_row(part.row, tables)
                totals = part.totals(s, np.frombuffer(U.unpack(t)[0], "<i8"))
                # pairs are sorted by (word, context): find the context inside the word's run
                yield totals, w[at], np.add.reduceat(own, at) if len(at) else own, np.add.reduceat(n, at) if len(at) else n, tau, index * len(part.ctxs) + c, n, own

        for batch in batches:
            out = {k: [] for k in ("block", "part", "logp", "count")}
            for row in batch.to_pylist():
                if row["q"] is not None:
                    part.take(row, parts)
                    continue
                if row["block"] is None:
                    part, models = Part(row), None
                    continue
                models = models or list(samples())
                w, c = asked_pairs(row)
                c = np.searchsorted(part.ctxs, c)
                p, count = np.zeros(len(w)), np.zeros(len(w), np.int64)
                for totals, distinct, customers, total, tau, key, n, own in models:
                    if not len(distinct):  # no training word of this part
                        p += totals.child(c, np.zeros(len(w)), np.zeros(len(w)), totals.parent(np.zeros(len(w)), np.zeros(len(w))))
                        continue
                    i = np.minimum(np.searchsorted(distinct, w), len(distinct) - 1)
                    known = distinct[i] == w
                    up = totals.parent(np.where(known, customers[i], 0), np.where(known, tau[i], 0))
                    k = i * len(part.ctxs) + c
                    j = np.minimum(np.searchsorted(key, k), len(key) - 1)
                    there = known & (key[j] == k)
                    p += totals.child(c, np.where(there, n[j], 0), np.where(there, own[j], 0), up)
                    count = np.where(known, total[i], 0)
                logp = np.log10(p / len(models))
                for k, v in (("block", row["block"]), ("part", row["part"]), ("logp", logp.tobytes()), ("count", U.planes(count))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int64()), pa.array(out["part"], pa.int32()),
                                              pa.array(out["logp"], pa.binary()), pa.array(out["count"], pa.binary())], list(out))
    return run


def _scores(train_tokens: int, vocabulary: int):
    def run(batches):
        answers = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["seq"] is None:
                    answers[row["part"]] = (np.frombuffer(row["logp"], "<f8"), U.unplanes(row["count"]))
                    continue
                part = U.unplanes(row["pair_parts"])
                logp, count = np.empty(len(part)), np.empty(len(part), np.int64)
                for p, (x, y) in answers.items():
                    at = part == p
                    logp[at], count[at] = x, y
                base = np.log10((count + 0.5) / (train_tokens + 0.5 * (vocabulary + 1)))
                seq, lens = U.unplanes(row["seq"]), np.array(row["lens"], np.int64)
                starts = np.cumsum(lens) - lens  # a text has its END at least
                add = lambda x: np.add.reduceat(x[seq], starts)
                ids = row["ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([held_out(d) for d in ids]), pa.array(lens), pa.array(add((count > 0).astype(np.int64))),
                     pa.array(np.full(len(ids), train_tokens)), pa.array(add(base)), pa.array(add(logp))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                answers = {}
    return run


def _shared(model: DataFrame) -> np.ndarray:
    """The shared restaurant's 7 sums and the number of customers, added up by Spark."""
    def run(batches):
        for batch in batches:
            for b in batch.column("sums"):
                a = np.frombuffer(b.as_py(), "<f8")
                x = np.append(a[-7:], a[:(len(a) - 7) // 2].sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x)], ["i", "x"])
    sums = np.zeros(8)
    for r in model.select("sums").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        sums[r.i] = r.x
    return sums


def _forget(spark: SparkSession, path: str) -> None:
    """Give back the disk of a table that is not read again, and of the shuffles behind the one that was made from it."""
    C.delete(spark, path)
    spark.sparkContext._jvm.System.gc()


def score_documents(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document.

    Learns from documents that are not held out (crc32 of the id modulo 5 is 1); a null id is never held out. Null and
    empty texts are one END. Repeated rows count and are scored as often as they stand. Without training documents every
    word is unknown. An empty table gives no rows; other columns are not looked at.
    """
    docs = C.texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    spark, parts = docs.sparkSession, max(16, int(16 * math.sqrt(docs.rdd.getNumPartitions())))
    blocks = C.stage(docs.mapInArrow(_blocks(parts), SCHEMA), "blocks")
    asked = blocks.where("words is not null").select("block", "part", "words", "word_at", "ctxs", "ctx_at", "n")
    model = C.stage(asked.drop("block").repartition("part").sortWithinPartitions("part").mapInArrow(_customers(), MODEL), "model")
    shared = _shared(model)
    train_tokens, vocabulary = int(shared[7]), int(shared[2])
    chosen = []
    for turn in range(burn_in + samples):
        before = C._TABLES[-1][1]
        model = C.stage(with_totals(model, parts).mapInArrow(_sweep(shared[:7], parts, turn, turn >= burn_in), MODEL), "model")
        _forget(spark, before)
        shared = _shared(model)
        if turn >= burn_in:
            chosen.append(shared[:7])
    before = C._TABLES[-1][1]
    answers = C.stage(with_totals(model, parts, asked.drop("n")).mapInArrow(_answers(chosen, parts), "block long, part int, logp binary, count binary"), "answers")
    _forget(spark, before)
    whole = blocks.where("words is null").select("block", "part", "ids", "lens", "seq", "pair_parts").unionByName(answers, allowMissingColumns=True)
    return whole.repartition("block").sortWithinPartitions("block", "part").mapInArrow(
        _scores(train_tokens, vocabulary),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
