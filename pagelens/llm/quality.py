"""Operator 7: quality classifier from weak labels.

Overlapping heuristics vote on each text (bad, good or no vote): shape heuristics for junk, learned insult words for
toxicity, and the ``labels`` table where it has the document. Expectation-maximisation over the vote patterns of all
documents estimates each labeller's accuracies and gives posterior labels. A linear scorer over hashed features (word
presence, shape) is trained on the posteriors of a bounded sample of labelled documents and scores every document; a
document is rejected when its probability of being bad reaches ``THRESHOLD``.

The sample (``SAMPLE`` labelled documents with the smallest hashed ids) bounds only what is fitted on texts: insult
words and scorer weights. Votes, accuracies and scores cover all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

SAMPLE = 12_000
BUCKETS = 1 << 18
THRESHOLD = 0.5
MIN_SUPPORT, MIN_SHARE, PURITY = 5, 0.01, 0.97
ROUNDS, L1 = 200, 1e-3
WORD = 0.2  # value of a word's feature; shape and insult features have 1
MARKS = b".,!?;:"

#: labeller -> what it votes on
JUNK = ["repeats", "symbols", "marks", "lengths", "runs", "quality_label"]
TOXIC = ["one_insult", "two_insults", "toxic_label"]


def shape(words: list[bytes], text: bytes) -> tuple[float, ...]:
    """Distinct share, letter share, share of words without letters, mean length, share of words equal to the one before.

    Each as if ``PRIOR`` ordinary words had been read before, so a few words say little.
    """
    n = len(words) + PRIOR
    chars = sum(map(len, words)) + 5.0 * PRIOR
    letters = len(text.translate(None, NOT_LETTERS)) + 4.9 * PRIOR
    bare = sum(1 for w in words if not w.translate(None, NOT_LETTERS))
    same = sum(a == b for a, b in zip(words, words[1:]))
    return ((len(set(words)) + 0.9 * PRIOR) / n, letters / chars, bare / n, chars / n, same / n)


PRIOR = 30
NOT_LETTERS = bytes(i for i in range(128) if not chr(i).isalnum())


def votes(s: tuple[float, ...]) -> list[int]:
    """1 bad, 0 good, 2 no vote, for the shape labellers."""
    distinct, letters, bare, length, same = s
    return [
        1 if distinct < 0.35 else 0 if distinct > 0.5 else 2,
        1 if letters < 0.8 else 0 if letters > 0.9 else 2,
        1 if bare > 0.15 else 0 if bare < 0.05 else 2,
        1 if length > 8 or length < 3.5 else 0 if 4 < length < 7.5 else 2,
        1 if same > 0.3 else 0 if same < 0.05 else 2,
    ]


def shape_features(s: tuple[float, ...]) -> list[int]:
    """Bucket numbers of the shape, hashed like words."""
    return [C.xxhash.xxh3_64_intdigest(b"\0%d:%d" % (i, int(min(x, 20) * (2 if i == 3 else 20)))) % BUCKETS for i, x in enumerate(s)]


def features(text: bytes | None, insults: frozenset, cache: C.WordHash) -> np.ndarray:
    """Buckets of the distinct words, then the ``FLAGS`` buckets of shape and insults."""
    text = (text or b"").translate(C.LOWER)
    plain = text.split()
    words = set(text.translate(KEEP).split())
    hits = min(3, len(insults & words))
    flags = [*shape_features(shape(plain, text)), C.xxhash.xxh3_64_intdigest(b"\1%d" % hits) % BUCKETS]
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)) % np.uint64(BUCKETS)
    return np.concatenate([np.unique(h.astype(np.int64)), np.array(flags, np.int64)])


def values(n: int) -> np.ndarray:
    return np.concatenate([np.full(n - FLAGS, WORD), np.ones(FLAGS)])


FLAGS = 6
KEEP = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def _word_texts():
    """(word, text key, toxic) per distinct word of a text. The key is the smallest word hash of the text, which most
    near copies share: a group of copies counts like a few texts."""
    def run(batches):
        cache = C.WordHash()
        for batch in C.slices(batches):
            out = set()
            for blob, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set((blob or b"").translate(C.LOWER).translate(KEEP).split())
                key = min(map(cache.__getitem__, words), default=0) >> 1
                out.update((w, key, toxic) for w in words)
            w, k, t = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(k, pa.int64()), pa.array(t, pa.int32())], ["w", "k", "toxic"])
    return run


def insult_words(sample: DataFrame) -> list[bytes]:
    """Words of many unlike toxic texts that hardly any other text has."""
    pairs = C.stage(sample.where("toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
                    .mapInArrow(_word_texts(), "w binary, k long, toxic int").distinct(), "words")
    unlike = pairs.where("toxic = 1").select(F.countDistinct("k")).collect()[0][0]
    found = pairs.groupBy("w").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("b"))
    found = found.where((F.col("a") >= max(MIN_SUPPORT, MIN_SHARE * unlike)) & (F.col("a") >= PURITY * (F.col("a") + F.col("b"))))
    return sorted(bytes(r.w) for r in found.select("w").collect())


def _votes(insults: frozenset):
    def run(batches):
        for batch in C.slices(batches):
            out = []
            for blob in batch.column("text").to_pylist():
                text = (blob or b"").translate(C.LOWER)
                words = text.split()
                v = votes(shape(words, text))
                hits = len(insults.intersection(text.translate(KEEP).split()))
                v += [1 if hits >= 1 else 0, 1 if hits >= 2 else 2 if hits else 0]
                out.append(sum(x * 3 ** i for i, x in enumerate(v)))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(out, pa.int32())], ["row_id", "votes"])
    return run


def expectation_maximisation(patterns: np.ndarray, weights: np.ndarray, trusted: int, rounds: int = 100):
    """patterns: rows of votes (1, 0, 2 = none). Returns the posterior of bad per pattern and, per labeller, P(vote | good, bad).

    Starts from labellers that are right more often than not; ``trusted`` is believed more at first.
    """
    k = patterns.shape[1]
    table = np.empty((k, 2, 3))
    for i in range(k):
        r = 0.95 if i == trusted else 0.8
        table[i] = [[r, 1 - r, 0.5], [1 - r, r, 0.5]]
    prior = 0.15
    hot = np.stack([patterns == v for v in range(3)], axis=2)  # pattern, labeller, vote
    for _ in range(rounds):
        log = np.log(np.maximum(table, 1e-9))
        good = np.log(1 - prior) + np.einsum("pkv,kv->p", hot, log[:, 0])
        bad = np.log(prior) + np.einsum("pkv,kv->p", hot, log[:, 1])
        post = 1 / (1 + np.exp(np.clip(good - bad, -500, 500)))
        for c, w in ((0, weights * (1 - post)), (1, weights * post)):
            count = np.einsum("p,pkv->kv", w, hot) + 0.5
            table[:, c] = count / count.sum(axis=1, keepdims=True)
        prior = float(np.clip((weights * post).sum() / max(weights.sum(), 1), 1e-3, 0.7))
    return post, table


def train(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Sparse logistic regression by accelerated proximal gradient steps; both classes weigh the same."""
    w, b = np.zeros(BUCKETS), 0.0
    idx, x = np.concatenate(rows), np.concatenate([values(len(r)) for r in rows])
    lens = np.array([len(r) for r in rows])
    starts = np.cumsum(lens) - lens
    used, idx = np.unique(idx, return_inverse=True)
    n, v = len(rows), np.zeros(len(used))
    u, ub, t = v.copy(), b, 1.0
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    cost = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
    # the largest eigenvalue is at most the largest squared length of a row, weighted
    step = 4.0 / float((cost * np.add.reduceat(x * x, starts)).mean() * 2 + 1)
    for _ in range(ROUNDS):
        z = np.add.reduceat(u[idx] * x, starts) + ub
        g = cost * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        new = u - step * np.bincount(idx, np.repeat(g, lens) * x, len(used))
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        nb = ub - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, ub = new + (t - 1) / t2 * (new - v), nb + (t - 1) / t2 * (nb - b)
        v, b, t = new, nb, t2
    w[used] = v
    return w, float(b)


def _featurize(insults: frozenset):
    def run(batches):
        cache = C.WordHash()
        for batch in C.slices(batches):
            out = [features(b, insults, cache).astype("<i4").tobytes() for b in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column("votes")], ["x", "votes"])
    return run


def _score(weights, bias: float, insults: frozenset):
    def run(batches):
        cache, w = C.WordHash(), weights.value
        for batch in C.slices(batches):
            z = np.empty(batch.num_rows)
            for i, b in enumerate(batch.column("text").to_pylist()):
                x = features(b, insults, cache)
                z[i] = bias + WORD * w[x[:-FLAGS]].sum() + w[x[-FLAGS:]].sum()
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p)], ["row", "p_bad"])
    return run


def split_votes(codes: np.ndarray, k: int) -> np.ndarray:
    return np.stack([codes // 3 ** i % 3 for i in range(k)], axis=1)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of ``docs`` as struct ``row``, p_bad and rejected.

    ``labels``: (doc_id, quality, toxic), each 0, 1 or null; several rows of an id count as bad if one is. Null and empty
    texts get the score of a text without words (kept). Repeated rows are scored alike, null ids have no label. Without
    labels or without documents nothing is rejected and no row is lost. Clashing column names stay inside ``row``.
    """
    spark = docs.sparkSession
    C.ship(spark)
    lab = (labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t"))
           .where("l_id is not null").groupBy("l_id").agg(F.min("q").alias("quality"), F.max("t").alias("toxic")))
    plain = docs.select(F.col("doc_id").cast("long").alias("row_id"), F.col("text").cast("binary").alias("text"))
    present = lab.join(plain.select("row_id").distinct(), F.col("l_id") == F.col("row_id"), "left_semi")
    picked = C.stage(present.orderBy(F.xxhash64("l_id"), "l_id").limit(SAMPLE), "picked")
    sample = C.stage(plain.join(F.broadcast(picked), F.col("row_id") == F.col("l_id")).dropDuplicates(["text"]).select("row_id", "text", "quality", "toxic"), "sample")
    insults = insult_words(sample)
    voted = plain.mapInArrow(_votes(frozenset(insults)), "row_id long, votes int")
    base = 3 ** 7
    label_votes = (F.when(F.col("quality").isNull(), 2).otherwise(1 - F.col("quality")) * base + F.when(F.col("toxic").isNull(), 2).otherwise(F.col("toxic")) * base * 3)
    counted = (voted.join(lab, F.col("row_id") == F.col("l_id"), "left").groupBy((F.col("votes") + label_votes).alias("code"))
               .agg(F.count("*").alias("n")).collect())  # one row per vote pattern, at most 3^9
    codes = np.array([r.code for r in counted], np.int64)
    weight = np.array([r.n for r in counted], float)
    grid = split_votes(codes, 9)
    junk, toxic = grid[:, [0, 1, 2, 3, 4, 7]], grid[:, [5, 6, 8]]
    p_bad = {}
    if len(codes):
        pj, _ = expectation_maximisation(junk, weight, trusted=5)
        pt, _ = expectation_maximisation(toxic, weight, trusted=2)
        p_bad = dict(zip(codes.tolist(), (1 - (1 - pj) * (1 - pt)).tolist()))
    fit = (sample.select("row_id", "text").mapInArrow(_votes(frozenset(insults)), "row_id long, votes int")
           .join(sample, "row_id").select("text", (F.col("votes") + label_votes).cast("int").alias("votes"))
           .mapInArrow(_featurize(frozenset(insults)), "x binary, votes int").collect())  # at most SAMPLE rows
    x = [np.frombuffer(r.x, "<i4").astype(np.int64) for r in fit]
    y = np.array([p_bad[r.votes] for r in fit])
    w, b = train(x, y) if len(x) and y.max() > 0.5 else (np.zeros(BUCKETS), -5.0)
    weights = spark.sparkContext.broadcast(w.astype(np.float32))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("binary").alias("text"))
    scored = rows.mapInArrow(_score(weights, b, frozenset(insults)), f"row {rows.schema['row'].dataType.simpleString()}, p_bad double")
    return scored.withColumn("rejected", F.col("p_bad") >= THRESHOLD)
