"""Operator 11: periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words with smallest period q and length >= max(6, 4 * q) that no neighbouring word
extends. At the dyadic scale t (t = 8, 16, ...; it supplies the periods t <= q < 2 * t) every position has the hash of
its t words as identifier. A position is synchronising if the least identifier of the t + 1 positions from it on is its
own or the last one's. The choice hangs on the next 2 * t words only, so equal contexts are chosen alike, and any t
consecutive positions hold a synchronising one, unless 2 * t identifiers in a row are left out. Inside a run of period
q the next synchronising position with the same 2 * t words stands exactly q further on, and a run of four periods is
long enough to hold such a pair: neighbouring positions with equal context propose (place, period).

Positions whose t words have a period of t / 4 or less are left out of the choice: in a long repetition of a short
phrase all of them would be chosen. The runs found at smaller scales are these highly periodic regions, and their
periods are supplied there; periods below 8 are found by comparing every word with the one p further on. Proposals of
one run are merged and extended, and the words themselves decide.

All documents of an Arrow slice are one flat array of word numbers with a number of its own at every border. A document
never leaves its task: there is no shuffle, and a run is found whole however long the document is. A scale takes part
only for documents of at least 4 * t words.

Null or empty texts and texts without words have no runs. Rows are treated one by one: null and repeated doc_ids keep
their rows, and columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

FIRST_SCALE = 8  # shorter periods are compared directly
LEAST_WORDS, LEAST_PERIODS = 6, 4

Run = tuple[int, int, int]  # start, end, period


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def least_of(ids: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every window of ``size`` (a power of two) values, by doubling."""
    out, width = ids, 1
    while width < size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out


def long_enough(length: int, period: int) -> bool:
    return length >= max(LEAST_WORDS, LEAST_PERIODS * period)


def small_periods(words: np.ndarray) -> list[Run]:
    """Runs of the periods below FIRST_SCALE."""
    found = {}
    for p in range(1, min(FIRST_SCALE, len(words))):
        start, end = stretches(words[:-p] == words[p:])
        for a, b in zip(start.tolist(), (end + p).tolist()):
            if long_enough(b - a, p):
                found.setdefault((a, b), p)  # a multiple of the smallest period has the same stretch
    return [(a, b, p) for (a, b), p in found.items()]


def synchronising(mixed: np.ndarray, scale: int, regions: list[Run]) -> np.ndarray:
    """Synchronising positions at ``scale``; the windows of ``scale`` words inside ``regions`` are left out."""
    ids = C.windows(mixed, scale)
    skip = np.zeros(len(ids) + 1, np.int32)
    for a, b, _ in regions:
        skip[a] += 1
        skip[b - scale + 1] -= 1
    ids = np.where(np.cumsum(skip[:-1]) > 0, np.uint64(2**64 - 1), ids)
    if len(ids) <= scale:
        return np.zeros(0, np.int64)
    first, last = ids[:-scale], ids[scale:]
    least = np.minimum(least_of(ids, scale)[:len(first)], last)
    return np.flatnonzero(((least == first) | (least == last)) & (least != np.uint64(2**64 - 1)))


def proposals(mixed: np.ndarray, scale: int, regions: list[Run]) -> list[Run]:
    """Merged (start, end, period) of neighbouring synchronising positions with equal context, scale <= period < 2 * scale."""
    at = synchronising(mixed, scale, regions)
    context = C.windows(mixed, 2 * scale)
    at = at[at < len(context)]
    key = context[at]
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    gap = np.diff(at)
    near = np.flatnonzero((key[1:] == key[:-1]) & (gap >= scale) & (gap < 2 * scale))
    start, period = at[near], gap[near]
    end = start + period + 2 * scale
    order = np.lexsort((start, period))
    merged: list[list[int]] = []
    for a, b, p in zip(start[order].tolist(), end[order].tolist(), period[order].tolist()):
        if merged and merged[-1][2] == p and a <= merged[-1][1] - p:  # p common words or more: one repetition
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, p])
    return [(a, b, p) for a, b, p in merged]


def extend(words: np.ndarray, a: int, b: int, p: int) -> tuple[int, int]:
    """The largest stretch around [a, b) with period p, found in growing steps."""
    step = p
    while a:
        low = max(0, a - step)
        differ = np.flatnonzero(words[low:a] != words[low + p:a + p])
        if len(differ):
            a = low + int(differ[-1]) + 1
            break
        a, step = low, 2 * step
    step = p
    while b < len(words):
        high = min(len(words), b + step)
        differ = np.flatnonzero(words[b:high] != words[b - p:high - p])
        if len(differ):
            b += int(differ[0])
            break
        b, step = high, 2 * step
    return a, b


def flat_runs(words: np.ndarray, sizes: np.ndarray) -> list[Run]:
    """Runs of all documents in ``words``: their word numbers one after the other, each document followed by a number of its own."""
    found = small_periods(words)
    known = {(a, b) for a, b, _ in found}
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    scale = FIRST_SCALE
    while True:
        take = np.flatnonzero(sizes >= LEAST_PERIODS * scale)
        if not len(take):
            return found
        # the documents that are long enough, side by side
        length = sizes[take] + 1
        slot = np.full(len(sizes), -1)
        slot[take] = np.concatenate([[0], np.cumsum(length)])[:-1]
        shift = np.repeat(begin[take] - slot[take], length)
        part = words[np.arange(len(shift)) + shift]
        regions = []
        for a, b, p in found:
            d = int(np.searchsorted(begin, a, "right")) - 1
            if slot[d] >= 0 and 4 * p <= scale <= b - a:
                move = int(slot[d] - begin[d])
                regions.append((a + move, b + move, p))
        mixed = C.mix(part.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for a, b, p in proposals(mixed, scale, regions):
            if not np.array_equal(part[a:b - p], part[a + p:b]):  # two contexts with one hash
                continue
            a, b = extend(part, a, b, p)
            whole = (a + int(shift[a]), b + int(shift[a]))
            if long_enough(b - a, p) and whole not in known:
                known.add(whole)
                found.append((*whole, p))
        scale *= 2


def slice_runs(texts: list[bytes | None]) -> tuple[list[list[bytes]], list[list[Run]]]:
    """Words of every text, and its runs as (start, end, period) by start, then period."""
    number: dict[bytes, int] = {}
    split = [t.split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.empty(int(sizes.sum()) + len(split), np.int64)
    at = 0
    for i, w in enumerate(split):
        words[at:at + len(w)] = [number.setdefault(x, len(number)) for x in w]
        words[at + len(w)] = -1 - i
        at += len(w) + 1
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    runs: list[list[Run]] = [[] for _ in split]
    for a, b, p in flat_runs(words, sizes):
        d = int(np.searchsorted(begin, a, "right")) - 1
        runs[d].append((a - int(begin[d]), b - int(begin[d]), p))
    return split, [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int32)
    for a, b, p in runs:
        drop[a + p] += 1
        drop[b] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()])


def _runs():
    def run(batches):
        for batch in C.slices(batches):
            words, runs = slice_runs(batch.column("text").to_pylist())
            flat = [r for one in runs for r in one]
            struct = pa.StructArray.from_arrays(
                [pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b - a for a, b, _ in flat], pa.int64()), pa.array([p for _, _, p in flat], pa.int64())],
                ["start", "length", "period"])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(ends, struct),
                 pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs (array of start, length, period, in words, by start, then period) and
    collapsed (binary: the text's words without those that a run repeats after its first period, joined by blanks)."""
    source = C.texts(docs)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_runs(), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
