"""Operator 8: token ids as files of static range asymmetric numeral codes.

All blocks share one frequency table (counted over the whole corpus, scaled to 2^20 slots, every id at least one).
A block holds whole documents; its ids run over interleaved lanes, each a 64-bit state that gives and takes
32-bit words. Every ``CHECKPOINT`` steps the states and the place in the words are stored, so the parts of a block
can be decoded in parallel; a CRC-32 over the ids guards each block.

Ids are those of the tokenizers library's ``encode``, given each distinct unit of a slice once, many units to a call's
text; texts that cannot be cut safely (odd white space, added tokens) are encoded whole. Ids are staged and shuffled in
16 bits where the vocabulary allows it.
The files are Parquet tables with one row per block: Spark writes and reads them on any store.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C, units as U

BITS = 20
LANES = 1024
CHECKPOINT = 64  # steps of LANES ids
BLOCK_IDS = 1 << 18
SPLIT_TEXT = 32_000_000
JOINED = 256  # units of one text given to the library
UNITS = 80 * JOINED  # given to the library at once


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^BITS, none zero, as near to ``counts`` as the slots allow."""
    n = len(counts)
    room = (1 << BITS) - n
    if room <= 0:
        raise ValueError(f"{n} ids do not fit into 2^{BITS} slots")
    total = int(counts.sum())
    share = counts.astype(object) * room // total if total else np.zeros(n, object)
    freq = share.astype(np.int64) + 1
    freq[int(np.argmax(counts))] += (1 << BITS) - int(freq.sum())
    return freq.astype(np.uint64)


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.base = np.cumsum(self.freq) - self.freq
        self.slots = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(words, checkpoints). A checkpoint is the word offset and the states before its step."""
        low, shift = np.uint64(0xFFFFFFFF), np.uint64(32)
        x = np.full(LANES, 1 << 32, np.uint64)
        steps = -(-len(ids) // LANES)
        words, states = [], []
        for k in range(steps - 1, -1, -1):
            s = ids[k * LANES:(k + 1) * LANES]
            n = len(s)
            f, c = self.freq[s], self.base[s]
            y = x[:n]
            out = y >= (f << np.uint64(64 - BITS))
            words.append((y[out] & low).astype("<u4"))
            y = np.where(out, y >> shift, y)
            q = y // f
            x[:n] = (q << np.uint64(BITS)) + (y - q * f) + c
            if k % CHECKPOINT == 0:
                states.append((len(words), x.copy()))
        words.reverse()
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        marks = b"".join(np.int64(ends[len(words) - at - 1] if at < len(words) else 0).tobytes() + x.astype("<u8").tobytes()
                         for at, x in reversed(states))
        return b"".join(w.tobytes() for w in words), marks

    def decode(self, words: bytes, marks: bytes, n: int) -> np.ndarray:
        """All ids of a block, checkpoint by checkpoint (each could run on its own)."""
        out = np.empty(n, np.uint32)
        size = CHECKPOINT * LANES
        for i in range(-(-n // size)):
            out[i * size:(i + 1) * size] = self.decode_part(words, marks, n, i)
        return out

    def decode_part(self, words: bytes, marks: bytes, n: int, part: int) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        stream = np.frombuffer(words, "<u4")
        width = 8 + 8 * LANES
        mark = marks[part * width:(part + 1) * width]
        at = int(np.frombuffer(mark, "<i8", 1)[0])
        x = np.frombuffer(mark, "<u8", LANES, 8).astype(np.uint64)
        todo = min(n - part * CHECKPOINT * LANES, CHECKPOINT * LANES)
        out = np.empty(todo, np.uint32)
        mask = np.uint64((1 << BITS) - 1)
        for a in range(0, todo, LANES):
            m = min(LANES, todo - a)
            y = x[:m]
            slot = y & mask
            s = self.slots[slot.astype(np.int64)]
            out[a:a + m] = s
            y = self.freq[s] * (y >> np.uint64(BITS)) + slot - self.base[s]
            need = y < np.uint64(1 << 32)
            k = int(need.sum())
            y[need] = (y[need] << np.uint64(32)) | stream[at:at + k].astype(np.uint64)
            at += k
            x[:m] = y
        return out


# --- encoding --------------------------------------------------------------

def id_type(size: int) -> str:
    """Of staged ids below ``size``; files and results have 32 bits."""
    return "<u2" if size <= 1 << 16 else "<u4"


def cut(texts: list[str], whole) -> tuple[list[str], pa.Array, np.ndarray, np.ndarray]:
    """(plain units, units after a blank, unit numbers of all texts, their count per text).

    A text is cut at every blank; ``whole`` ones and those with odd white space are one plain unit. Plain units come
    first in the numbering; units after a blank are named without it.
    """
    column = pa.array(texts, pa.large_string())
    odd = np.asarray(pc.match_substring_regex(column, U.ODD_CLASS)).astype(bool)
    kept = np.array([not whole(t) for t in texts], bool) & ~odd
    parts = pc.split_pattern(column if kept.all() else pc.if_else(pa.array(kept), column, pa.scalar("", pa.large_string())), " ")
    count = np.diff(C.offsets_of(parts)).astype(np.int64)
    heads = np.zeros(int(count.sum()), bool)
    heads[np.cumsum(count) - count] = True
    values = parts.flatten()
    rest = values.filter(pa.array(~heads)).dictionary_encode()
    first = values.filter(pa.array(heads)).to_numpy(zero_copy_only=False).tolist()
    plain: dict[str, int] = {}
    head = np.array([plain.setdefault(x, len(plain)) if x else -1
                     for x in (f if k else t for f, t, k in zip(first, texts, kept.tolist()))], np.int64)
    seq = np.empty(len(heads), np.int64)
    seq[heads] = head
    seq[~heads] = rest.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(plain)
    return list(plain), rest.dictionary, seq[seq >= 0], count - (head < 0)


def encode_units(tok, width: np.ndarray, plain: list[str], spaced: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all units one after the other, ids per unit in that order, place of each unit in it).

    A unit with a leading blank has a border before it whatever stands there but white space. Such units are encoded
    many to a text, and the bytes of the ids' tokens (``width``) tell where each one ends; where an end falls into a
    token, one by one.
    """
    units = plain + [" " + x for x in spaced.to_numpy(zero_copy_only=False).tolist()]
    size = np.asarray(pc.binary_length(spaced)).astype(np.int64)
    closed = (size > 0) & (size == np.asarray(pc.binary_length(pc.utf8_rtrim_whitespace(spaced))))  # no white space at its end
    joined = np.flatnonzero(closed) + len(plain)
    alone = [*range(len(plain)), *(np.flatnonzero(~closed) + len(plain)).tolist()]
    order, counts, flat = [], [], []
    for a in range(0, len(joined), UNITS):
        groups = [joined[k:k + JOINED] for k in range(a, min(a + UNITS, len(joined)), JOINED)]
        texts = ["".join([units[i] for i in g.tolist()]) for g in groups]
        for group, e in zip(groups, tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum(size[group - len(plain)] + 1)
            reach = np.cumsum(width[ids])
            at = np.searchsorted(reach, ends)
            if not len(ids) or reach[-1] != ends[-1] or (reach[at] != ends).any():
                alone += group.tolist()
                continue
            order.append(group), counts.append(np.diff(at, prepend=-1)), flat.append(ids)
    for a in range(0, len(alone), UNITS):
        some = alone[a:a + UNITS]
        ids = [e.ids for e in tok.encode_batch_fast([units[i] for i in some], add_special_tokens=False)]
        order.append(np.array(some)), counts.append(np.array([len(x) for x in ids]))
        flat += [np.array(x, np.uint32) for x in ids]
    none = np.zeros(0, np.int64)
    place = np.empty(len(units), np.int64)
    place[np.concatenate([none, *order])] = np.arange(len(units))
    return np.concatenate([none.astype(np.uint32), *flat]), np.concatenate([none, *counts]), place


@lru_cache(maxsize=1)
def library(path: str, special: bool):
    """(tokenizer, its added tokens, bytes per id); a worker's tasks share them."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = not special
    tok.model._resize_cache(0)  # units are distinct: the library's memory of words costs more than it finds
    added = [t.content for t in tok.get_added_tokens_decoder().values() if special or not t.special]
    return tok, added, np.array([len(tok.id_to_token(i) or "") for i in range(tok.get_vocab_size())], np.int64)  # a character a byte


def _tokenize(path: str, end: int, special: bool, kind: str):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core
        tok, added, width = library(path, special)

        for batch in C.slices(batches, limit=SPLIT_TEXT):
            texts = [(b or b"").decode("utf-8", "replace") for b in batch.column("text").to_pylist()]
            plain, spaced, seq, per = cut(texts, lambda text: tok.normalizer is not None or any(x in text for x in added))
            flat, counts, place = encode_units(tok, width, plain, spaced)
            ids, n = U.gather(counts, flat.astype(kind), place[seq])
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *per.tolist()])]
            tail = np.array([end], kind).tobytes()
            out = [ids[x:y].tobytes() + tail for x, y in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])
    return run


def _count(size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = batch.column("ids")
            a, b = C.offsets_of(ids)[[0, -1]].tolist()
            if b > a:  # all rows at once: a count over the vocabulary for each would cost more than the ids
                total += np.bincount(np.frombuffer(ids.buffers()[2], np.uint8)[a:b].view(id_type(size)), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])
    return run


FILE = "part int, at long, n long, doc_ids array<long>, lens array<long>, crc long, marks binary, words binary"


def _write(freq, kind: str):
    """Rows in doc_id order per partition -> blocks; ``at``: ids of the partition before the block."""
    def run(batches):
        coder, part, at = Coder(freq.value), None, 0
        docs, ids, size = [], [], 0

        def close():
            flat = np.concatenate(ids)
            words, marks = coder.encode(flat)
            row = [part, at, len(flat), docs, [len(x) for x in ids], zlib.crc32(flat.astype("<u4").tobytes()), marks, words]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "at", "n", "doc_ids", "lens", "crc", "marks", "words"])

        for batch in batches:
            for p, d, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                a = np.frombuffer(x.as_py(), kind)
                if ids and (p != part or size + len(a) > BLOCK_IDS):
                    yield close()
                    at = 0 if p != part else at + size
                    docs, ids, size = [], [], 0
                part = p
                docs.append(d), ids.append(a)
                size += len(a)
        if ids:
            yield close()
    return run


def _read(freq):
    def run(batches):
        coder = Coder(freq.value)
        for batch in batches:
            for r in batch.to_pylist():
                flat = coder.decode(r["words"], r["marks"], r["n"])
                if zlib.crc32(flat.astype("<u4").tobytes()) != r["crc"]:
                    raise ValueError(f"block at {r['at']} of part {r['part']}: checksum differs")
                ends = np.cumsum(r["lens"])
                starts = ends - r["lens"]
                data = [flat[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(data), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["at"] + starts),
                     pa.array(r["lens"], pa.int64()), pa.array(data, pa.binary())], ["part", "doc_id", "at", "n_tokens", "ids"])
    return run


def write_ids(ids: DataFrame, path: str, size: int):
    """Write (doc_id, ids as bytes of ``id_type(size)``) in ascending doc_id order to ``path``; returns the broadcast frequency table."""
    spark = ids.sparkSession
    counts = np.zeros(size, np.int64)
    # one row per id of the vocabulary comes to the driver
    for r in ids.select("ids").mapInArrow(_count(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    freq = spark.sparkContext.broadcast(scaled(counts))
    dealt = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    dealt.mapInArrow(_write(freq, id_type(size)), FILE).write.parquet(path)
    return freq


def read_ids(spark: SparkSession, path: str, freq) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of every document in the files."""
    blocks = spark.read.schema(FILE).parquet(path)
    # one row per file part: the ids before it
    sums = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, total = [], 0
    for part, n in sums:
        base.append((part, total))
        total += n
    bases = spark.createDataFrame(base, "part int, base long")
    return (blocks.mapInArrow(_read(freq), "part int, doc_id long, at long, n_tokens long, ids binary")
            .join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids"))


def token_files(docs: DataFrame, tokenizer: str, pattern: str, end: int = 2, path: str | None = None, special: bool = False) -> DataFrame:
    """Encode every text, append ``end``, write the files, read them back: doc_id, start, n_tokens, ids (bytes).

    Null and empty texts are just the end id. ``pattern`` names the tokenizer's pre-token rule; cutting at
    blanks needs no more of it. Rows with equal ids stand in one file part, in any order between them; a
    null doc_id stands first. ``special``: the tokenizer's special tokens that stand in a text get their own id, as in
    ``encode(text, add_special_tokens=False)``; else they are ordinary text. An empty table writes and gives no rows. Other columns are not looked at.
    """
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1)
    docs = C.texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    ids = C.stage(docs.mapInArrow(_tokenize(tokenizer, end, special, id_type(size)), "doc_id long, ids binary"), "ids")
    path = path or C.new_path(spark, "files")
    return read_ids(spark, path, write_ids(ids, path, size))
