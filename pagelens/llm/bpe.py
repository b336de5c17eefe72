"""Operator 3: byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. texts are read in blocks. A block lists its distinct units (see units.py) and, per document, the unit numbers
   in order of position; both go to a work table;
2. distinct units are dealt by hash over all blocks: whoever receives a hash range encodes each distinct unit once
   and answers every block that asked. A unit that a third of all rows holds is one entry per block;
3. answers are joined back by block and ids reassembled by position;
4. ids are decoded by joining the token-byte table (as long as the vocabulary, held by every task).
"""

from __future__ import annotations

import base64
import math
import uuid

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common as C, units as U

BLOCK_BYTES = 64_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


COLUMNS = ["block", "part", "data", "seq", "ids", "lens", "hash_parts", "sizes"]


def _blocks(pattern: str, parts: int):
    def run(batches):
        index, ids, lens, seqs, size = U.UnitIndex(pattern), [], [], [], 0

        def close():
            block = uuid.uuid4().int >> 65
            seq = np.concatenate(seqs)
            n = len(index.units)
            code, sizes = U.code_sequence(seq, n)
            units = [u.encode() for u in index.units]
            part = np.fromiter((xxhash.xxh3_64_intdigest(u) % parts for u in units), np.uint32, n)
            by_part = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by_part], np.arange(parts + 1))
            out = {k: [] for k in COLUMNS}

            def put(**v):
                for k in COLUMNS:
                    out[k].append(v.get(k))

            for p in np.flatnonzero(np.diff(cuts)).tolist():
                put(block=block, part=p, data=U.pack([units[i] for i in by_part[cuts[p]:cuts[p + 1]].tolist()]))
            put(block=block, part=parts, seq=code, ids=ids, lens=lens,
                hash_parts=U.planes(part) if n else b"", sizes=sizes)
            fields = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(COLUMNS, fields)], COLUMNS)

        for batch in C.slices(batches):
            for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                seq = index.numbers((blob or b"").decode("utf-8", "replace"))
                ids.append(doc), lens.append(len(seq)), seqs.append(seq)
                size += len(blob or b"") + 100
            if size >= BLOCK_BYTES:
                yield close()
                index, ids, lens, seqs, size = U.UnitIndex(pattern), [], [], [], 0
        if ids:
            yield close()
    return run


def _encode(path: str, pattern: str):
    """Rows sorted by part: every distinct unit of a part is encoded once, each asking block gets its ids."""
    def run(batches):
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        known: dict[bytes, np.ndarray] = {}
        now = None
        for batch in batches:
            blocks, parts, out = batch.column("block"), batch.column("part").to_pylist(), []
            for p, data in zip(parts, batch.column("data")):
                if p != now:
                    now, known = p, {}
                got = []
                for unit in U.unpack(data.as_py()):
                    x = known.get(unit)
                    if x is None:
                        x = known[unit] = np.array(enc.encode_ordinary(unit.decode()), "<u4").tobytes()
                    got.append(x)
                counts = np.fromiter(map(len, got), np.int64, len(got)) // 4
                out.append(U.pack([U.planes(counts), U.code_numbers(np.frombuffer(b"".join(got), "<u4"))]))
            yield pa.RecordBatch.from_arrays([blocks, batch.column("part"), pa.array(out, pa.binary())], ["block", "part", "data"])
    return run


def _reassemble(path: str):
    """Rows sorted by (block, part): the answers, then the block itself."""
    def run(batches):
        table = {i: b for b, i in load_ranks(path).items()}
        to_bytes = table.__getitem__
        answers: dict[int, list[bytes]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("seq")[i].as_py() is None:
                    counts, coded = U.unpack(batch.column("data")[i].as_py())
                    answers[batch.column("part")[i].as_py()] = (U.unplanes(counts).astype(np.int64), U.decode_numbers(coded).astype(np.uint32))
                    continue
                code, ids, lens, sizes = (batch.column(c)[i].as_py() for c in ("seq", "ids", "lens", "sizes"))
                seq = U.read_sequence(code, sizes)
                parts = batch.column("hash_parts")[i].as_py()
                # a part's answers are in the order of the block's units of that part
                by_part = np.argsort(U.unplanes(parts), kind="stable") if parts else np.zeros(0, np.int64)
                given = [answers[p] for p in sorted(answers)] or [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
                place = np.empty(len(by_part), np.int64)
                place[by_part] = np.arange(len(by_part))
                counts, flat = (np.concatenate(x) for x in zip(*given))
                seq = place[seq]
                at = np.concatenate([[0], np.cumsum(lens)]).tolist()
                for a in range(0, len(ids), 500):
                    b = min(len(ids), a + 500)
                    tokens, n = U.gather(counts, flat, seq[at[a]:at[b]])
                    ends = np.concatenate([[0], np.cumsum(n)])[np.array(at[a:b + 1]) - at[a]].tolist()
                    coded = [tokens[x:y].tobytes() for x, y in zip(ends, ends[1:])]
                    plain = [b"".join(map(to_bytes, tokens[x:y].tolist())) for x, y in zip(ends, ends[1:])]
                    cols = [pa.array(ids[a:b], pa.int64()), pa.array([len(x) // 4 for x in coded], pa.int64()),
                            pa.array(coded, pa.binary()), pa.array(plain, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"])
                answers = {}
    return run


def bpe_roundtrip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (bytes) per input row.

    ``path``: a rank file (token in base 64, rank); ``pattern``: the split into pre-tokens. Null and empty texts have
    no ids. Repeated rows, null ids and very long texts are rows like others; an empty table gives no rows; other
    columns are not looked at.
    """
    docs = C.texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    parts = max(16, int(16 * math.sqrt(docs.rdd.getNumPartitions())))
    schema = "block long, part int, data binary, seq binary, ids array<long>, lens array<int>, hash_parts binary, sizes binary"
    blocks = C.stage(docs.mapInArrow(_blocks(pattern, parts), schema), "blocks")
    asked = blocks.where("data is not null").select("block", "part", "data").repartition("part").sortWithinPartitions("part", "block")
    answers = asked.mapInArrow(_encode(path, pattern), "block long, part int, data binary")
    whole = blocks.where("data is null").unionByName(answers, allowMissingColumns=True)
    whole = whole.repartition("block").sortWithinPartitions("block", "part")
    return whole.mapInArrow(_reassemble(path), "doc_id long, n_tokens long, ids binary, decoded binary")
