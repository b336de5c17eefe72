"""Cutting texts into units that a byte-level BPE encodes independently.

The pre-token pattern never matches across the border between a non-blank character and white space, and what it
matches after such a border does not depend on the text before. A text whose white space never stands directly
before a blank can therefore be cut at every blank: ``a b`` -> ``a``, `` b``. Other texts are cut into the
pattern's own matches. Units repeat as often as words do, so each distinct one is encoded once.
"""

from __future__ import annotations

import re

import numpy as np
import regex
import zstandard

#: white space directly before a blank, for every white-space character
ODD = [chr(c) + " " for c in range(0x3001) if re.match(r"\s", chr(c))]
ODD_ASCII = [x for x in ODD if x.isascii()]
#: the same for Arrow's expressions
ODD_CLASS = "[" + "".join(f"\\x{{{ord(x[0]):x}}}" for x in ODD) + "] "


class UnitIndex:
    """Numbers the distinct units of a block of texts."""

    def __init__(self, pattern: str, whole=None):
        """``whole``: tells the texts to be kept as one unit; those with odd white space are then, too."""
        self.match, self.whole = regex.compile(pattern).findall, whole
        self.units: list[str] = []
        units = self.units

        class Plain(dict):
            def __missing__(self, unit):
                n = self[unit] = len(units)
                units.append(unit)
                return n

        class Spaced(dict):  # keyed without the leading blank
            def __missing__(inner, part):
                n = inner[part] = plain[" " + part]
                return n

        plain = self.plain = Plain()
        self.spaced = Spaced()

    def numbers(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.whole and self.whole(text) or any(x in text for x in (ODD_ASCII if text.isascii() else ODD)):
            parts = [text] if self.whole else self.match(text)
            return np.fromiter(map(self.plain.__getitem__, parts), np.uint32, len(parts))
        head, *rest = text.split(" ")
        out = np.empty(len(rest) + 1, np.uint32)
        if head:  # before the others: units are numbered by first appearance
            out[0] = self.plain[head]
        out[1:] = np.fromiter(map(self.spaced.__getitem__, rest), np.uint32, len(rest))
        return out if head else out[1:]


def gather(counts: np.ndarray, flat: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate variable-length lists ``flat`` (lengths ``counts``) in the order of ``seq``; also the lengths."""
    starts = np.cumsum(counts) - counts
    n = counts[seq]
    ends = np.cumsum(n)
    index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[seq] - (ends - n), n)
    return flat[index], n


def planes(a: np.ndarray) -> bytes:
    """Compressed uint32 array, one byte plane after the other."""
    return zstandard.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unplanes(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view("<u4")


def code_numbers(a: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent: their bit lengths, compressed, and the bits below the first, packed."""
    a = a.astype(np.int64) + 1
    size = np.frexp(a.astype(np.float64))[1].astype(np.uint8)
    parts = [zstandard.compress(size.tobytes(), 9)]
    for k in range(2, 34):
        x = a[size == k]
        if len(x):
            bits = (x[:, None] >> np.arange(k - 1)) & 1
            parts.append(np.packbits(bits.astype(np.uint8).reshape(-1)).tobytes())
    return np.uint32(len(parts[0])).tobytes() + b"".join(parts)


def decode_numbers(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, "<u4", 1)[0])
    size = np.frombuffer(zstandard.decompress(b[4:4 + n]), np.uint8)
    out, at = np.ones(len(size), np.int64), 4 + n
    for k in range(2, 34):
        where = np.flatnonzero(size == k)
        if len(where):
            m = len(where) * (k - 1)
            bits = np.unpackbits(np.frombuffer(b, np.uint8, -(-m // 8), at), count=m).reshape(-1, k - 1).astype(np.int64)
            out[where] = (bits << np.arange(k - 1)).sum(axis=1) + (1 << (k - 1))
            at += -(-m // 8)
    return out - 1


def by_frequency(size: np.ndarray) -> np.ndarray:
    """Units that repeat, in order of the bit length of their frequency, then of first appearance."""
    order = np.argsort(-size.astype(np.int64), kind="stable")
    return order[size[order] > 1]


def code_sequence(seq: np.ndarray, count: int) -> tuple[bytes, bytes]:
    """A sequence over 0..count-1 numbered by first appearance. A first appearance is coded 0, others by the place of
    their unit by frequency; the bit lengths of the frequencies go with it."""
    times = np.bincount(seq, minlength=count)
    size = np.frexp(times.astype(np.float64))[1].astype(np.uint8)
    rank = np.zeros(count, np.int64)
    repeated = by_frequency(size)
    rank[repeated] = np.arange(len(repeated))
    first = np.zeros(len(seq), bool)
    first[np.unique(seq, return_index=True)[1]] = True
    return code_numbers(np.where(first, 0, rank[seq] + 1)), zstandard.compress(size.tobytes(), 9)


def read_sequence(code: bytes, sizes: bytes) -> np.ndarray:
    repeated = by_frequency(np.frombuffer(zstandard.decompress(sizes), np.uint8))
    x = decode_numbers(code)
    out = np.empty(len(x), np.int64)
    first = x == 0
    out[first] = np.arange(int(first.sum()))
    out[~first] = repeated[x[~first] - 1]
    return out


def pack(items: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, items), "<u4", len(items))
    return zstandard.compress(np.uint32(len(items)).tobytes() + lens.tobytes() + b"".join(items), 9)


def unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n
    start, out = 4 + 4 * n, []
    for end in ends.tolist():
        out.append(raw[start:end])
        start = end
    return out
