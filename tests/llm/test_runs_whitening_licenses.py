"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from pagelens.llm import license_scan, periodic_runs, queries, whitening

EXTRA = "h long, w string, a long, runs string, blocks string, row string, rank int, dim int, x string"
EXTRA_ROW = (1, "w", 2, "r", "b", "q", 3, 4, "x")


# --- 11 ------------------------------------------------------------------------

def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - a >= max(6, 4 * q):
                out.setdefault((a, i + q - a), q)
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda x: (x[0], x[2]))


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def texts_with_runs(rng):
    out = []
    for _ in range(150):
        w = [f"{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            root = [f"{rng.randrange(rng.choice([1, 2, 4, 1000]))}" for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 16, 31, 33, 64, 70]))]
            part = (root * 8)[:rng.randrange(len(root) * 8 + 1)]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        out.append(w)
    # repetitions of repetitions: short periods inside long ones, and broken in the middle
    root = ["a"] * 40 + ["b"]
    out += [root * 5, (["a", "b"] * 30 + ["c"]) * 4 + ["a", "b"] * 30, root * 4 + ["x"] + root * 4, ["z"] * 700, (root * 4 + ["y"]) * 4]
    return out


def test_runs_of_words():
    rng = random.Random(3)
    for w in [*texts_with_runs(rng), fibonacci(900)]:
        text = b" ".join(x if isinstance(x, bytes) else x.encode() for x in w)
        words, runs = periodic_runs.slice_runs([text])
        assert [(a, b - a, p) for a, b, p in runs[0]] == brute_runs(text.split()), w
    # a slice of many documents gives the same
    many = [" ".join(w).encode() for w in texts_with_runs(rng)]
    for t, r in zip(many, periodic_runs.slice_runs(many)[1]):
        assert [(a, b - a, p) for a, b, p in r] == brute_runs(t.split())


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i if i < a else a + (i - a) % p] for i in range(n)]


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, (" " if i % 2 else "\n\t").join(w)) for i, w in enumerate(texts_with_runs(rng))]
    rows += [(900, None), (901, ""), (902, " \x0b "), (3, "é é é é é é"), (3, "é é é é é é"), (None, "a b a b a b a b"), (903, " ".join(str(rng.randrange(9)) for _ in range(20000)) + " q" * 9000)]
    spark.createDataFrame([(*r, *EXTRA_ROW) for r in rows], f"doc_id long, text string, {EXTRA}").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        w = planted(d, [x.decode() for x in (t or "").encode().split()])
        if d == 903:
            runs = [(a, b - a, p) for a, b, p in periodic_runs.slice_runs([" ".join(w).encode()])[1][0]]
            assert (20000 + 9000 - runs[-1][1], runs[-1][2]) in {(20000, 1), (19999, 1)} or zlib.crc32(b"903") % 10 == 0
        else:
            runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        dead = {i for a, n, q in runs for i in range(a + q, a + n)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)),
                     sha(" ".join(x for i, x in enumerate(w) if i not in dead))))
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- 12 ------------------------------------------------------------------------

def whitened(vectors, k=16):
    """Plain numpy, with whole numbers where the contract has them."""
    use = [v for v in vectors if v is not None and None not in v and all(math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for v in use], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s).astype(float) / n
    value, vec = np.linalg.eigh(centred.T @ centred / n)
    value, vec = value[::-1][:k], vec[:, ::-1][:, :k]
    return x, n, [int(((n * r - s) ** 2).sum()) for r in x], ((n * x - s).astype(float) / n) @ vec / np.sqrt(value), value, value / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("dim,rows,spread", [(24, 300, 1.0), (5, 60, 30.0), (64, 2000, 0.2), (1, 20, 3.0)])
def test_whitening(spark, dim, rows, spread):
    rng = np.random.default_rng(dim)
    a = (rng.standard_normal((rows, dim)) * np.linspace(1, 3, dim) * spread) @ np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    vectors = [[float(c) for c in r] for r in a] + [[float(c) for c in a[0]]] * 3
    bad = [None, [None] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), []]
    table = [(i, v, *EXTRA_ROW) for i, v in enumerate(vectors + bad)] + [(None, vectors[1], *EXTRA_ROW), (0, vectors[0], *EXTRA_ROW)]
    out = whitening.whiten(spark.createDataFrame(table, f"vec_id long, embedding array<double>, {EXTRA}").repartition(5)).collect()
    x, n, deviation, w, value, explained = whitened(vectors)
    k = min(dim, 16)
    assert len(out) == (len(vectors) + 2) * k
    sign = {}
    for r in out:
        i = r["vec_id"] if r["vec_id"] is not None else 1
        j = r["component"] - 1
        sign.setdefault(j, np.sign(r["whitened"] * w[i, j]) or 1)
        assert abs(r["whitened"] * sign[j] - w[i, j]) < 1e-8
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert abs(r["explained"] - explained[j]) < 1e-12
        assert r["identity_error"] < 1e-9


def test_whitening_degenerate(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, None), (2, [])])).collect() == []
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no variance
    # one direction only; a vector of another length is left out
    out = whitening.whiten(frame([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [2.0, 5.0]), (4, [1.0])])).collect()
    assert [(r["vec_id"], r["component"], round(abs(r["whitened"]), 6), r["deviation"]) for r in sorted(out)] == \
        [(1, 1, 1.224745, 36864), (2, 1, 0.0, 0), (3, 1, 1.224745, 36864)]
    # entries far beyond what longs square: no crash, deviation does not fit
    big = whitening.whiten(frame([(1, [1e17, 0.0]), (2, [-1e17, 1.0]), (3, [3e16, 2.0])])).collect()
    assert {r["deviation"] for r in big} == {None} and big[0]["identity_error"] < 1e-4


def test_feast_finds_close_and_equal_eigenvalues():
    rng = np.random.default_rng(9)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    value = np.sort(np.concatenate([[5.0, 5.0, 5.0, 4.9999999, 3.0, 3.0 - 1e-9], rng.random(34)]))[::-1]
    v = (turn * value) @ turn.T
    v = (v + v.T) / 2
    cut = whitening.intervals(v, 16, 1e-9)
    assert sum(c for _, _, c in cut) >= 16
    found = [whitening.feast(v, *c) for c in cut]
    got = np.concatenate([f[0] for f in found])
    assert np.abs(got - value[:len(got)]).max() < 1e-12
    for val, vec in found:
        assert np.abs(v @ vec - vec * val).max() < 1e-6 and np.abs(vec.T @ vec - np.eye(len(val))).max() < 1e-12


# --- 13 ------------------------------------------------------------------------

def brute_scan(text, templates, phrases, threshold):
    w = license_scan.words_of((text or "").encode())
    places = [(i, label) for p, label in phrases for k in [p.encode().split()] for i in range(len(w) - len(k) + 1) if w[i:i + len(k)] == k]
    found = set()
    for label, t in templates:
        words = license_scan.words_of((t or "").encode())
        if label is None or not words:
            continue
        s = max(8, 2 ** math.ceil(math.log2(len(words))))
        size, need = len(set(words)), math.ceil(round(threshold * len(set(words)), 9))
        for start in range(0, max(len(w), 1), s):
            common = len(set(w[start:start + 2 * s]) & set(words))
            if common >= need:
                found.add((start, label, 2 * s, common / size))
    base = sorted({x for _, x in places})
    return (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(base),
            ",".join(sorted({*base, *(x[1] for x in found)})), max([x[3] for x in found] + [1.0 if places else 0.0]), sorted(found))


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_license_scan(spark, threshold):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(60)] + ["the", "license", "under", "mit", "é"]
    templates = license_scan.TEMPLATES + [("long", " ".join(rng.sample(vocabulary, 40) * 3)), ("one", "v1"), (None, "v2 v3"), ("none", None), ("empty", "--"), ("tie", "v1 v1 v1"), ("é,x", "Released é under")]
    rows = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 9, 40, 500]))]
        for _ in range(rng.randrange(3)):
            t = (rng.choice(templates)[1] or "x").split()
            if rng.random() < 0.5 and t:
                t[rng.randrange(len(t))] = "other"
            at = rng.randrange(len(w) + 1)
            w[at:at] = t
        rows.append((i, "-".join(w) if i % 3 else "\n".join(w).upper()))
    rows += [(500, None), (501, ""), (502, "--"), (3, "cc by nc cc BY-nc under the MIT license"), (3, "cc by nc cc BY-nc under the MIT license"), (None, "apache License, version 2.0"),
             (503, " ".join(rng.choice(vocabulary) for _ in range(30000)) + " released under the MIT license")]
    want = sorted([(d, *brute_scan(t, templates, license_scan.PHRASES, threshold)) for d, t in rows], key=str)
    docs = spark.createDataFrame([(*r, *EXTRA_ROW) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(6)
    out = license_scan.license_scan(docs, spark.createDataFrame(templates, "label string, text string"), threshold=threshold).collect()
    # of equal templates with one label a block is listed once per template
    got = sorted([(*tuple(r)[:8], sorted({(f["start"], f["label"], f["length"], f["share"]) for f in r["found"] or []})) for r in out], key=str)
    assert got == want
    assert sum(bool(x[8]) for x in want) > 30


def test_license_scan_empty_tables(spark):
    none, templates = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "label string, text string")
    assert license_scan.license_scan(none, templates).collect() == []
    out = license_scan.license_scan(spark.createDataFrame([(1, "under the mit license")], none.schema), templates).collect()
    assert [(r["labels"], r["score"], r["found"]) for r in out] == [("mit", 1.0, None)]
