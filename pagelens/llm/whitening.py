"""Operator 12: whitening of embeddings by FEAST contour integration.

Every usable vector becomes whole numbers x = floor(step * c) + shift, packed as bytes in the smallest width that holds
them. Distinct x vectors are the fit list. Two passes over it give its count and sums and then, centred at the nearest
whole number to the mean, the products of all pairs of dimensions; they are whole numbers, so the covariance V does not
hang on the order of rows or tasks, and the rest of the centring is made exactly on the dim x dim table.

The wanted end of the spectrum is cut into intervals with few eigenvalues each, at gaps that inertia counts find: the
number of negative pivots of V - s (of its tridiagonal form, where the pivots are safe) is the number of eigenvalues
below s. Each interval is a Spark task: a random block is filtered by Gauss-Legendre quadrature of the resolvent along
a circle through the interval's ends (one complex shifted solve per node), Rayleigh-Ritz extracts eigenpairs from the
filtered block, and both are repeated until the residuals are at rounding level. The inertia counts of the interval's
ends say how many eigenpairs must have come; one too few is an error, not a shorter result.

What a task or the driver holds grows with the square of the dimension, never with the rows.

Rows whose vector is null or holds null or non-finite entries are left out, and so are rows whose vector has another length than
most rows (equally frequent lengths: the longest); empty vectors are left out. Repeated rows, null and repeated vec_ids keep their rows. Columns
other than vec_id and embedding are not read. Directions without variance (eigenvalue below 1e-12 of the largest) have no row,
so a table with one distinct vector, like an empty one, gives no rows. ``deviation`` is null where it does not fit a long. Entries whose
x is beyond 2**62 in size saturate there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

NODES, MOST_ROUNDS, PER_INTERVAL, SEED = 8, 40, 8, 12
LARGEST = 2**62


# --- whole numbers -----------------------------------------------------------

def to_whole(flat: np.ndarray, step: int, shift: int) -> np.ndarray:
    x = np.floor(step * flat)
    big = np.abs(x) > LARGEST
    return np.where(big, np.sign(x) * LARGEST, x).astype(np.int64) + np.int64(shift)


def pack(x: np.ndarray, shift: int) -> list[bytes]:
    """Rows as bytes: width of one entry, then x - shift in it. Equal rows have equal bytes."""
    y = x - shift
    size = np.abs(y).max(axis=1, initial=0)
    out = np.empty(len(y), object)
    for width, low, high in ((1, 0, 2**7), (2, 2**7, 2**15), (4, 2**15, 2**31), (8, 2**31, 2**63 - 1)):
        at = np.flatnonzero((size >= low) & (size < high))
        if len(at):
            raw = np.ascontiguousarray(y[at].astype(f"<i{width}")).view(np.uint8).reshape(len(at), -1)
            raw = np.concatenate([np.full((len(at), 1), width, np.uint8), raw], axis=1)
            out[at] = [r.tobytes() for r in raw]
    return out.tolist()


def unpack(col: pa.Array, shift: int) -> np.ndarray:
    blobs = col.to_pylist()
    width = np.array([b[0] for b in blobs])
    out = np.empty((len(blobs), (len(blobs[0]) - 1) // blobs[0][0]), np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join([blobs[i][1:] for i in at]), f"<i{w}").reshape(len(at), -1)
    return out + shift


def _pack(step: int, shift: int):
    def run(batches):
        for batch in batches:
            col = batch.column("embedding")
            sizes = np.diff(C.offsets_of(col))
            flat, first = col.values, int(C.offsets_of(col)[0]) if len(col) else 0
            values = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(np.float64), nan=np.nan, posinf=np.nan, neginf=np.nan)
            ok = np.asarray(col.is_valid()) & (sizes > 0)
            bad = np.concatenate([[0], np.cumsum(np.isnan(values[first:first + int(sizes.sum())]))])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ok &= bad[ends[1:]] == bad[ends[:-1]]
            packed = np.full(len(col), None, object)
            for dim in np.unique(sizes[ok]).tolist():
                at = np.flatnonzero(ok & (sizes == dim))
                rows = values[first + ends[at][:, None] + np.arange(dim)]
                packed[at] = pack(to_whole(rows, step, shift), shift)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.where(ok, sizes, 0).astype(np.int32)), pa.array(packed.tolist(), pa.binary())],
                                             ["vec_id", "dim", "x"])
    return run


# --- statistics of the fit list ------------------------------------------------

def _sums(shift: int):
    """Per task: (entry, total) with entry -1 for the count, 0.. for the sums of x - shift, and largest size of x - shift under -2."""
    def run(batches):
        n, total, most = 0, None, 0
        for batch in batches:
            if batch.num_rows:
                y = unpack(batch.column("x"), shift) - shift
                n, most = n + len(y), max(most, int(np.abs(y).max()))
                part = np.array([int(v) for v in y.sum(axis=0)], object) if len(y) * int(np.abs(y).max()) < LARGEST else y.astype(object).sum(axis=0)
                total = part if total is None else total + part
        if n:
            keys = [-2, -1, *range(len(total))]
            yield pa.RecordBatch.from_pydict({"entry": pa.array(keys, pa.int32()), "total": pa.array([str(v) for v in [most, n, *total]])})
    return run


def _products(shift: int, centre: list[int], whole: bool):
    """Per task: row i of the sum of z z' with z = x - centre, as whole numbers where they fit a long."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                z = unpack(batch.column("x"), shift) - np.array(centre, np.int64)
                f = z.astype(np.float64)
                if whole and len(z) * float(np.abs(f).max()) ** 2 < 2**53:
                    part = (f.T @ f).astype(np.int64)  # exact: every partial sum is below 2**53
                else:
                    part = z.T @ z if whole else f.T @ f
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"entry": pa.array(range(len(total)), pa.int32()), "row": pa.array(total.tolist(), pa.list_(pa.int64() if whole else pa.float64()))})
    return run


def covariance(fit: DataFrame, shift: int) -> tuple[int, list[int], np.ndarray] | None:
    """(n, sums of x, covariance) of the fit list (column x, packed); None when it is empty."""
    found = fit.mapInArrow(_sums(shift), "entry int, total string")
    total = F.max(F.col("total").cast("decimal(38,0)")).alias("most"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    stats = {r["entry"]: r for r in found.groupBy("entry").agg(*total).collect()}  # dim + 2 rows
    if not stats:
        return None
    n, dim = int(stats[-1]["total"]), max(stats) + 1
    y = [int(stats[j]["total"]) for j in range(dim)]
    nearest = [(2 * v + n) // (2 * n) for v in y]
    size = int(stats[-2]["most"]) + max(map(abs, nearest))
    whole = n * size * size < LARGEST
    rows = fit.mapInArrow(_products(shift, [c + shift for c in nearest], whole), f"entry int, row array<{'long' if whole else 'double'}>")
    sums = (rows.select("entry", F.posexplode("row").alias("j", "v")).groupBy("entry", "j").agg(F.sum("v").alias("v"))
            .groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row")))  # dim x dim cells
    table = {r["entry"]: [c["v"] for c in r["row"]] for r in sums.collect()}
    rest = [v - c * n for v, c in zip(y, nearest)]  # sums of z
    v = np.array([[(n * table[i][j] - rest[i] * rest[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    return n, [s + shift * n for s in y], (v + v.T) / 2


# --- spectrum ------------------------------------------------------------------

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix."""
    a, d = v.copy(), len(v)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = x @ x
        if size == 0:
            continue
        p = 2 * (a[k + 1:, k + 1:] @ x) / size
        p -= (p @ x) / size * x
        a[k + 1:, k + 1:] -= np.outer(x, p) + np.outer(p, x)
        a[k, k + 1:] -= 2 * (a[k, k + 1:] @ x) / size * x
        a[k + 1:, k] = a[k, k + 1:]
    return np.diag(a).copy(), np.diag(a, 1).copy()


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inertia: number of eigenvalues below every value of ``at``, the negative pivots of the shifted matrix."""
    least = np.finfo(float).tiny ** 0.5 + np.finfo(float).eps ** 2 * max(np.abs(off).max(initial=0), np.abs(diagonal).max())  # a zero pivot counts as negative
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(int)
    for a, b in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = a - at - b * b / pivot
        count += pivot < 0
    return count


def intervals(v: np.ndarray, wanted: int, least: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top of the spectrum down to ``wanted`` eigenvalues or ``least``, cut in the widest gaps."""
    diagonal, off = tridiagonal(v)
    d = len(v)
    radius = np.abs(diagonal) + np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    top = float(radius.max()) * 1.01
    inside = d - int(below(diagonal, off, np.array([least]))[0])
    wanted = min(wanted, inside)
    if not wanted:
        return []
    # bisection of all eigenvalues that may be cut at, to a part in 2**40 of the spectrum
    rank = np.arange(d - min(inside, wanted + PER_INTERVAL), d)
    low, high = np.full(len(rank), least), np.full(len(rank), top)
    for _ in range(40):
        middle = (low + high) / 2
        less = below(diagonal, off, middle) <= rank
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    value = ((low + high) / 2)[::-1]  # falling
    cuts, at = [top], 0
    while at < wanted:
        after = [k for k in range(at + PER_INTERVAL // 2, min(at + PER_INTERVAL, len(value) - 1) + 1) if k < len(value)]
        gap = [value[k - 1] - value[k] for k in after]
        if len(value) - at <= PER_INTERVAL and len(value) == inside:
            k, cut = len(value), max(least, value[-1] / 2)
        elif not after:
            k, cut = len(value), least
        else:
            k = after[int(np.argmax(gap))]
            cut = (value[k - 1] + value[k]) / 2
        cuts.append(float(cut))
        at = k
    counts = d - below(diagonal, off, np.array(cuts))
    return [(cuts[i + 1], cuts[i], int(counts[i + 1] - counts[i])) for i in range(len(cuts) - 1) if counts[i + 1] > counts[i]]


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the ``count`` eigenvalues in [low, high]."""
    d = len(v)
    size = min(d, count + max(4, count // 2))
    q = np.random.default_rng([SEED, d, count]).standard_normal((d, size))
    x, w = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (x + 1)  # the upper half circle; the lower one is its conjugate
    centre, radius = (low + high) / 2, (high - low) / 2
    shifts = centre + radius * np.exp(1j * angle)
    inverse = [np.linalg.inv(z * np.eye(d) - v) for z in shifts] if size * 4 >= d else None
    scale = np.abs(v).max()
    best = None
    for _ in range(MOST_ROUNDS):
        filtered = np.zeros((d, size))
        for i, z in enumerate(shifts):
            y = inverse[i] @ q if inverse else np.linalg.solve(z * np.eye(d) - v, q.astype(complex))
            filtered += (w[i] / 2 * radius * np.exp(1j * angle[i]) * y).real
        basis, _ = np.linalg.qr(filtered)
        value, turn = np.linalg.eigh(basis.T @ v @ basis)
        q = basis @ turn
        residual = np.linalg.norm(v @ q - q * value, axis=0)
        mine = np.flatnonzero((value >= low) & (value <= high) & (residual <= 1e-3 * scale))
        if len(mine) == count:
            worst = residual[mine].max()
            if best is not None and worst >= best[0] / 2 and worst <= 1e-10 * scale:
                break  # rounding level: another round does not halve it
            if best is None or worst < best[0]:
                best = (worst, value[mine], q[:, mine])
    if best is None or best[0] > 1e-8 * scale:
        raise ArithmeticError(f"{count} eigenvalues lie in [{low}, {high}], the filtered space holds fewer")
    _, value, q = best
    order = np.argsort(-value, kind="stable")
    q, _ = np.linalg.qr(q[:, order])  # orthonormal to rounding also across close eigenvalues
    return value[order], q


def components(spark, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` leading eigenvalues and eigenvectors (columns); every interval is a task."""
    top = float(np.abs(v).max()) * len(v)
    parts = intervals(v, wanted, 1e-12 * top) if top > 0 else []
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))

    def solve(batches):
        for batch in batches:
            for low, high, count in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "n"))):
                value, vectors = feast(v, low, high, count)
                yield pa.RecordBatch.from_pydict({"value": pa.array(value), "vector": pa.array(vectors.T.tolist(), pa.list_(pa.float64()))})

    jobs = spark.createDataFrame(parts, "low double, high double, n long").repartition(len(parts))
    found = sorted(((r["value"], r["vector"]) for r in jobs.mapInArrow(solve, "value double, vector array<double>").collect()), key=lambda x: -x[0])
    if len(found) != sum(p[2] for p in parts):
        raise ArithmeticError("the inertia counts differ from the eigenvalues found")
    found = found[:wanted]
    vectors = np.array([x[1] for x in found]).T
    # largest entry positive: the sign is free, and the same for all rows
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.array([x[0] for x in found]), vectors * sign


# --- projection ----------------------------------------------------------------

def project(x: np.ndarray, n: int, sums: list[int], shift: int, axes: np.ndarray) -> np.ndarray:
    """(x - S / n) on the axes; the whole part of the mean is taken off before anything is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - n * (s // n)) / n for s in sums])
    return ((x - whole).astype(np.float64) - rest) @ axes


def _moments(n: int, sums: list[int], shift: int, axes: np.ndarray):
    def run(batches):
        first, second = 0, 0
        for batch in batches:
            if batch.num_rows:
                w = project(unpack(batch.column("x"), shift), n, sums, shift, axes)
                first, second = first + w.sum(axis=0), second + w.T @ w
        if not np.isscalar(first):
            yield pa.RecordBatch.from_pydict({"first": pa.array([first.tolist()], pa.list_(pa.float64())), "second": pa.array([second.reshape(-1).tolist()], pa.list_(pa.float64()))})
    return run


def identity_error(fit: DataFrame, n: int, sums: list[int], shift: int, axes: np.ndarray) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity)."""
    k = axes.shape[1]
    rows = fit.mapInArrow(_moments(n, sums, shift, axes), "first array<double>, second array<double>")
    cells = rows.select(F.posexplode(F.concat("first", "second")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # k + k * k rows
    flat = np.zeros(k + k * k)
    for r in cells:
        flat[r["i"]] = r["v"]
    mean = flat[:k] / n
    return float(np.abs(flat[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def _whiten(n: int, sums: list[int], shift: int, axes: np.ndarray, explained: list[float], error: float):
    k = axes.shape[1]

    def deviations(x: np.ndarray) -> list[int | None]:
        centred = float(np.abs(n * (x - shift).astype(np.float64) - np.array([float(s - n * shift) for s in sums])).max(initial=0))
        if x.shape[1] * (centred + 1) ** 2 < LARGEST and n * float(np.abs(x).max(initial=0)) < LARGEST:
            y = n * (x - shift) - np.array([s - n * shift for s in sums], np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpack(batch.column("x"), shift)
            w = project(x, n, sums, shift, axes)
            take = pa.array(np.repeat(np.arange(len(x)), k))
            rows = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(rows, n, np.int64)),
                 pa.array(deviations(x), pa.int64()).take(take), pa.array(w.reshape(-1)), pa.array(np.tile(explained, len(x))), pa.array(np.full(rows, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, wanted: int = 16, step: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Rows (vec_id, component 1..wanted, n, deviation, whitened, explained, identity_error) of every usable row of ``vectors``
    (vec_id, embedding as an array of numbers); the rules for all other rows are at the top of this module."""
    spark = vectors.sparkSession
    C.ship(spark)
    source = vectors.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kind = source.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    packed = C.stage(source.mapInArrow(_pack(step, shift), f"vec_id {kind}, dim int, x binary").where("x is not null"), "packed")
    dims = packed.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if dims is None:
        return spark.createDataFrame([], out)
    packed = packed.where(F.col("dim") == dims["dim"])
    fit = C.stage(packed.select("x").distinct(), "fit")
    n, sums, v = covariance(fit, shift)
    value, axes = components(spark, v, wanted)
    if not len(value):
        return spark.createDataFrame([], out)
    axes = axes / np.sqrt(value)
    error = identity_error(fit, n, sums, shift, axes)
    explained = (value / np.trace(v)).tolist()
    return packed.select("vec_id", "x").mapInArrow(_whiten(n, sums, shift, axes, explained, error), out)
