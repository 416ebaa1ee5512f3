"""Embedding whitening by a bit-sliced scatter matrix.

Vectors become whole numbers x = floor(scale * c).  The fit list is each distinct x-vector once.
Every dimension is shifted by its smallest value, so that its entries are non-negative,
and cut into bit planes; the planes of a block of rows are packed into 64-bit words.  With
plane p of dimension i and plane q of dimension j,

    sum of y_i * y_j = sum over p, q of 2**(p+q) * popcount(plane_ip AND plane_jq),

so cross-products are exact whole numbers, whatever the number of rows.  Tasks add up popcounts; what
reaches the driver are d(d+1)/2 sums.  They are centred as whole numbers, n * sum(y_i y_j) - s_i s_j, before they become
floating-point numbers for ``eigh``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import keep

BLOCK_ROWS = 8192
LIMB_BITS = 24              # sums travel as limbs of this base, so that a long never overflows
RANK_TOLERANCE = 1e-14      # of the largest eigenvalue: a component below it is rounding, not data
WIDTHS = ((8, "<i1"), (16, "<i2"), (32, "<i4"), (64, "<i8"))


def to_whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * c) as 64-bit whole numbers; beyond their range the nearest of them."""
    x = np.floor(np.asarray(values, np.float64) * scale)
    top = np.float64(2 ** 63)
    low = np.where(x < -top, np.iinfo(np.int64).min, np.where(x >= top, 0, x).clip(-top, None)).astype(np.int64)
    return np.where(x >= top, np.iinfo(np.int64).max, low)


def pack_vector(x: np.ndarray) -> bytes:
    """A width byte and the numbers in the narrowest width that holds them: equal vectors, equal bytes."""
    lo, hi = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    for k, (bits, kind) in enumerate(WIDTHS):
        if -(1 << bits - 1) <= lo and hi < 1 << bits - 1:
            return bytes([k]) + x.astype(kind).tobytes()
    raise AssertionError


def unpack_vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, WIDTHS[data[0]][1], offset=1).astype(np.int64)


def usable_vectors(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places, vectors as doubles) of the rows of an Arrow list column that have no null and no non-finite entry."""
    places, out = [], []
    offsets, values = column.offsets.to_numpy(), column.values
    known = np.asarray(values.is_valid())
    flat = np.asarray(values.cast(pa.float64()).fill_null(0.0))
    fine = known & np.isfinite(flat)
    for i, ok in enumerate(np.asarray(column.is_valid())):
        a, b = offsets[i], offsets[i + 1]
        if ok and fine[a:b].all():
            places.append(i)
            out.append(flat[a:b])
    return np.array(places, np.int64), out


def bit_planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """Rows x dimensions of non-negative numbers -> one row of 64-bit words per plane, dimension by dimension, lowest bit first."""
    rows = len(y)
    words = -(-rows // 64)
    out = np.zeros((sum(bits), words * 8), np.uint8)
    k = 0
    for d, n in enumerate(bits):
        for p in range(n):
            packed = np.packbits((y[:, d] >> np.uint64(p)).astype(np.uint8) & 1)
            out[k, :len(packed)] = packed
            k += 1
    return out.view(np.uint64)


class Scatter:
    """Sums and cross-products of non-negative vectors, from AND-popcounts of their bit planes.

    ``cross[l, i, j]`` for i <= j, and ``sums[l, i]``, hold limbs: a sum is the values weighted by 2**(LIMB_BITS * l).
    """

    def __init__(self, bits: list[int]):
        self.bits, d = bits, len(bits)
        self.dim = np.repeat(np.arange(d), bits)
        self.shift = np.concatenate([np.arange(n) for n in bits] or [np.zeros(0, int)]).astype(np.int64)
        limbs = 1 + 2 * max(bits, default=0) // LIMB_BITS  # 2 * bits - 1 is the largest shift
        self.cross = np.zeros((limbs, d, d), np.int64)
        self.sums = np.zeros((limbs, d), np.int64)

    def _put(self, out: np.ndarray, dims: np.ndarray, shifts: np.ndarray, counts: np.ndarray) -> None:
        """Add counts * 2**shifts to ``out`` (limb, dimension); equal dimensions lie side by side."""
        limb, value = shifts // LIMB_BITS, counts << shifts % LIMB_BITS
        first = np.flatnonzero(np.diff(dims, prepend=-1))
        for k in np.unique(limb):
            out[k, dims[first]] += np.add.reduceat(np.where(limb == k, value, 0), first)

    def add(self, y: np.ndarray) -> None:
        planes = bit_planes(y, self.bits)
        if not len(planes):
            return
        self._put(self.sums, self.dim, self.shift, np.bitwise_count(planes).sum(axis=1, dtype=np.int64))
        for a, i in enumerate(self.dim):
            counts = np.bitwise_count(planes[a] & planes[a:]).sum(axis=1, dtype=np.int64)
            # Two different planes of one dimension meet twice in its square, but once in this loop.
            twice = self.dim[a:] == i
            twice[0] = False
            self._put(self.cross[:, i], self.dim[a:], self.shift[a] + self.shift[a:] + twice, counts)

    def rows(self) -> tuple[np.ndarray, ...]:
        """(i, j, limb, value) of everything that is not zero; j = -1 for the plain sums."""
        k, i, j = np.nonzero(self.cross)
        sk, si = np.nonzero(self.sums)
        return (np.concatenate([i, si]), np.concatenate([j, np.full(len(si), -1)]), np.concatenate([k, sk]),
                np.concatenate([self.cross[k, i, j], self.sums[sk, si]]))


@dataclass
class Whitening:
    """n fitted x-vectors, their sums, unit eigenvectors (rows) by falling eigenvalue, and the covariance's trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    scale: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of the rows of x: (x - S/n) on each component over sqrt(e)."""
        # n * x - S is a whole number; dividing it is the only rounding.
        if max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * self.n + max(map(abs, self.sums), default=0) < 1 << 62:
            centred = (x * self.n - np.array(self.sums, np.int64)) / self.n
        else:
            centred = np.array([[(int(v) * self.n - s) / self.n for v, s in zip(row, self.sums)] for row in x], np.float64).reshape(x.shape)
        return centred @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)**2, exact; null where it is no 64-bit number."""
        reach = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * self.n + max(map(abs, self.sums), default=0)
        if reach * reach * max(1, x.shape[1]) < 1 << 62:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        out = [sum((int(v) * self.n - s) ** 2 for v, s in zip(row, self.sums)) for row in x]
        return [v if v < 1 << 63 else None for v in out]


def eigen(a: np.ndarray, held: int, sweeps: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as rows) of a symmetric matrix by falling value, the first ``held`` of them refined.

    ``eigh`` in double precision, then Jacobi rotations in extended precision of the held vectors against all others,
    so that values far below the largest keep their digits.  Each vector's entry of largest size is positive.
    """
    d = len(a)
    wide = np.longdouble
    v = np.linalg.eigh(np.asarray(a, np.float64))[1][:, ::-1].astype(wide)
    for _ in range(2):  # Newton steps to columns that are orthogonal in extended precision
        v = v @ (3 * np.eye(d, dtype=wide) - v.T @ v) / 2
    m = v.T @ np.asarray(a, wide) @ v
    for _ in range(sweeps):
        turned = False
        for i in range(min(held, d)):
            for j in range(i + 1, d):
                if abs(m[i, j]) <= np.finfo(wide).eps * np.sqrt(abs(m[i, i] * m[j, j])):
                    continue
                turned = True
                t = (m[j, j] - m[i, i]) / (2 * m[i, j])
                t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(t * t + 1))
                c = 1 / np.sqrt(t * t + 1)
                turn = np.array([[c, t * c], [-t * c, c]], wide)
                m[:, [i, j]] = m[:, [i, j]] @ turn
                m[[i, j]] = turn.T @ m[[i, j]]
                v[:, [i, j]] = v[:, [i, j]] @ turn
        if not turned:
            break
    order = np.argsort(-np.diag(m), kind="stable")
    values, vectors = np.diag(m)[order], v.T[order]
    signs = np.sign(vectors[np.arange(d), np.abs(vectors).argmax(axis=1)]) if d else np.ones(0)
    return values.astype(np.float64), (vectors * signs[:, None]).astype(np.float64)


def _block(rows: list[bytes], d: int) -> np.ndarray:
    x = np.zeros((len(rows), d), np.int64)
    for i, data in enumerate(rows):
        v = unpack_vector(data)
        x[i, :len(v)] = v
    return x


def fit_list(rows: DataFrame, vector_col: str, scale: float) -> DataFrame:
    """Each distinct x-vector of the usable rows once, as packed bytes ``x``, saved in the shared folder."""

    def pack(batches):
        for batch in batches:
            seen = dict.fromkeys(pack_vector(to_whole(v, scale)) for v in usable_vectors(batch.column(0))[1])
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(seen), pa.binary())})

    vectors = rows.select(rows[f"`{vector_col}`"].cast("array<double>").alias("v"))
    return keep(vectors.mapInArrow(pack, "x binary").distinct(), "whitening-fit")


def fit(fitted: DataFrame, components: int, scale: float) -> Whitening:
    """Whitening of a fit list (:func:`fit_list`)."""

    def ranges(batches):
        full, n = None, 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                v = unpack_vector(data)
                n += 1
                if full is None or len(v) > len(full[0]):
                    grown = np.zeros((2, len(v)), np.int64)
                    if full is not None:
                        grown[:, :len(full[0])] = full
                    elif n == 1:
                        grown[:] = v
                    full = grown
                w = v if len(v) == len(full[0]) else np.concatenate([v, np.zeros(len(full[0]) - len(v), np.int64)])
                np.minimum(full[0], w, out=full[0])
                np.maximum(full[1], w, out=full[1])
        if n:
            lo, hi = full.tolist()
            yield pa.RecordBatch.from_pydict({"dim": list(range(-1, len(lo))), "lo": [n, *lo], "hi": [len(lo), *hi]},
                                             schema=pa.schema([("dim", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())]))

    # One row per dimension; dimension -1 holds the number of vectors.  A dimension that not all
    # partitions know is zero in the others.
    parts = fitted.mapInArrow(ranges, "dim int, lo long, hi long").groupBy("dim") \
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("lo").alias("n"), F.count(F.lit(1)).alias("parts")).collect()
    spans = {r.dim: r for r in parts}
    if -1 not in spans:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, scale)
    n, d, parts = spans[-1].n, spans[-1].hi, spans[-1].parts
    lo = [spans[k].lo if spans[k].parts == parts else min(0, spans[k].lo) for k in range(d)]
    hi = [spans[k].hi if spans[k].parts == parts else max(0, spans[k].hi) for k in range(d)]
    bits = [(h - a).bit_length() for a, h in zip(lo, hi)]

    def scatter(batches):
        total = Scatter(bits)
        held: list[bytes] = []

        def flush():
            # In unsigned arithmetic, where x - lo is right even if it is beyond a signed number.
            total.add(_block(held, d).view(np.uint64) - np.array(lo, np.int64).view(np.uint64))
            held.clear()

        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(data)
                if len(held) == BLOCK_ROWS:
                    flush()
        if held:
            flush()
        i, j, limb, value = total.rows()
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(limb, pa.int32()), pa.array(value)],
                                         names=["i", "j", "limb", "value"])

    # d(d+1)/2 + d sums of a few limbs each, whatever the number of rows.
    sums, cross = [0] * d, np.zeros((d, d), object)
    for i, j, limb, value in fitted.mapInArrow(scatter, "i int, j int, limb int, value long").groupBy("i", "j", "limb").agg(F.sum("value")).collect():
        if j < 0:
            sums[i] += value << LIMB_BITS * limb
        else:
            cross[i, j] += value << LIMB_BITS * limb
            if i != j:
                cross[j, i] = cross[i, j]
    centred = n * cross - np.outer(np.array(sums, object), np.array(sums, object)) if d else cross
    cov = np.array([[np.longdouble(int(v)) for v in row] for row in centred], np.longdouble).reshape(d, d) / (np.longdouble(n) * np.longdouble(n))
    values, vectors = eigen(cov, components)
    trace = sum(int(centred[k, k]) for k in range(d)) / (n * n)
    held = [k for k in range(min(components, d)) if values[k] > RANK_TOLERANCE * values[0] and values[k] > 0]
    return Whitening(n, [s + n * a for s, a in zip(sums, lo)], vectors[held].reshape(len(held), d), values[held], trace, scale)


def identity_error(fitted: DataFrame, whitening: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, measured over the list."""
    k, d = whitening.vectors.shape

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                w = whitening.project(_block(rows, d))
                first += w.sum(axis=0)
                second += w.T @ w
        at = [(i, -1, first[i]) for i in range(k)] + [(i, j, second[i, j]) for i in range(k) for j in range(k)]
        yield pa.RecordBatch.from_pydict({"i": [a[0] for a in at], "j": [a[1] for a in at], "value": [float(a[2]) for a in at]},
                                         schema=pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())]))

    if not k:
        return None
    found = {(i, j): v for i, j, v in fitted.mapInArrow(moments, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect()}
    n = whitening.n
    return max(abs(found[i, j] / n - found[i, -1] / n * (found[j, -1] / n) - (i == j)) for i in range(k) for j in range(k))


def whiten(rows: DataFrame, components: int = 4, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every usable row, one result row per row and component.

    Returns ``id_col``, component (from 1), n, deviation, whitened, explained, identity_error.  Rows whose vector is null or has a null or
    non-finite entry are left out.  A vector shorter than the longest one counts as filled up with zeros, an
    empty one as all zeros.  Repeated rows and ids each give their rows.  Components without variance (fewer distinct vectors than
    components, constant dimensions; below 1e-14 of the largest) do not exist, so fewer than ``components`` come out, none for an empty table or a single
    distinct vector.  ``deviation`` is null where it exceeds a 64-bit number.  Other columns play no part.
    """
    fitted = fit_list(rows, vector_col, scale)
    model = fit(fitted, components, scale)
    error = identity_error(fitted, model)
    k, d = model.vectors.shape
    explained = [float(v) / model.trace for v in model.values]
    schema = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def apply(batches):
        for batch in batches:
            places, vectors = usable_vectors(batch.column(1))
            if not k or not len(places):
                continue
            x = np.zeros((len(places), d), np.int64)
            for i, v in enumerate(vectors):
                x[i, :len(v)] = to_whole(v, scale)
            size = len(places) * k
            ids = batch.column(0).take(pa.array(np.repeat(places, k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(places))), pa.array(np.full(size, model.n)),
                pa.array([v for v in model.deviation(x) for _ in range(k)], pa.int64()), pa.array(model.project(x).reshape(-1)),
                pa.array(np.tile(explained, len(places))), pa.array(np.full(size, error))], schema=schema)

    read = rows.select(rows[f"`{id_col}`"].cast("long").alias("id"), rows[f"`{vector_col}`"].cast("array<double>").alias("v"))
    out = read.mapInArrow(apply, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
