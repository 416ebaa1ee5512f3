import math
from fractions import Fraction

import numpy as np
import pytest

from stratus.llm.whitening import Scatter, eigen, pack_vector, to_whole, unpack_vector, usable_vectors, whiten

SCHEMA = "vec_id long, embedding array<float>, n long, x string"


def plain(rows, components=4):
    """Rows (id, vector) -> (n, {id: deviations}, covariance as fractions, x by row), from the definition."""
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in fine), default=0)
    xs = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in fine]
    distinct = {tuple(x) for x in xs}
    full = [list(x) + [0] * (d - len(x)) for x in distinct]
    n = len(full)
    s = [sum(x[k] for x in full) for k in range(d)]
    cov = [[Fraction(n * sum(x[i] * x[j] for x in full) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    rows_x = [(i, list(x) + [0] * (d - len(x))) for (i, _), x in zip(fine, xs)]
    return n, s, cov, rows_x


def check(spark, rows, components=4, parts=3):
    out = whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(parts), components).collect()
    n, s, cov, rows_x = plain(rows)
    values, vectors = eigen(np.array([[np.longdouble(c.numerator) / np.longdouble(c.denominator) for c in r] for r in cov], np.longdouble), len(cov))
    held = [k for k in range(min(components, len(cov))) if values[k] > 1e-14 * max(values)]
    assert len(out) == len(rows_x) * len(held)
    trace = float(sum(cov[k][k] for k in range(len(cov))))
    want = {}
    for i, x in rows_x:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)])
        for c in held:
            want.setdefault((i, c + 1), []).append((dev, abs(float(vectors[c] @ centred / math.sqrt(values[c]))), values[c] / trace))
    got = {}
    for r in out:
        assert r.n == n and r.identity_error <= 1e-9
        got.setdefault((r.vec_id, r.component), []).append((r.deviation, abs(r.whitened), r.explained))
    assert got.keys() == want.keys()
    for key in want:
        for a, b in zip(sorted(got[key], key=str), sorted(want[key], key=str)):
            assert a[0] == (b[0] if b[0] < 2 ** 63 else None) and a[1] == pytest.approx(b[1], rel=1e-6, abs=1e-6) and a[2] == pytest.approx(b[2], rel=1e-6)
    return out


def test_against_definition(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(200, 6)) * [1, .5, .2, 3, .1, .05]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    rows += [(900 + i, rows[3][1]) for i in range(100)] + [(None, rows[5][1]), (4, rows[4][1]), (7, [0.5] * 6)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [math.nan] * 6), (303, [math.inf] + [0.0] * 5)]
    check(spark, rows)


def test_one_sign_for_all_rows(spark):
    rows = [(i, [float(i), float(i % 3)]) for i in range(40)]
    w = {r.vec_id: r.whitened for r in check(spark, rows) if r.component == 1}
    assert [w[i] for i in range(40)] == sorted(w.values(), reverse=w[0] > w[39])


def test_odd_lengths_and_constant_dimensions(spark):
    check(spark, [(i, [float(i * i % 7), 2.0, float(i % 5)][:1 + i % 3]) for i in range(30)] + [(99, [])])
    check(spark, [(i, [1.0, float(i % 2)]) for i in range(6)])


def test_steep_spectrum(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate(rng.normal(size=(80, 3)) * [3e6, 50.0, 1.0] + [0, 3, 9])])


def test_no_component(spark):
    for rows in ([], [(1, [1.0, 2.0])] * 3, [(1, None)], [(1, [])]):
        out = whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


@pytest.mark.parametrize("reach", [1, 300, 2 ** 40, 2 ** 62])
def test_bit_sliced_products_are_exact(reach):
    rng = np.random.default_rng(3)
    x = rng.integers(0, reach, (150, 4), endpoint=True, dtype=np.uint64)
    x[:, 2] = 0
    bits = [int(c.max()).bit_length() for c in x.T]
    s = Scatter(bits)
    s.add(x[:70])
    s.add(x[70:])
    got = {}
    for i, j, limb, value in zip(*(a.tolist() for a in s.rows())):
        got[i, j] = got.get((i, j), 0) + (value << 24 * limb)
    y = [[int(v) for v in row] for row in x]
    for i in range(4):
        assert got.get((i, -1), 0) == sum(r[i] for r in y)
        for j in range(i, 4):
            assert got.get((i, j), 0) == sum(r[i] * r[j] for r in y)


def test_whole_numbers_and_packing():
    assert to_whole(np.array([-0.0, -1e-9, 0.999, 1e300, -1e300]), 256.0).tolist() == [0, -1, 255, 2 ** 63 - 1, -2 ** 63]
    for v in ([], [0, -1], [127, -128], [128], [-2 ** 31, 5], [2 ** 63 - 1, -2 ** 63]):
        assert unpack_vector(pack_vector(np.array(v, np.int64))).tolist() == v


def test_extended_eigenvectors():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0].astype(np.longdouble)
    a = (q * np.array([10.0 ** -k for k in range(12)], np.longdouble)) @ q.T
    values, vectors = eigen((a + a.T) / 2, 5)
    assert values[:5] == pytest.approx([10.0 ** -k for k in range(5)], rel=1e-9)
    assert np.abs(vectors @ vectors.T - np.eye(12)).max() < 1e-14


def test_usable_vectors_of_a_slice():
    import pyarrow as pa
    col = pa.array([[1.0], None, [2.0, None], [3.0, 4.0], [math.nan]], pa.list_(pa.float64()))
    places, vectors = usable_vectors(col.slice(1))
    assert places.tolist() == [2] and vectors[0].tolist() == [3.0, 4.0]
