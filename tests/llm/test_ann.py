import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.llm import ann
from stratus.llm.ann import cells, hadamard, nearest, needed_probes, packed, rotated, unpacked

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])


def brute(rows, ask, k=5):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x for x in v)]
    out = {}
    for i, q in ok:
        if ask(i):
            near = sorted((-float((q * v).sum() / math.sqrt((q * q).sum()) / math.sqrt((v * v).sum())), j) for j, v in ok if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 20))
    assert np.allclose(np.linalg.norm(rotated(x, 1, 0, 3), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(np.eye(8)) @ hadamard(np.eye(8)).T, np.eye(8))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (cells(unit, 0, 3, 6, 1)[:, :1] == cells(unit, 0, 3, 1, 1)).all() and len(set(cells(unit, 0, 3, 6, 1)[0])) == 6


def test_recall(spark):
    folder = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 10 == 0)
    got = {}
    for r in nearest(df, F.col("id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(got[q]) == 5 for q in got)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {q: dict(want[q]) for q in want}
    assert all(s == pytest.approx(exact[q][j], abs=1e-12) for q in got for j, s in got[q] if j in exact[q])


def found(spark, x, ask, **more):
    """Share of the true five neighbours found, by id % ask == 0."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    queries = range(0, len(x), ask)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {q: set() for q in queries}
    for r in nearest(df, F.col("id") % ask == 0, **more).collect():
        got[r.query_id].add(r.vec_id)
    assert all(len(v) == 5 for v in got.values())
    near = {q: set(j for j in np.argsort(-(unit @ unit[q]), kind="stable")[:6].tolist() if j != q) for q in queries}
    return sum(len(got[q] & near[q]) for q in queries) / (5 * len(got))


def test_needed_probes():
    x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in np.random.default_rng(4).normal(size=(2, 40, 20)))
    for second in (0, 5):
        place = [list(own).index(at) + 1 for own, at in zip(cells(x, 2, second, 1000, 9), cells(y, 2, second, 1, 9)[:, 0])]
        assert needed_probes(x, y, 2, second, 9).tolist() == place


def test_probes_are_raised(spark):
    # Random directions in many small cells: the given probes meet under a tenth of the vectors.
    x = np.random.default_rng(3).normal(size=(8000, 32))
    few = dict(tables=4, probes=4, cell_rows=8)
    assert found(spark, x, 40, recall=0.0, **few) < 0.6
    assert found(spark, x, 40, **few) >= 0.9


def test_recall_of_the_job_where_few_vectors_are_met(spark, monkeypatch):
    """The query's own parameters on directions with neighbours to find: under a tenth of the vectors is met, 0.9 is found."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(1500, 48))
    x = (centres[rng.integers(0, 1500, 12000)] + 0.35 * rng.normal(size=(12000, 48))).astype(np.float32).astype(float)
    looked = {}
    real = ann.wanted_probes
    monkeypatch.setattr(ann, "wanted_probes", lambda *a: looked.update(real(*a)) or looked)
    assert found(spark, x, 60, cell_rows=32, probes=1) >= 0.9
    axes_ = 128 * max(1, 2 * ann.second_dimensions(12000, 48, 32))
    assert ann.TABLES * max(looked.values()) / axes_ < 0.1


def test_single_precision_travels_exactly():
    for x in ([1.5, -0.0, 3e-40], [0.1, 2.0, 1e300], [1e39, 1.0, 0.0]):
        x = np.array(x)
        data = packed(x)
        with np.errstate(over="ignore"):
            single = bool((x.astype(np.float32) == x).all())
        assert (unpacked([data], 3)[0] == x).all() and (len(data) == 12) == single
    assert unpacked([packed(np.array([1.0, 2.0])), packed(np.array([0.1, 2.0]))], 2).tolist() == [[1.0, 2.0], [0.1, 2.0]]


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, -0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [None, 1.0, 0.0]),
            (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]),
            (20, [1.0, 2.0]), (21, [2.0, 1.0]), (30, [1e-30, 0.0, 1e-30]), (40, [3e38, 3e38, 0.0])]
    rows += [(100 + i, [1.0, 0.0, 0.0]) for i in range(60)] + [(1000 + i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(40)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    want = brute([r for k, r in enumerate(rows) if k != 10], lambda i: i % 10 == 0)
    got = {}
    for r in nearest(df, F.col("id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items() if v}
    for q in (0, 10, 20, 100, 30, 40):
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert nearest(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_distinct_ties(spark):
    # 50 multiples of one direction by powers of two, ids against the order of rows; and one-hot vectors, which all tie at 0.
    rows = [(2000 - 7 * i, [2.0 ** (i - 25), 2.0 ** (i - 24), -(2.0 ** (i - 25))]) for i in range(50)] + [(5, [1.0, 2.0, -0.99])]
    rows += [(9000 - i, [float(j == i) for j in range(64)]) for i in range(60)]
    ask = {1300, 2000, 5, 8990}
    want = brute(rows, lambda i: i in ask)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {q: [] for q in want}
    for r in nearest(df, F.col("id").isin(*ask)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [j for j, _ in near] for q, near in want.items()}


def test_ids_with_several_vectors(spark):
    # Id 1 stands at eight close vectors, id 2 at six further ones, so that the nearest vectors hold few ids.
    rows = [(1, [1.0, 0.01 * j, 0.0]) for j in range(8)] + [(2, [1.0, 0.2 + 0.01 * j, 0.0]) for j in range(6)] + [(10 + j, [1.0, 0.5 + 0.1 * j, 0.1]) for j in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for q, x in rows[:8] + [rows[14]]:
        score = {}
        for i, v in rows:
            cos = np.dot(x, v) / math.sqrt(np.dot(x, x) * np.dot(v, v))
            score[i] = max(score.get(i, -2.0), cos)
        want.append((q, [i for i in sorted(score, key=lambda i: (-score[i], i)) if i != q][:5]))
    got = {}
    for r in nearest(df, F.col("id").isin(1, 10)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in (1, 10):
        assert sorted(got[q]) == sorted((rank, i) for p, near in want if p == q for rank, i in enumerate(near, 1))
