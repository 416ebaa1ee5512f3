import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stratus.llm.quality import BUCKETS, FACTORS, Machine, features, fit, score, train


def test_linear_time_score_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    size = BUCKETS + 200
    m = Machine(0.3, rng.normal(size=size), rng.normal(size=(size, FACTORS)), np.zeros(14), np.ones(14), np.zeros((14, 7)))
    to, index, value = m.rows(*features(pa.array(["a b c b", "", "D, e"])))
    for r, z in enumerate(m.margins(to, index, value)):
        i, x = index[to[r]:to[r + 1]], value[to[r]:to[r + 1]]
        plain = m.bias + sum(m.linear[i] * x) + sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert z == pytest.approx(plain)


def test_statistics():
    first, hashed, stats = features(pa.array(["AB ab ab\n| x!!", None, " "]))
    row = dict(zip(["words", "chars", "bytes", "mean", "upper", "digits", "symbols", "ends", "caps", "doubled", "distinct", "bars", "line", "most"], stats[0]))
    assert np.expm1(row["words"]) == pytest.approx(5) and row["doubled"] == pytest.approx(1 / 5) and row["distinct"] == pytest.approx(4 / 5)
    assert row["caps"] == pytest.approx(1 / 5) and row["bars"] == pytest.approx(1 / 5) and row["ends"] == pytest.approx(1 / 5)
    assert first.tolist() == [0, 4, 4, 4] and np.isfinite(stats).all()


def test_held_out_accuracy(spark):
    from stratus.llm.entry import op8_quality
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op8_quality(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [(rows[i].predicted, y) for i, y in labels.items() if rows[i].held_out]
    assert len(held) > 40 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= .3) for i, r in rows.items())


def test_odd_rows(spark):
    rng = random.Random(0)
    texts = [None, "", " ", "x" * 9000, "ok " * 4000] + [" ".join(rng.choices("red blue green".split(), k=20)) + ("!! %%%" * (i % 2)) for i in range(60)]
    df = spark.createDataFrame([(None if i == 9 else i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5, 65)] + [(None, 1), (7, None), (8, 1)], "doc_id long, quality int")
    m = train(df, labels)
    assert m.trained and m.linear.tolist() == train(df.repartition(3), labels).linear.tolist()
    out = score(df, m)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == len(texts)
    assert score(df.limit(0), m).count() == 0
    none = train(df, labels.limit(0))
    assert not none.trained and {r.score for r in score(df, none).collect()} == {0.5}
    assert not train(df.limit(0), labels).trained
    assert len(fit(np.array([0]), np.zeros(0, int), np.zeros((0, 14)), np.zeros(0)).linear) > BUCKETS
