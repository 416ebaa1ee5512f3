import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratus.llm import mixing
from stratus.llm.mixing import mix_sources, mixture, source_targets, split_quotas, words_in


def plain_targets(sizes, weights, cap):
    """Raise all targets together; freeze those that reach their cap; share what is left again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        open_w = sum(w[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else left * w[s] / open_w for s in order}
        new = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not new:
            return target
        full |= new


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 500, 100_000]) for s in [None, "", "a", "b", "é", "src1", "src10", "src2"][:rng.randint(1, 8)]}
    df = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "s_null boolean, s string, source_size long")
    got = {None if r.s_null else r.s: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes, (5, 2, 1), 3))


def test_quota_tree(spark):
    quotas = {"a": 40, "b": 7, "c": 0, "d": 1, "e": 100}
    df = spark.createDataFrame([(False, s, q) for s, q in quotas.items()], "s_null boolean, s string, quota long")
    loads = Counter()
    for r in split_quotas(df, 3, 1).collect():
        assert r.bounds[0] == 0 and r.bounds[-1] == quotas[r.s] and len(r.bounds) == 9 and r.bounds == sorted(r.bounds)
        for k in range(8):
            loads[k] += r.bounds[k + 1] - r.bounds[k]
    assert max(loads.values()) - min(loads.values()) <= 1
    assert {r.s: r.bounds for r in split_quotas(df, 3, 1).collect()} == {r.s: r.bounds for r in split_quotas(df, 3, 1).collect()}


def test_quota_law(spark):
    """Left counts of one split: hypergeometric mean and variance over many seeds."""
    df = spark.createDataFrame([(False, "a", 12), (False, "b", 20)], "s_null boolean, s string, quota long")
    xs = [r.bounds[1] for seed in range(60) for r in split_quotas(df, 1, seed).collect() if r.s == "a"]
    mean = sum(xs) / len(xs)
    var = sum((x - mean) ** 2 for x in xs) / len(xs)
    assert abs(mean - 6) < .7 and .8 < var < 4  # 12 * 16/32 = 6; 12 * 1/2 * 1/2 * 20/31 = 1.94


def test_words(spark):
    texts = [None, "", " \t", "a", " a b  c\x1cd\x0be\n", "x " * 5000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(words_in(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_documents(spark):
    rng = random.Random(4)
    rows = [(i if i % 50 else 7, "w " * rng.randint(0, 60), rng.choice(["hot"] * 5 + ["s1", "s2", "", None, "big"]), "x") for i in range(900)]
    rows += [(None, None, "s1", "x"), (2000, " ", "empty", "x"), (2001, "a " * 3000, "one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `size` string")
    out = mix_sources(df, carry=("text",)).collect()
    again = mix_sources(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, str(r.mix_source), r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    sizes, taken, target, largest = Counter(), Counter(), {}, defaultdict(int)
    for r in out:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 3 * r.size and r.taken == r.passes * r.size
        assert len(r.shards) == len(r.places) == r.passes and all(0 <= k < 16 for k in r.shards)
        sizes[r.mix_source] += r.size
        taken[r.mix_source] += r.taken
        target[r.mix_source] = r.target
        largest[r.mix_source] = max(largest[r.mix_source], r.size)
    assert target == pytest.approx(plain_targets(sizes, (5, 2, 1), 3))
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    mixed = mixture(mix_sources(df))
    assert mixed.agg(F.sum("size")).first()[0] == sum(taken.values())
    # Within a partition a shard's rows lie in the order of their places.
    runs = mixed.select(F.spark_partition_id().alias("p"), "shard", "place").collect()
    assert all(a.p != b.p or (a.shard, a.place) <= (b.shard, b.place) for a, b in zip(runs, runs[1:]))
    assert mix_sources(df.limit(0)).count() == 0 and mixture(mix_sources(df.limit(0))).count() == 0


def test_rows_follow_the_quotas_of_the_tree(spark):
    """Every block of every pass lies in one shard, and the shards' numbers of blocks are those of the splitting tree."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice(["a"] * 8 + ["b"] * 2 + ["c", None])) for i in range(1500)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), blocks=16).collect()
    blocks = defaultdict(set)
    counts = defaultdict(lambda: [0] * 16)
    for source in {r.mix_source for r in out}:
        own = sorted((r for r in out if r.mix_source == source), key=lambda r: (r.order, r.size))
        block, start = max(1, -(-own[0].source_size // 16)), 0
        for r in own:
            for p, shard in enumerate(r.shards):
                blocks[source, p, start // block].add(shard)
            start += r.size
        assert start == own[0].source_size
    for (source, p, b), shards in blocks.items():
        assert len(shards) == 1
        counts[source][min(shards)] += 1
    quotas = {}
    for source in counts:
        r = next(r for r in out if r.mix_source == source)
        block = max(1, -(-r.source_size // 16))
        whole = int(r.target // r.source_size)
        quotas[source] = whole * -(-r.source_size // block) + math.ceil((r.target - whole * r.source_size) / block)
    df = spark.createDataFrame([(s is None, s or "", q) for s, q in quotas.items()], "s_null boolean, s string, quota long")
    for r in split_quotas(df, 4, 42).collect():
        want = [b - a for a, b in zip(r.bounds, r.bounds[1:])]
        # The last block of a rest may hold no row's middle; all others are dealt whole.
        assert all(0 <= w - c <= 1 for w, c in zip(want, counts[None if r.s_null else r.s])) and sum(want) - sum(counts[None if r.s_null else r.s]) <= 1


def test_many_sources_have_trees_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 3)
    df = spark.createDataFrame([(False, f"s{i}", 8) for i in range(7)], "s_null boolean, s string, quota long")
    for r in split_quotas(df, 2, 1).collect():
        assert r.bounds[-1] == 8
    loads = Counter()
    for r in split_quotas(df, 2, 1).collect():
        for k in range(4):
            loads[k] += r.bounds[k + 1] - r.bounds[k]
    assert set(loads.values()) == {14}


def test_sql_gives_the_same(spark):
    import duckdb

    from stratus.llm.entry import OP6_SQL, op6_mixing
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(OP6_SQL).fetchall())
    got = sorted(map(tuple, op6_mixing(spark, folder).collect()))
    assert got == want
