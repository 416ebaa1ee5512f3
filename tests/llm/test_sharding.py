import random
import zlib

import pytest
from pyspark.sql import functions as F

from stratus.llm.sharding import Cell, Group, minimax_cuts, near_equal_cuts, shard_documents


def cells_of(sizes):
    starts, at = [], 0
    for s in sizes:
        starts.append(at)
        at += s

    def fetch(spans, width):
        out = {}
        for i, (a, s) in enumerate(zip(starts, sizes)):
            if any(x <= a < y for x, y in spans):
                key = (a // width, s > width)
                c = out.get(key)
                out[key] = Cell(a, s, 1, i) if c is None else Cell(c.start, c.size + s, c.groups + 1, c.first_row)
        return list(out.values())
    return fetch, at


def needed(sizes, capacity):
    n, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return 10 ** 9
        if s > room:
            n, room = n + 1, capacity
        room -= s
    return n


@pytest.mark.parametrize("seed", range(25))
def test_capacity_is_the_smallest(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 3, 17, rng.randint(1, 900), 4_000 if rng.random() < .01 else 5]) for _ in range(rng.randint(1, 300))]
    shards = rng.randint(1, 12)
    fetch, total = cells_of(sizes)
    got, cuts = minimax_cuts(fetch, total, max(sizes), shards, cells=rng.choice([3, 16, 64]), single=rng.choice([1, 10]))
    best = next(c for c in range(max(max(sizes), -(-total // shards)), total + 1) if needed(sizes, c) <= shards)
    assert got == best
    ends = [c.start for c in cuts[1:]] + [total]
    assert all(b - a.start <= got for a, b in zip(cuts, ends)) and len(cuts) <= shards


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    where, loads = {}, {}
    for r in rows:
        where.setdefault(r.text, set()).add(r.shard)
        loads.setdefault(r.shard, []).append(r)
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert all(len(s) == 1 for s in where.values()) and all(0 <= s < shards for s in loads)
    for own in loads.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_documents(spark):
    rng = random.Random(5)
    texts = [rng.choice([None, "", "same", "é" * rng.randint(0, 50), "w " * rng.randint(0, 900)]) for _ in range(400)] + ["hot"] * 200
    df = spark.createDataFrame([(i if i != 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, `shard` string")
    out = shard_documents(df, 7).join(df.select(F.md5("text").alias("k"), "text").distinct(), F.col("group_key") == F.coalesce("k", F.lit("")), "left")
    check(out.collect(), texts, 7)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shard_documents(df).count() == 0
    one = shard_documents(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")).collect()
    assert [(r.shard, r.slot) for r in sorted(one, key=lambda r: r.slot)] == [(0, 0), (0, 1)]


@pytest.mark.parametrize("seed", range(25))
def test_large_groups_do_not_raise_the_largest_shard(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 3, 17, rng.randint(1, 900), rng.randint(1, 90_000) if rng.random() < .03 else 5]) for _ in range(rng.randint(1, 300))]
    shards = rng.randint(1, 40)
    fetch, total = cells_of(sizes)
    groups = sorted((Group(sum(sizes[:i]), s, 1, i) for i, s in enumerate(sizes)), key=lambda g: (-g.size, g.start))

    def fetch_without(own):
        return cells_of([s for i, s in enumerate(sizes) if i not in {g.first_row for g in own}])[0]

    own, cuts = near_equal_cuts(fetch_without, groups[:shards], total, shards, cells=16, single=10)
    rest = total - sum(g.size for g in own)
    ends = [c.start for c in cuts[1:]] + [rest]
    loads = [g.size for g in own] + [b - a.start for a, b in zip(cuts, ends)]
    assert sum(loads) == total and len(loads) <= shards
    assert max(loads) <= minimax_cuts(fetch, total, max(sizes), shards)[0]


@pytest.mark.parametrize("share", [1 / 3, 0.05])
def test_sizes_beside_a_hot_group(spark, share):
    rng = random.Random(8)
    texts = ["x%d " % i + "w" * rng.randint(50, 400) for i in range(4000)]
    hot = "h" * 1000
    texts += [hot] * round(share / (1 - share) * sum(len(t) + 16 for t in texts) / 1016)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = shard_documents(df, 40).join(df, "doc_id").collect()
    check(out, texts, 40)
    loads = {}
    for r in out:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    alone = next(r.shard for r in out if r.text == hot)
    assert {r.text for r in out if r.shard == alone} == {hot}
    rest = [n for shard, n in loads.items() if shard != alone]
    assert len(rest) == 39 and max(rest) <= 1.05 * sum(rest) / 39 and min(rest) >= 0.5 * sum(rest) / 39


def plain_even_cuts(sizes, shards):
    """Group by group: the smallest feasible capacity, then each cut as near to its share as the later shards allow."""
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    total, shards = sum(sizes), min(shards, len(sizes))
    capacity = next(c for c in range(max(max(sizes), -(-total // shards)), total + 1) if needed(sizes, c) <= shards)
    cuts = [0]
    for k in range(1, shards):
        free = [i for i in range(len(sizes)) if starts[cuts[-1]] < starts[i] <= starts[cuts[-1]] + capacity and len(sizes) - i >= shards - k
                and needed(sizes[i:], capacity) <= shards - k]
        cuts.append(min(free, key=lambda i: (abs(starts[i] - k * total / shards), i)))
    return [starts[i] for i in cuts]


@pytest.mark.parametrize("seed", range(40))
def test_even_cuts_against_every_group(seed):
    rng = random.Random(seed)
    kind = rng.choice(["small", "lumpy", "equal"])
    n = rng.randint(1, 220)
    sizes = [{"small": rng.randint(1, 9), "lumpy": rng.choice([rng.randint(1, 30), 200, 400]), "equal": 50}[kind] for _ in range(n)]
    shards = rng.randint(1, 40)
    fetch, total = cells_of(sizes)
    _, cuts = minimax_cuts(fetch, total, max(sizes), shards, cells=rng.choice([4, 16, 4096]), single=rng.choice([1, 10, 10 ** 6]))
    assert [c.start for c in cuts] == plain_even_cuts(sizes, shards)


@pytest.mark.parametrize("groups", [40, 41, 60, 79, 80, 100])
def test_equal_groups_use_every_shard(groups):
    fetch, total = cells_of([1000] * groups)
    capacity, cuts = minimax_cuts(fetch, total, 1000, 40, cells=16, single=10)
    loads = [b - a.start for a, b in zip(cuts, [c.start for c in cuts[1:]] + [total])]
    assert capacity == 1000 * -(-groups // 40) and len(loads) == 40 and max(loads) == capacity and max(loads) - min(loads) <= 1000


def test_groups_just_below_the_mean(spark):
    """60 texts with ten copies each: every shard is used and none holds more than two texts."""
    df = spark.createDataFrame([(i, "%03d" % (i % 60) + "x" * 500) for i in range(600)], "doc_id long, text string").repartition(4)
    loads = [r["n"] for r in shard_documents(df, 40).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(loads) == 40 and set(loads) == {10, 20}
