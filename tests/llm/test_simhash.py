import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from stratus.llm.graph import connected_components
from stratus.llm.simhash import fingerprint, near_duplicates, near_links, segment_counts


def plain(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for t in [None, "", " \t", "One", "one two", "A b c", "É B\x1cc d\x0be f " * 40, "x y z " * 3000]:
        assert fingerprint(t, 3) == plain(t, 3)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_against_all_pairs(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = set(base)
    for x in base:
        for _ in range(25):
            y = x
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
    fps = [signed(x) for x in sorted(prints)]
    want = components([(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits], fps)
    links = [(r.a, r.b) for r in near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), bits).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= bits for a, b in links)
    assert components(links, fps) == want


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(4)
    rows = [(signed(rng.getrandbits(64)),) for _ in range(200)]
    for r in spark.createDataFrame(rows, "fp long").select("fp", segment_counts(F.col("fp")).alias("at")).collect():
        for s in range(16):
            assert (r.at >> 4 * s & 15) == (r.fp >> 4 * s & 15).bit_count()


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(pairs, {x for p in pairs for x in p})
    assert got == {n: r for n, r in want.items() if n in got} and set(want) - set(got) == {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}


def test_documents(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    texts = [None, "", " ", "One", "one", "one two"]
    for _ in range(25):
        words = rng.choices(vocab, k=300)
        texts.append(" ".join(words))
        for _ in range(4):
            words[rng.randrange(300)] = "changed"
            texts.append(" ".join(words))
    texts += [texts[10]] * 60
    ids = rng.sample(range(10_000), len(texts))
    ids[3], ids[20] = None, ids[21]
    df = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, fp string")
    fps = [plain(t, 3) for t in texts]
    root = components([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2], set(fps))
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = [(i, f"{f:016x}", least.get(root[f])) for i, f in zip(ids, fps)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, near_duplicates(df).collect()), key=key) == sorted(want, key=key)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
