import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from stratus.llm import prefix_trie as P
from stratus.llm.perfect_hash import PerfectHash

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"


def plain_conversations(rows):
    """Rows (conv, turn, role, text) with distinct turns in a conversation -> {conv: [(role, text)]}."""
    out = defaultdict(list)
    for conv, turn, role, text in sorted(((c, (t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c is not None)):
        out[conv].append((role, text))
    return dict(out)


def plain_rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)


def random_rows(seed, convs=60, longest=12, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        n = rng.randrange(longest)
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é" * 3, "", None][:words])) for t in rng.sample(range(50), n)]
    return rows


@pytest.mark.parametrize("seed,members", [(1, 1000), (2, 5), (3, 1)])
def test_rebuilt_against_definition(spark, seed, members, monkeypatch):
    monkeypatch.setattr(P, "CUT_MEMBERS", members)
    rows = random_rows(seed) + [(None, 1, "user", "lost"), (7, None, "system", "first")]
    want = plain_trie(plain_rebuild(plain_conversations(rows)))
    assert got(P.prefix_trie(P.rebuild(P.numbered_turns(table(spark, rows))))) == want


@pytest.mark.parametrize("members", [1000, 3])
def test_hot_conversation_and_copies(spark, members, monkeypatch):
    monkeypatch.setattr(P, "CUT_MEMBERS", members)
    monkeypatch.setattr(P, "CHUNK_IDS", 7)
    long = [("user" if t % 2 else "assistant", f"turn {t % 17}") for t in range(700)]
    rows = [(c, t, *x) for c in (10, 11, 900) for t, x in enumerate(long[:700 if c != 11 else 650])]
    rows += [(c, t, *x) for c in range(100, 160) for t, x in enumerate(long[:3])]
    rows += [(c, 0, "user", f"own {c}") for c in range(200, 230)] + [(300 + t, k, "user", f"{min(k, t)}") for t in range(12) for k in range(12)]
    convs = plain_conversations(rows)
    assert got(P.prefix_trie(P.as_they_are(P.numbered_turns(table(spark, rows))))) == plain_trie(convs)


def test_equal_turns_have_a_defined_order(spark):
    rows = [(c, 1, "user", x) for c in (1, 2) for x in ("a", "b", "c", "a")]
    out = P.prefix_trie(P.as_they_are(P.numbered_turns(table(spark, rows)))).collect()
    assert len(out) == 5 and {r.n_convs for r in out} == {2}


def test_empty_table(spark):
    out = P.prefix_trie(P.rebuild(P.numbered_turns(table(spark, []))))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert out.count() == 0


def test_turnless_conversations_are_members(spark):
    rows = [(c, 0, "user", "only") for c in (1, 2, 3, 4)]
    convs = plain_rebuild(plain_conversations(rows))
    assert any(not x for x in convs.values())
    assert got(P.prefix_trie(P.rebuild(P.numbered_turns(table(spark, rows))))) == plain_trie(convs)


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2 ** 63, (5000, 2), dtype=np.uint64)
    keys[1000:2000, 0] = keys[:1000, 0]
    table_ = PerfectHash(keys)
    assert sorted(table_.slots(keys).tolist()) == list(range(5000))
    assert (table_.slots(rng.integers(0, 2 ** 63, (5000, 2), dtype=np.uint64)) == -1).all()
    assert len(PerfectHash(keys[:0]).slots(keys[:3])) == 3
    with pytest.raises(ValueError):
        PerfectHash(np.concatenate([keys[:3], keys[:1]]))
