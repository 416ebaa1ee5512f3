import hashlib
import random
from collections import Counter, defaultdict

import pytest

from stratus.llm.cuckoo import CuckooFilter, LiveDigests
from stratus.llm.exact_dedup import exact_duplicates, update_live

SCHEMA = "doc_id long, text string, keep_id string, digest string, row int"


def plain(rows):
    """Rows (id, text) -> sorted result tuples by definition."""
    groups = defaultdict(list)
    for i, (id_, text) in enumerate(rows):
        groups[text or ""].append((id_ is not None, id_ or 0, i))
    out = []
    for text, members in groups.items():
        top = max(members)
        for m in members:
            out.append((m[1] if m[0] else None, top[1] if top[0] else None, len(members), m == top, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], SCHEMA).repartition(parts)


def test_filter_keeps_its_keys_through_deletion_and_kicks():
    rng = random.Random(1)
    f, live = CuckooFilter(256), []
    for _ in range(900):
        key = rng.randbytes(32)
        assert f.insert(*f.place(key))
        live.append(key)
        if rng.random() < 0.2:
            f.delete(*f.place(live.pop(rng.randrange(len(live)))))
    assert all(f.contains(*f.place(k)) for k in live)
    assert sum(f.contains(*f.place(rng.randbytes(32))) for _ in range(20_000)) < 20
    for k in live:
        f.delete(*f.place(k))
    assert not any(f.table)


def test_filter_reports_overflow():
    rng, f = random.Random(2), CuckooFilter(4)
    assert not all([f.insert(*f.place(rng.randbytes(8))) for _ in range(17)])


@pytest.mark.parametrize("limit", [None, 64])
def test_index_equals_a_dictionary(limit):
    rng, index = random.Random(3), LiveDigests(buckets=2, limit=limit)
    keys = [rng.randbytes(32) for _ in range(2000)]
    want, out = defaultdict(int), defaultdict(int)
    for _ in range(8000):
        k = rng.choice(keys)
        if limit is None and rng.random() < 0.4:
            assert index.remove(k) == (want[k] == 1)
            want[k] = max(0, want[k] - 1)
        else:
            index.add(k, 1, (True, 1, 1))
            want[k] += 1
        if index.overfull:
            for e in index.evict():
                out[e.digest] += e.rows
    for e in index.entries():
        out[e.digest] += e.rows
    assert out == {k: n for k, n in want.items() if n}
    assert limit or index.resizes >= 5


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_against_plain_grouping(spark, digest_bytes):
    rng = random.Random(4)
    texts = ["", None, " ", "a", "A", "a ", "é", "é", "word " * 40_000, "\x00", "a\nb"] + [f"t{k}" for k in range(300)]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(i, "hot") for i in range(1000, 1300)]
    rows += [(None, "t1"), (None, "only null"), (None, "only null"), (5, "twice"), (5, "twice"), (-3, "twice")]
    assert got(exact_duplicates(table(spark, rows), digest_bytes=digest_bytes)) == plain(rows)


def test_one_row_stays(spark):
    rows = exact_duplicates(table(spark, [(9, "x")] * 6 + [(2, "x")] * 3)).collect()
    assert [r.kept for r in rows].count(True) == 1 and {(r.keep_id, r.group_size) for r in rows} == {(9, 9)}


def test_empty_table(spark):
    out = exact_duplicates(table(spark, []))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0


def test_updates_equal_a_counter(spark):
    rng, want = random.Random(5), Counter()
    live = spark.createDataFrame([], "digest binary, rows long")
    for _ in range(3):
        added = [rng.choice("abcdefgh") * rng.randrange(3) for _ in range(60)]
        removed = [rng.choice("abcdefgh") * rng.randrange(3) for _ in range(40)]
        live = update_live(live, table(spark, list(enumerate(added))), table(spark, list(enumerate(removed))))
        want = want - Counter(removed) + Counter(added)
    digests = {hashlib.sha256(t.encode()).digest(): n for t, n in want.items()}
    assert {bytes(r.digest): r["rows"] for r in live.collect()} == digests
