from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from stratus.llm.quality import score, train
from stratus.llm.simhash import fingerprint
from tests.llm.test_simhash import components

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean = P.quality(spark, docs, FOLDER).cache()
    machine = train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = {r.doc_id for r in score(docs, machine).collect() if r.score >= .3}
    assert {r.doc_id for r in clean.collect()} == kept and clean.columns == docs.columns
    single = P.near_dedup(spark, clean, FOLDER).cache()
    rows = {r.doc_id: r for r in clean.collect()}
    fps = {i: fingerprint(r.text, 3) for i, r in rows.items()}
    distinct = sorted(set(fps.values()))
    root = components([(a, b) for k, a in enumerate(distinct) for b in distinct[:k] if (a ^ b).bit_count() <= 2], distinct)
    least = {}
    for i in sorted(rows):
        least.setdefault(root[fps[i]], i)
    assert sorted(map(tuple, single.collect())) == sorted(tuple(rows[i]) for i in least.values()) and single.columns == docs.columns
    mixed = P.mix(spark, single, FOLDER).cache()
    assert mixed.columns == docs.columns
    taken = Counter(r.doc_id for r in mixed.collect())
    assert max(taken.values()) <= 3 and set(taken) <= set(least.values())
    packed = P.pack(spark, mixed, FOLDER).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == taken
    loads = Counter()
    for r in packed:
        loads[r.sequence_id] += r.length
    assert max(loads.values()) <= 2048


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(3, long, "en", "a", 1, "x"), (1, long + " end", "en", None, 1, "x"), (1, long + " end", "en", None, 1, "x"), (None, long, "en", "a", 1, "x"),
            (7, None, None, None, None, None), (8, "", "en", "", 0, "y"), (None, "quite another text here", None, "b", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `size` string")
    out = P.near_dedup(spark, df, FOLDER)
    assert out.columns == df.columns
    ids = sorted(((r.doc_id is None, r.doc_id) for r in out.collect()), key=str)
    assert ids == sorted([(False, 1), (False, 7), (True, None)], key=str) or ids == sorted([(False, 1), (False, 3), (False, 7), (True, None)], key=str)
    mixed = P.mix(spark, out, FOLDER)
    assert mixed.columns == df.columns and all(r.text for r in mixed.collect())
    assert P.pack(spark, mixed, FOLDER).count() >= mixed.count()
    empty = df.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_clashing_columns_keep_their_values(spark):
    """Input columns named like the stages' own ones come out as they went in."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    names = ["_digest", "_quality", "_clean", "_Chosen_ID", "_chosen_digest", "fp", "size", "whole_row", "order", "shard", "place"]
    df = docs.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])
    for _, stage in P.STAGES[:-1]:
        df = stage(spark, df, FOLDER).cache()
        rows = df.collect()
        assert rows and df.columns == [*docs.columns, *names]
        assert all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)
    assert P.pack(spark, df, FOLDER).count() >= len(rows)


def test_equal_id_and_text_stay_once_and_always_the_same(spark):
    rows = [(1, "one two three four", k, str(k % 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, lang string")
    want = min(rows, key=lambda r: '{"n":%d,"lang":"%s"}' % (r[2], r[3]))
    for parts in (1, 3, 7):
        assert [tuple(r) for r in P.near_dedup(spark, df.repartition(parts, "n"), FOLDER).collect()] == [want]
