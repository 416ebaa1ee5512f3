import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratus.llm.common import new_path
from stratus.llm.elias_fano import EliasFano
from stratus.llm.token_store import Segment, lookup_documents, pack_segment, read_token_store, write_token_store
from stratus.llm.tokens import WordIds, encode_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(20))
def test_elias_fano(seed):
    rng = random.Random(seed)
    n = rng.choice([0, 1, 2, 65, 700])
    values = sorted(rng.randrange(rng.choice([1, 5, 1000, 1 << 40])) for _ in range(n))
    data = b"xx" + EliasFano.of(np.array(values, np.uint64)).to_bytes() + b"yy"
    back, end = EliasFano.from_bytes(data, 2)
    assert end == len(data) - 2 and back.values().tolist() == values
    assert [back.select(i) for i in range(n)] == values
    with pytest.raises(IndexError):
        back.select(n)
    if n == 700:
        assert len(data) * 8 < n * (5 + max(1, values[-1] // n).bit_length()) + 400


def test_segment():
    ids = [np.array(x, "<u4") for x in ([1, 2], [70000], [], [3])]
    seg = Segment(pack_segment([None, -5, -5, 1 << 40], ids))
    assert [seg.doc_id(k) for k in range(len(seg))] == [None, -5, -5, 1 << 40]
    assert [seg.ids(k).tolist() for k in range(4)] == [x.tolist() for x in ids]


def test_store(spark):
    rng = random.Random(1)
    texts = [None, "", "\t", "a<|endoftext|>b", "same", "same"] + ["Some words, here. " * rng.randint(0, 200) for _ in range(60)]
    keys = [None, 9, -3, 9, 4, 4] + rng.sample(range(100, 10 ** 12), 60)
    df = spark.createDataFrame(list(zip(keys, texts, texts)), "doc_id long, text string, `start` string")
    path = new_path(spark, "test-store")
    write_token_store(df, path, PATH, segment_ids=500)
    rows = sorted(read_token_store(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(PATH)
    want = {}
    for k, t in zip(keys, texts):
        want.setdefault(k, []).append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    at, got = 0, {}
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.doc_id for r in rows]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_empty_store(spark):
    path = new_path(spark, "test-store")
    write_token_store(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert read_token_store(spark, path).count() == 0


def test_lookup_equals_the_whole_table(spark):
    rng = random.Random(2)
    keys = [None, None, -7, -7, 0, 3, 3, 3] + rng.sample(range(10, 10 ** 10), 150)
    df = spark.createDataFrame([(k, f"text {i} of some words " * rng.randint(0, 9)) for i, k in enumerate(keys)], "doc_id long, text string")
    path = new_path(spark, "test-store")
    write_token_store(df, path, PATH, segment_ids=300)
    rows = read_token_store(spark, path, with_ids=True).collect()
    asked = [-7, 3, 3, 5, 10 ** 11, *keys[20:60]]
    want = sorted((r.doc_id, r.start, bytes(r.ids)) for r in rows if r.doc_id in asked)
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in lookup_documents(spark, path, asked).collect()) == want and len(want) == 45
    assert lookup_documents(spark, path, []).count() == 0 and lookup_documents(spark, path, [1]).count() == 0


@pytest.mark.parametrize("cached", [200_000, 50])
def test_ids_of_odd_words(monkeypatch, cached):
    """Whole texts against the library: cases, signs, special strings, scripts; also with a cache that turns over all the time."""
    from stratus.llm import tokens
    monkeypatch.setattr(tokens, "CACHED_WORDS", cached)
    tokens.word_ids.cache_clear()
    rng = random.Random(3)
    texts = ["".join(rng.choices("aAbBéÉİßñŐ'._-,;:!?<|>()&{}~^`\"0 19\t\n日本\u0301ᾳΣσς", k=rng.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(rng.choices("aAbBéÉßñz'._-,;:!?()& 0", k=rng.randint(1, 30))) for _ in range(4000)]
    texts += ["a<|endoftext|>b", "<|ENDOFTEXT|> X", "x<|startoftext|>.,", "it's 'S don't!! 'tis", "abc_ abc' abc',", "İ. İ&&"]
    got = {i: x.tolist() for i, x in encode_texts(pa.array(texts), PATH)}
    for i, e in enumerate(Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)):
        assert got[i] == e.ids, texts[i]
    tokens.word_ids.cache_clear()


def test_word_cache_is_bounded(monkeypatch):
    from stratus.llm import tokens
    monkeypatch.setattr(tokens, "CACHED_WORDS", 10)
    table = WordIds(PATH)
    want = {w: table[w] for w in ["w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60)]}
    assert len(table) <= 11 and len(table.older) <= 11 and all(table[w] == ids for w, ids in want.items())
