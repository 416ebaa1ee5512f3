import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratus.llm.packing import pack_documents, pack_histogram
from stratus.llm.tokens import encode_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  ", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>.", "Straße ÄÖ ªº µ İstanbul ΣΑΣ. éá ́x", "it's IT'S we'LL. don't, 's",
       "a\x1cb\x0bc d e\x85f", "1,234.56 x.. y., z!? 𝒳𝒴", "x" * 3000 + " " + "é" * 900, "ﬁn ǅ ß. ẞ", "word " * 5000]


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys():
    import pyarrow as pa
    got = {i: ids.tolist() for i, ids in encode_texts(pa.array(ODD, pa.string()), PATH)}
    assert [got[i] for i in range(len(ODD))] == [library(t) for t in ODD]


def bins_of(moves):
    bins, seen = defaultdict(list), defaultdict(list)
    for m in moves:
        for q in range(m.bins * m.each):
            seen[m.length].append(m.item + q)
            bins[m.bin + q // m.each].append((m.offset + q % m.each * m.length, m.length))
    return bins, seen


@pytest.mark.parametrize("seed", range(60))
def test_histogram_packing(seed):
    rng = random.Random(seed)
    cap = rng.choice([1, 2, 7, 30, 100])
    counts = {k: rng.choice([0, 1, 2, 5, 50]) for k in range(1, cap + 1) if rng.random() < .6}
    bins, seen = bins_of(pack_histogram(counts, cap))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= cap
        assert sum(3 * k > cap for _, k in items) <= 2
    volume = sum(k * n for k, n in counts.items())
    assert len(bins) <= 11 / 9 * -(-volume // cap) + 2 + sum(n for k, n in counts.items() if 2 * k > cap)


def test_documents(spark):
    rng = random.Random(3)
    texts = ODD + ["hello there, friend. " * rng.randint(0, 400) for _ in range(80)]
    df = spark.createDataFrame([(5 if i in (3, 4) else None if i == 6 else i, t, "z") for i, t in enumerate(texts)],
                               "doc_id long, text string, length string")
    rows = pack_documents(df, PATH, with_ids=True).collect()
    by_row, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        by_row[r.row].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    whole = []
    for own in by_row.values():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 2048 for r in own[:-1])
        assert [r.start for r in own] == [2048 * k for k in range(len(own))]
        whole.append((own[0].doc_id, np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(whole, key=key) == sorted([(r.doc_id, library(r.text) + [0]) for r in df.collect()], key=key)
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
