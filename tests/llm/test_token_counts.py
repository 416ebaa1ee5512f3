import random

import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from stratus.llm.token_counts import PRE_TOKEN, Counter, count_tokens, whole_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n", "a\n", "\na", "a \n b", "a  b", "a\n\nb", "a\nb\nc", "x y  z", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
       "it's we'll IT'S ''s ' s", "a\x1cb \x85 c", "1,234 ... don't!", "é" * 700, "é 𝒳𝒴 ß́ ​ x", "\t\ta b\r\nc", "� x", "word " * 900,
       "a\n b", "a \nb", " lead", "trail ", "\n\n", "z" * 5000]


def test_counts_are_the_librarys():
    lib = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["a", "Bc", " ", " ", "\n", "é", "1", ",", "'s", " ", "\t", "日本"]) for _ in range(rng.randint(0, 60)))
                   for _ in range(800)]
    own = Counter(PATH, whole_tokens(PATH))
    got = own.block(pa.array(texts, pa.string()))
    assert got.tolist() == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_whole_tokens_are_proven():
    lib = Tokenizer.from_file(PATH)
    whole = whole_tokens(PATH)
    assert len(whole) > 40_000
    assert all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(0).sample(sorted(whole), 500))


def test_pattern_cuts_as_the_library():
    lib = Tokenizer.from_file(PATH)
    find = regex.compile(PRE_TOKEN).findall
    for seed in range(300):
        rng = random.Random(seed)
        text = "".join(chr(rng.randrange(0x300)) if rng.random() < .7 else rng.choice(" a\n1'") for _ in range(200))
        assert find(text) == [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)]


def test_every_plane_counts_as_the_library():
    lib = Tokenizer.from_file(PATH)
    own = Counter(PATH, whole_tokens(PATH))
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(at, at + 0x400) if not 0xD800 <= c < 0xE000) for at in range(0, 0x20000, 0x400)]
    assert own.block(pa.array(texts)).tolist() == [len(lib.encode(t).ids) for t in texts]


def test_documents(spark):
    lib = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, "q") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, PATH).collect())
    want = [(r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 512)
            for r in df.collect()]
    assert got == sorted(want)
    assert count_tokens(df.limit(0), PATH).count() == 0
