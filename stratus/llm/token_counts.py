"""Token counts by the whole-token shortcut.

Offline (once per job) every vocabulary string is put to the tokenizer; those
that are one pre-token and come back as exactly one id need no merging, ever.
Texts are cut into pre-tokens; those in the proven set count one, only the rest
are merged by the tokenizer's BPE model.

Pre-tokens are found per distinct chunk, not per occurrence.  A space between two
non-space characters always begins a pre-token and a single line feed between two is one,
so such a text is cut there and its chunks are counted independently.  A text with
any other white space is cut as a whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from stratus.llm.words import blocks, coded

# Fixed value: the published pre-token pattern of this vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_COUNTS = 400_000
CACHED_LENGTH = 48


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the tokenizer gives as one id when they stand alone."""
    tokenizer = Tokenizer.from_file(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    strings = [s for s in (tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size()))
               if s and "�" not in s and s not in special]
    return frozenset(s for s, e in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False)) if len(e) == 1)


class Counter(dict):
    """Tokens of a chunk of text without special strings; forgets when full."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = regex.compile(PRE_TOKEN).findall
        self.spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole = whole
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.rest: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of a pre-token that is no whole token."""
        n = self.rest.get(word)
        if n is None:
            n = len(self.model.tokenize(self.spell.pre_tokenize_str(word)[0][0]))
            if len(word) <= CACHED_LENGTH:
                if len(self.rest) >= CACHED_COUNTS:
                    self.rest.clear()
                self.rest[word] = n
        return n

    def of(self, text: str) -> int:
        whole = self.whole
        # Beyond the first blocks, Unicode versions differ in what is a letter: there the library cuts.
        cut = self.find(text) if text.isascii() or max(text) < "\u0300" else \
            [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return sum(1 if w in whole else self.merged(w) for w in cut)

    def __missing__(self, chunk: str) -> int:
        n = self.of(chunk)
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHED_COUNTS:
                self.clear()
            self[chunk] = n
        return n

    def text(self, text: str) -> int:
        """A whole text, special strings included (each is one token, as the library takes it)."""
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.of(p) for p in parts)

    def block(self, texts: pa.Array) -> np.ndarray:
        """Token counts of a block of texts (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lines = pc.replace_substring(texts, "\n", " \n ")
        first, codes, distinct = coded(pc.split_pattern(lines, " "))
        chunks = distinct.to_pylist()
        feed = np.array([c == "\n" for c in chunks], bool)
        odd = np.array([c != "\n" and (not c or c[0].isspace() or c[-1].isspace() or self.special.search(c) is not None) for c in chunks], bool)
        # A chunk follows a space unless it opens the text or a line.
        bare = np.zeros(len(codes), bool)
        bare[first[:-1][first[:-1] < first[1:]]] = True
        after = np.flatnonzero(feed[codes])
        bare[after[after + 1 < len(codes)] + 1] = True
        spaced = np.zeros(len(chunks), np.int64)
        alone = np.zeros(len(chunks), np.int64)
        used = np.bincount(codes[~bare], minlength=len(chunks)) > 0
        opens = np.bincount(codes[bare], minlength=len(chunks)) > 0
        for i, c in enumerate(chunks):
            if feed[i]:
                spaced[i] = alone[i] = 1
            elif not odd[i]:
                if used[i]:
                    spaced[i] = self[" " + c]
                if opens[i]:
                    alone[i] = self[c]
        each = np.where(bare, alone[codes], spaced[codes])
        totals = np.concatenate([[0], np.cumsum(each)])
        strange = np.concatenate([[0], np.cumsum(odd[codes])])
        out = totals[first[1:]] - totals[first[:-1]]
        for i in np.flatnonzero(strange[first[1:]] > strange[first[:-1]]):
            out[i] = self.text(texts[int(i)].as_py())
        return out


@lru_cache(maxsize=2)
def counter(path: str, whole: frozenset[str]) -> Counter:
    return Counter(path, whole)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row's whole text.

    Null and empty texts have 0 bytes and 0 tokens.  Rows with null or equal ids
    are kept; an empty table gives no rows; extra columns are left out.
    """
    # The proven set is part of the vocabulary, so it does not grow with the data.
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))

    def count(batches):
        own = counter(tokenizer, proven.value)
        for batch in batches:
            texts = batch.column(1)
            counts = [own.block(texts.slice(a, b - a)) for a, b in blocks(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(counts) if counts else [], pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    text = docs[f"`{text_col}`"]
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), text.alias("text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
