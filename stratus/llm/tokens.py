"""Token ids of whole texts with the word-level byte-pair vocabulary.

White space only separates words for this tokenizer, so a text's ids are its
words' ids in order.  Each distinct word of a block is encoded once; words of
letters go straight to the tokenizer's own BPE model.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from stratus.llm.words import blocks, split_words, spread

# ASCII signs whose run is a pre-token of its own after a letter at a word's end (the apostrophe can begin another one),
# and what every special string of the vocabulary begins with.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SPECIAL = "<|"
CACHED_WORDS = 200_000      # words of a generation; two are kept
CACHED_LENGTH = 40
_CODE = next(c for c in "IL" if array(c).itemsize == 4)
if sys.byteorder != "little":
    raise ImportError("token ids are little-endian")


class WordIds(dict):
    """Ids of a word as little-endian unsigned 32-bit bytes.

    Words are kept in two generations: when the younger is full it becomes the older one, and words met again
    move to the younger, so frequent ones stay.
    """

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # How the model spells the bytes of the letters beyond ASCII up to U+00FF.
        self.spelling = {c: spell.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}

    def _encoded(self, word: str) -> bytes:
        if word.isalpha():
            if word.isascii() and word.islower():
                return array(_CODE, [t.id for t in self.tokenize(word)]).tobytes()
            if max(word) < "Ā":
                # Letters up to U+00FF are in composed form already and change case one by one.
                low = word.lower()
                return self[low] if low != word else array(_CODE, [t.id for t in self.tokenize(word.translate(self.spelling))]).tobytes()
        else:
            letters = word.rstrip(TAIL)
            if letters.isalpha() and letters != word and max(letters) < "Ā":
                return self[letters] + self[word[len(letters):]]
        return array(_CODE, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encoded(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode_texts(texts: pa.Array, path: str):
    """Yield (row, ids as a numpy <u4 array) of every text of a column, a block at a time."""
    table = word_ids(path)
    for a, b in blocks(texts):
        first, codes, distinct = split_words(texts.slice(a, b - a))
        if not pc.any(pc.match_substring(distinct, SPECIAL)).as_py():
            # The vocabulary is lower case; special strings are told by their case.
            low = pc.ascii_lower(distinct).dictionary_encode()
            codes, distinct = low.indices.to_numpy(zero_copy_only=False)[codes], low.dictionary
        pieces = [table[w] for w in distinct.to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)]) // 4
        ids, ends = spread(codes, starts, np.frombuffer(b"".join(pieces), "<u4"))
        bounds = np.concatenate([[0], ends])[first]
        for i in range(b - a):
            yield a + i, ids[bounds[i]:bounds[i + 1]]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
