"""Whole texts as coded words: every distinct word of a block of texts once.

Texts repeat words heavily, so per-word work is done once per distinct word of a
block and spread back by its code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 8 << 20


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text each (a longer text is a range by itself)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(column)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, to
        at = to


def coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first code of each text and the end, codes, distinct words) of a list array of words."""
    flat = lists.flatten().dictionary_encode()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), flat.indices.to_numpy(zero_copy_only=False), flat.dictionary


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between runs of the six ASCII white-space characters; a null text has none.

    Edges of a text can give empty words.
    """
    return coded(pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))


def spread(codes: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``values[starts[c]:starts[c + 1]]`` for every code c; also the end of each."""
    lengths = (starts[1:] - starts[:-1])[codes]
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts[:-1][codes] - (ends - lengths), lengths)
    return values[np.arange(n) + shift], ends
