"""Best-fit packing with large-item matching.

Only the number of items of each length matters for where lengths go, so the
packing is worked out on a histogram (at most ``capacity`` lengths) whatever
the number of items.  Items above a third of the capacity come at most twice
into a bin: they are matched greedily, the longest first, each with the longest
partner that still fits.  The others follow, longest first, each into the
smallest gap that holds it.  Every decision moves as many equal items into as many
equal bins as there are; the resulting *moves* are turned into places by the
items' numbers within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.llm.common import keep, numbered
from stratus.llm.tokens import crc, encode_texts


@dataclass(frozen=True)
class Move:
    """Items ``item .. item + bins * each - 1`` of a length go to bins from ``bin`` on, ``each`` to a bin, at ``offset``."""

    length: int
    item: int
    bin: int
    bins: int
    each: int
    offset: int


def pack_histogram(counts: dict[int, int], capacity: int) -> list[Move]:
    """Moves that place every item; ``counts`` maps a length (1 to capacity) to its number of items."""
    moves: list[Move] = []
    placed: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first bin, bins)
    order: list[int] = []
    bins = 0

    def put(length: int, first: int, n: int, each: int, gap: int) -> None:
        moves.append(Move(length, placed[length], first, n, each, capacity - gap))
        placed[length] += n * each
        if rest := gap - length * each:
            if not gaps[rest]:
                insort(order, rest)
            gaps[rest].append((first, n))

    def take(gap: int, most: int) -> tuple[int, int]:
        first, n = gaps[gap].pop()
        if n > most:
            gaps[gap].append((first + most, n - most))
        if not gaps[gap]:
            order.pop(bisect_left(order, gap))
        return first, min(n, most)

    def fresh(n: int) -> int:
        nonlocal bins
        bins += n
        return bins - n

    left = {k: n for k, n in counts.items() if n}
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        fit = bisect_left(large, capacity - a + 1) - 1
        b = large[fit] if fit >= 0 else 0
        n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        if a == b and n == 0:  # the last of its length: its partner is the next shorter one
            b, n = (large[fit - 1], 1) if fit else (0, 1)
        first = fresh(n)
        if a == b:
            put(a, first, n, 2, capacity)
        elif b:
            moves.append(Move(a, placed[a], first, n, 1, 0))
            placed[a] += n
            put(b, first, n, 1, capacity - a)
            left[b] -= n
        else:
            put(a, first, n, 1, capacity)
        left[a] -= 2 * n if a == b else n
        large = [k for k in large if left[k]]
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[k]:
            at = bisect_left(order, k)
            if at < len(order):
                gap = order[at]
                each = min(gap // k, left[k])
                first, n = take(gap, max(1, left[k] // each))
            else:
                gap = capacity
                each = min(gap // k, left[k])
                n = left[k] // each
                first = fresh(n)
            put(k, first, n, each, gap)
            left[k] -= n * each
    return moves


PIECE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("row", T.LongType(), False), T.StructField("piece", T.IntegerType(), False),
    T.StructField("start", T.LongType(), False), T.StructField("length", T.IntegerType(), False),
    T.StructField("ids_crc32", T.LongType(), False), T.StructField("ids", T.BinaryType())])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids (and ``end_id``) cut into pieces of at most ``capacity`` ids."""

    def cut(batches):
        import numpy as np
        for batch in batches:
            keys, rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            out = {f.name: [] for f in PIECE.fields}

            def flush():
                done = pa.RecordBatch.from_pydict(out, schema=ARROW_PIECE)
                for v in out.values():
                    v.clear()
                return done

            for i, ids in encode_texts(texts, tokenizer):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    for name, v in zip(out, (keys[i], rows[i], k, at, len(part), crc(part), part.tobytes() if with_ids else None)):
                        out[name].append(v)
                if len(out["id"]) >= 4096:
                    yield flush()
            yield flush()

    return docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                       docs[f"`{text_col}`"].alias("text")).mapInArrow(cut, PIECE)


ARROW_PIECE = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                         ("length", pa.int32()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents' ids into few sequences of at most ``capacity`` ids.

    Returns one row per piece: ``id_col``, row (the document's row, so that
    rows with equal ids stay apart), piece, start, length, ids_crc32, ids
    (little-endian unsigned 32-bit, if ``with_ids``), sequence_id, offset.
    A document's ids end with ``end_id``; only documents of more than
    ``capacity`` ids are cut.  A null or empty text is the end id alone; null and
    repeated ids are kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = keep(token_pieces(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col), "pieces")
    # At most one row per possible length.
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    moves = pack_histogram(counts, capacity)
    firsts, at = {}, 0
    for length in sorted(counts):
        firsts[length], at = at, at + counts[length]
    number = numbered(pieces.select("length", "id", "row", "piece"), ["length", "id", "row", "piece"], {}, "number", "lengths")
    # Moves do not grow with the items: each uses up a length, a run of equal bins, or splits one.
    plan = spark.createDataFrame(
        [(m.length, firsts[m.length] + m.item, firsts[m.length] + m.item + m.bins * m.each, m.bin, m.each, m.offset) for m in moves],
        "m_length int, m_from long, m_to long, m_bin long, m_each long, m_offset long")
    runs = plan.groupBy("m_length").agg(F.array_sort(F.collect_list(F.struct("m_from", "m_to", "m_bin", "m_each", "m_offset"))).alias("runs"))
    placed = number.join(F.broadcast(runs), F.col("length") == F.col("m_length"))
    run = F.filter("runs", lambda r: (r["m_from"] <= F.col("number")) & (F.col("number") < r["m_to"]))[0]
    nth = F.col("number") - F.col("run.m_from")
    places = placed.withColumn("run", run).select(
        "row", "piece",
        (F.col("run.m_bin") + F.floor(nth / F.col("run.m_each"))).cast("long").alias("sequence_id"),
        (F.col("run.m_offset") + (nth % F.col("run.m_each")) * F.col("length")).cast("long").alias("offset"))
    return pieces.join(places, ["row", "piece"]).select(
        F.col("id").alias(id_col), "row", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "ids",
        "sequence_id", "offset")
