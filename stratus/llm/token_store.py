"""Token-id store: concatenated id arrays whose document boundaries are Elias-Fano coded.

The store is a Parquet folder of *segments*; each holds the ids of consecutive
documents (by ascending id) as one blob, so that any file system Spark
writes to will do and lost tasks are written again.  A blob is

    8 bytes  magic "STIDS001"
    u8       bytes per id: 2 if all ids are below 65,536, else 4
    u32      leading documents without an id (null)
    i64      base of the document ids
    EF       document ids of the others, less the base
    EF       boundaries: the start of every document in the segment, and its end
    ids      little-endian unsigned
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import partitions
from stratus.llm.elias_fano import EliasFano
from stratus.llm.tokens import crc, encode_texts

MAGIC = b"STIDS001"
SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<8sBIq")

SEGMENT = "part int, start long, n_docs int, n_ids long, first_id long, last_id long, payload binary"
ARROW_SEGMENT = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("first_id", pa.int64()),
                           ("last_id", pa.int64()), ("payload", pa.binary())])


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    nulls = sum(d is None for d in doc_ids)
    known = [d for d in doc_ids if d is not None]
    base = known[0] if known else 0
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    return _HEAD.pack(MAGIC, width, nulls, base) + EliasFano.of(np.array([d - base for d in known], np.uint64)).to_bytes() + \
        EliasFano.of(bounds).to_bytes() + flat.astype(f"<u{width}").tobytes()


class Segment:
    """A segment read back; document k's ids are ``ids[k]``."""

    def __init__(self, payload: bytes):
        magic, width, self.nulls, self.base = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.docs, at = EliasFano.from_bytes(payload, _HEAD.size)
        self.bounds, at = EliasFano.from_bytes(payload, at)
        self.flat = np.frombuffer(payload, f"<u{width}", offset=at)

    def __len__(self) -> int:
        return self.bounds.n - 1

    def doc_id(self, k: int) -> int | None:
        return None if k < self.nulls else self.docs.select(k - self.nulls) + self.base

    def start(self, k: int) -> int:
        return self.bounds.select(k)

    def ids(self, k: int) -> np.ndarray:
        return self.flat[self.start(k):self.start(k + 1)]

    def places(self, doc_id: int) -> range:
        """The documents of that id, found by halving with ``select``."""
        at = range(self.docs.n)
        first = bisect_left(at, doc_id - self.base, key=self.docs.select)
        last = bisect_right(at, doc_id - self.base, lo=first, key=self.docs.select)
        return range(self.nulls + first, self.nulls + last)


def write_token_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the store, documents in ascending ``id_col``.

    A null or empty text is the end id alone; documents with a null id come first,
    those with equal ids in the order of their texts.  A segment closes
    once it holds ``segment_ids`` ids.
    """

    def write(batches):
        docs_in: list[int | None] = []
        ids_in: list[np.ndarray] = []
        part, start, held = 0, 0, 0

        def close():
            known = [d for d in docs_in if d is not None] or [None]
            return pa.RecordBatch.from_pydict({"part": [part], "start": [start], "n_docs": [len(docs_in)], "n_ids": [held],
                                               "first_id": [known[0]], "last_id": [known[-1]], "payload": [pack_segment(docs_in, ids_in)]}, schema=ARROW_SEGMENT)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for i, ids in encode_texts(batch.column(1), tokenizer):
                docs_in.append(keys[i])
                ids_in.append(np.append(ids, np.uint32(end_id)))
                held += len(ids) + 1
                if held >= segment_ids:
                    yield close()
                    start, held, docs_in, ids_in = start + held, 0, [], []
        if docs_in:
            yield close()

    n = partitions(docs.sparkSession)
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text", F.spark_partition_id().alias("part")) \
        .mapInArrow(write, SEGMENT).write.parquet(path)


def _starts(table: DataFrame) -> dict[int, int]:
    """Ids before each range of the writer: one row per range."""
    before, at = {}, 0
    for part, n in sorted(table.groupBy("part").agg(F.sum("n_ids")).collect()):
        before[part], at = at, at + n
    return before


def lookup_documents(spark: SparkSession, path: str, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, start, ids as little-endian unsigned 32-bit binary) of the documents of the given ids, a request of bounded length.

    Only segments whose span of ids holds one of them are read; in a segment a document is found by halving with ``select``
    and its boundaries are two more selects, so no table of boundaries is made.  Unknown ids give no row, repeated ones a row each.
    """
    table = spark.read.schema(SEGMENT).parquet(path)
    before = _starts(table)
    wanted = sorted(set(ids))
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        for batch in batches:
            out = []
            for part, start, first, last, payload in zip(*(c.to_pylist() for c in batch.columns)):
                seg = Segment(payload)
                for doc in wanted[bisect_left(wanted, first):bisect_right(wanted, last)]:
                    out += [(doc, before[part] + start + seg.start(k), seg.ids(k).astype("<u4").tobytes()) for k in seg.places(doc)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 3, schema)], schema=schema)

    # A few spans cover the request, so that Parquet's statistics can leave segments out.
    step = max(1, -(-len(wanted) // 16))
    spans = [(wanted[k], wanted[min(k + step, len(wanted)) - 1]) for k in range(0, len(wanted), step)]
    near = F.lit(False)
    for low, high in spans:
        near = near | ((F.col("first_id") <= high) & (F.col("last_id") >= low))
    return table.filter(near).select("part", "start", "first_id", "last_id", "payload").mapInArrow(read, "id long, start long, ids binary") \
        .withColumnRenamed("id", id_col)


def read_token_store(spark: SparkSession, path: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the store: ``id_col``, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    ``ids`` holds little-endian unsigned 32-bit ids if ``with_ids``, else null.
    An empty store gives no rows.
    """
    table = spark.read.schema(SEGMENT).parquet(path)
    before = _starts(table)

    def read(batches):
        schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for part, start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                seg = Segment(payload.as_py())
                bounds, flat = seg.bounds.values().astype(np.int64), seg.flat.astype("<u4")
                parts = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                known = (seg.docs.values().astype(np.int64) + seg.base).tolist()
                yield pa.RecordBatch.from_pydict({
                    "id": [None] * seg.nulls + known, "start": bounds[:-1] + (before[part] + start), "n_tokens": np.diff(bounds),
                    "ids_crc32": [crc(p) for p in parts], "ids": [p.tobytes() if with_ids else None for p in parts]}, schema=schema)

    return table.select("part", "start", "payload").mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long, ids binary") \
        .withColumnRenamed("id", id_col)
