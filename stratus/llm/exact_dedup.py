"""Exact duplicates by an index of live digests behind a cuckoo filter.

1. Every row becomes a key: its text's SHA-256.  Texts stay where they are.
2. Each input partition adds its keys to an index of its own (:class:`LiveDigests`), bounded by evicting
   the oldest digests, and hands on one row per digest.  A text that a third of all rows share leaves a
   partition once, not once a row.
3. The digests are dealt to shards.  A shard's index takes them in: the filter answers for new ones, a hit
   is verified against the whole digests stored in its bucket, overflow builds a larger filter from them.
4. Hits are verified against content: the texts of digests with two rows or more are grouped by
   (digest, text), combined before they are shuffled.  Which texts have to move is told by a bitmap of
   fixed size.  A digest that stands for several texts is split by text.
5. The groups are joined back to the keys; digests with over a thousandth of all rows, at most 1000, by broadcast.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import join_uneven, keep, partitions
from stratus.llm.cuckoo import LiveDigests

LOCAL_DIGESTS = 50_000      # live digests of one input partition's index
SHARD_DIGESTS = 200_000     # keys dealt to one shard, about
MARK_BITS = 1 << 23         # bits of the bitmap of repeated digests: at most 256 rows of 4 KB

_PARTIAL = "digest binary, rows long, id long, row long"
_ARROW_LIVE = pa.schema([("digest", pa.binary()), ("rows", pa.int64())])
_ARROW = pa.schema([("digest", pa.binary()), ("rows", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])


def _top(id_: int | None, row: int) -> tuple:
    return (id_ is not None, id_ or 0, row)


def _batch(entries) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "digest": [x.digest for x in entries], "rows": [x.rows for x in entries],
        "id": [x.top[1] if x.top[0] else None for x in entries], "row": [x.top[2] for x in entries]}, schema=_ARROW)


def _merge(limit: int | None):
    """mapInArrow function: rows of ``_PARTIAL`` through one index, out with one row per live digest."""

    def run(batches):
        index = LiveDigests(limit=limit)
        for batch in batches:
            for digest, rows, id_, row in zip(*(c.to_pylist() for c in batch.columns)):
                index.add(digest, rows, _top(id_, row))
                if index.overfull:
                    yield _batch(index.evict())
        for entries in index.slices():
            yield _batch(entries)

    return run


def live_digests(keys: DataFrame) -> DataFrame:
    """(digest, rows, id, row) of every distinct digest of ``keys`` (digest, id, row): its rows and the largest (id, row)."""
    spark = keys.sparkSession
    shards = max(partitions(spark), math.ceil(keys.count() / SHARD_DIGESTS))
    local = keys.select("digest", F.lit(1).cast("long").alias("rows"), "id", "row").mapInArrow(_merge(LOCAL_DIGESTS), _PARTIAL)
    return local.repartition(shards, "digest").mapInArrow(_merge(None), _PARTIAL)


def update_live(live: DataFrame, added: DataFrame, removed: DataFrame, text_col: str = "text") -> DataFrame:
    """The index after a batch: (digest, rows) of the digests that live on.

    ``live`` is (digest, rows), from an earlier call or from :func:`live_digests`; the rows of ``removed`` are taken
    away first, then those of ``added`` put in.  A digest whose last row goes is deleted from its shard's filter;
    removing a text that is not live does nothing.  A null text counts as empty.
    """
    spark = live.sparkSession

    def signed(df, rows):
        text = F.coalesce(df[f"`{text_col}`"].cast("string"), F.lit(""))
        return df.select(F.unhex(F.sha2(text, 256)).alias("digest")).groupBy("digest").agg((F.count(F.lit(1)) * rows).alias("rows"))

    def run(batches):
        index = LiveDigests()
        for batch in batches:
            for step, digest, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if step == 1:
                    index.remove(digest, -rows)
                else:
                    index.add(digest, rows, ())
        for entries in index.slices():
            yield pa.RecordBatch.from_pydict({"digest": [x.digest for x in entries], "rows": [x.rows for x in entries]}, schema=_ARROW_LIVE)

    steps = [live.select("digest", "rows"), signed(removed, -1), signed(added, 1)]
    changes = steps[0].select(F.lit(0).alias("step"), "digest", "rows")
    for k, df in enumerate(steps[1:], 1):
        changes = changes.unionByName(df.select(F.lit(k).alias("step"), "digest", "rows"))
    shards = max(partitions(spark), math.ceil(live.count() / SHARD_DIGESTS))
    return changes.repartition(shards, "digest").sortWithinPartitions("step").mapInArrow(run, "digest binary, rows long")


def _mark(digest: str) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(MARK_BITS))


def texts_of_repeated(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct (digest, text) of ``texts`` whose digest has several rows in ``groups``.

    The bitmap only spares moving texts that stand alone: one it lets through by chance is filtered out afterwards.
    """
    repeated = groups.filter("rows > 1").select("digest")
    marks = repeated.select(_mark("digest").alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    rows = texts.select("digest", "text", _mark("digest").alias("bit")) \
        .select("digest", "text", F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("place"))
    # At most MARK_BITS / 32768 rows of 4 KB.
    rows = rows.join(F.broadcast(marks), "bucket").filter(
        "shiftright(cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) & 1 = 1")
    return rows.select("digest", "text").distinct().join(repeated, "digest", "left_semi")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """Every row's group of equal texts; of each group the row with the largest id stays.

    Returns ``id_col``, keep_id, group_size, kept, text_sha256 (lowercase hex), one row per row of ``docs``.
    A null text counts as empty, and both are one group.  A null id is smaller than any other; keep_id is null
    if no id of the group is known.  Of rows repeated with the largest id exactly one stays.  Other
    columns, whatever their names, play no part; an empty table gives no rows.  ``digest_bytes`` shortens the digest the index
    works with (tests: so that different texts meet); the result does not depend on it.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    sha = F.unhex(F.sha2(text, 256))
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), sha.alias("sha"), text.alias("text")) \
        .withColumn("digest", F.expr(f"substring(sha, 1, {digest_bytes})"))
    keys = keep(rows.select("id", "sha", "digest", F.monotonically_increasing_id().alias("row")), "dedup-keys")
    groups = keep(live_digests(keys), "dedup-groups")

    several = texts_of_repeated(rows, groups).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    several = keep(several.select("digest"), "dedup-collisions")
    if not several.isEmpty():
        # Different texts under one digest: another, longer digest of the text tells them apart.
        split = rows.join(several, "digest", "left_semi") \
            .select("id", "sha", F.unhex(F.sha2("text", 512)).alias("digest"), F.monotonically_increasing_id().alias("row"))
        keys = keep(keys.join(several, "digest", "left_anti").select(*split.columns).unionByName(split), "dedup-keys")
        groups = keep(live_digests(keys), "dedup-groups")

    found = join_uneven(keys, groups.select("digest", F.col("rows").alias("group_size"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row")),
                        ["digest"], "group_size")
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"))
