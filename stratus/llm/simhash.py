"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 16 segments of 4 bits and mapped to the vector of
their bit counts (packed into one 64-bit number, 4 bits a count).  The Manhattan
distance of two such vectors never exceeds the fingerprints' bit distance, so
fingerprints at 2 or fewer differing bits have vectors at distance 2 or less.
Two such vectors meet in a grid point at most one step from either: every
fingerprint is put into its own grid cell and the cells one step away, and
only fingerprints that meet in a cell are compared.

Comparing within a cell is exact and makes no pairs: a fingerprint reaches a
cell by a step in one segment, so it can only meet another there in one of the at most
four bit patterns that this step can make (its own pattern for no step).  Two
fingerprints share a pattern if and only if they differ in 2 bits or fewer; a pattern
holds at most 65 fingerprints, whatever the size of a group.  Each is linked to the
smallest, after the bit distance has been checked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratus.llm.common import fresh, keep
from stratus.llm.graph import connected_components

SEED = 42
SEGMENTS = 16


def fingerprint(text: str | None, words: int) -> int:
    """Majority bits of the 64-bit hashes of a text's word shingles; 0 for a text without words."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begins, ends[words - 1:].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at:at + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, words: int = 3, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """Every row of ``docs``, its columns but the text, and its fingerprint as a signed 64-bit number."""

    def prints(batches):
        for batch in batches:
            values = [fingerprint(t.as_py(), words) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(values, np.uint64).view(np.int64))],
                                             names=[*batch.schema.names[:-1], name])

    other = [docs[f"`{c}`"] for c in docs.columns if c != text_col]
    schema = docs.select(*other).withColumn(name, F.lit(0).cast("long")).schema
    return docs.select(*other, docs[f"`{text_col}`"].alias("_text")).mapInArrow(prints, schema)


def segment_counts(fp: Column) -> Column:
    """The 16 segments' bit counts, 4 bits each."""
    bits = [F.shiftrightunsigned(fp, k).bitwiseAND(F.lit(0x1111111111111111)) for k in range(4)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def near_links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints (column fp) at ``bits`` or fewer differing bits.

    Any two at that distance are linked directly or through a third within that distance of both.
    """
    if bits not in (0, 1, 2):
        raise ValueError("the grid is one step wide: bits must be 0, 1 or 2")
    p = prints.select("fp", segment_counts(F.col("fp")).alias("at"))
    # A step: segment number 0 to 15, +1 or -1; segment -1 stands for no step.
    step = F.expr(f"""explode(concat(array(struct(-1 as s, 0 as d)),
        flatten(transform(sequence(0, {SEGMENTS - 1}), s -> array(struct(s as s, 1 as d), struct(s as s, -1 as d))))))""")
    count = F.expr("shiftrightunsigned(at, 4 * s) & 15L")
    cells = p.select("fp", "at", step.alias("t")).select("fp", "at", "t.s", "t.d") \
        .filter((F.col("s") < 0) | ((F.col("d") == 1) & (count < 4)) | ((F.col("d") == -1) & (count > 0))) \
        .select("fp", "s", "d", F.expr("at + if(s < 0, 0L, shiftleft(cast(d as bigint), 4 * s))").alias("cell"))
    met = cells.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("cell"))).filter("n > 1")
    # The patterns that the step can make: one of the segment's bits set or cleared.
    patterns = F.expr("""if(s < 0, array(fp), transform(filter(sequence(0, 3), k -> (shiftrightunsigned(fp, 4 * s + k) & 1L) = if(d = 1, 0L, 1L)),
        k -> fp ^ shiftleft(1L, 4 * s + k)))""")
    groups = met.select("cell", "fp", F.explode(patterns).alias("pattern")).groupBy("cell", "pattern") \
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return groups.select("a", F.explode("members").alias("b")).filter((F.col("a") != F.col("b")) & (far <= bits)).distinct() \
        if bits == 2 else _close(groups, bits)


def _close(groups: DataFrame, bits: int) -> DataFrame:
    """Fewer than 2 bits: members of a pattern (at most 65) are compared with each other."""
    pair = groups.select("members", F.explode("members").alias("a")).select("a", F.explode("members").alias("b"))
    return pair.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).distinct()


def fingerprint_components(prints: DataFrame, bits: int = 2) -> DataFrame:
    """(fp, root) of all distinct fingerprints (column fp); the root is the smallest of the component."""
    roots = connected_components(near_links(prints, bits))
    return prints.join(roots, prints.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint (16 lower-case hex digits) and component_id (the smallest id reachable) of every row.

    Fingerprints link at ``bits`` or fewer differing bits.  Null, empty and
    white-space texts have fingerprint zero, linked like any other; texts of fewer than
    ``words`` words are one shingle.  Rows with equal ids are kept; null ids are kept and never
    a component's smallest id, unless it has no other (then null).  An empty table gives no rows.
    """
    rows = keep(with_fingerprint(docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text")), words, name="fp"), "simhash")
    prints = keep(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    member = fingerprint_components(prints.select("fp"), bits).join(prints, "fp")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    component = keep(member.join(least, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(component, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component: that of the smallest id (null last), then of the smallest text digest.

    Rows equal in id and text are one document; of such rows that differ in other columns, the one whose other columns come
    first as JSON stays, so that reruns agree.  Columns are kept as they are, whatever their names.
    """
    digest = F.coalesce(F.md5(docs[f"`{text_col}`"].cast("binary")), F.lit(""))
    slim = docs.select(docs[f"`{id_col}`"].alias("id"), digest.alias("digest"), docs[f"`{text_col}`"].alias("text"))
    rows = keep(with_fingerprint(slim, words, name="fp"), "simhash")
    roots = fingerprint_components(rows.select("fp").distinct(), bits)
    best = rows.distinct().join(roots, "fp").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("best"))
    mark = fresh("_digest", docs.columns)
    chosen_id, chosen_digest = fresh("_chosen_id", docs.columns), fresh("_chosen_digest", docs.columns)
    chosen = best.select(F.col("best.id").alias(chosen_id), F.col("best.digest").alias(chosen_digest))
    marked = docs.withColumn(mark, digest)
    found = marked.join(chosen, marked[f"`{id_col}`"].eqNullSafe(chosen[chosen_id]) & (marked[mark] == chosen[chosen_digest]), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    one = found.groupBy(F.col(f"`{id_col}`").alias("k_id"), F.col(mark).alias("k_digest")).agg(F.min_by(F.struct(*columns), order).alias("row"))
    return one.select("row.*")
