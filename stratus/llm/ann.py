"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe, reranked exactly.

A unit vector is padded to a power of two, turned by a pseudo-rotation (three rounds of random
signs and a fast Hadamard transform) and hashed to the nearest signed axis.  A
table's hash joins such an axis with one of a second rotation projected to
fewer dimensions; that number of dimensions grows with the number of rows,
so that cells keep about ``cell_rows`` rows.  Queries look into the best cells of each of the ``tables``;
what they meet is reranked by the exact cosine.

How many cells that takes depends on the rows and on how they lie.  It is measured in each run: a sample of the queries
is compared with all vectors, and the probes are as many as the sample needs to find the share ``recall`` of its true neighbours.

What is moved are copies of vectors: one per table for every row, one per table and probe for every query.  A few tables with
large cells move least for the same recall.  Vectors that are exact in single precision travel in it.

Equal vectors are indexed once, with the ``k + 1`` smallest of their ids, which is all that k
neighbours can use, so a large group of copies is one candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratus.llm.common import keep

TABLES = 4
PROBES = 8
CELL_ROWS = 256
BLOCK_ROWS = 4096
# The contract is 0.9; the rest is room for the error of the sample.
RECALL = 0.95
SAMPLE = 256
SAMPLE_BLOCK_ROWS = 1024
# Elements of the arrays made at a time, and rows of the batches while queries are put into cells.
ELEMENTS = 1 << 21
EPSILON = np.finfo(float).eps
PLACED_ROWS = 1 << 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of every row (length a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, part: int, seed: int) -> np.ndarray:
    """Pseudo-rotation number (table, part): three rounds of signs and Hadamard."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([seed, table, part, d]).integers(0, 2, (3, d)) * 2 - 1
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(x: np.ndarray) -> np.ndarray:
    """Score of each signed axis: x for the positive ones, then -x."""
    return np.concatenate([x, -x], axis=1)


def cells(x: np.ndarray, table: int, second: int, probes: int, seed: int) -> np.ndarray:
    """The ``probes`` best cells of every unit row in a table, best first (fewer columns if there are fewer cells).

    A cell is (signed axis of the whole rotation, signed axis of the first ``second``
    dimensions of another); cells are ranked by the sum of squared shortfalls from the nearest axes.
    """
    a = axes(rotated(x, table, 0, seed))
    na = min(a.shape[1], probes)
    ia = np.argsort(-a, axis=1, kind="stable")[:, :na]
    top = np.take_along_axis(a, ia, 1)
    if not second:
        return ia
    b = axes(rotated(x, table, 1, seed)[:, :second])
    nb = min(b.shape[1], probes)
    ib = np.argsort(-b, axis=1, kind="stable")[:, :nb]
    bot = np.take_along_axis(b, ib, 1)
    loss = ((top[:, :1] - top) ** 2)[:, :, None] + ((bot[:, :1] - bot) ** 2)[:, None, :]
    best = np.argsort(loss.reshape(len(x), -1), axis=1, kind="stable")[:, :probes]
    i, j = best // nb, best % nb
    return np.take_along_axis(ia, i, 1) * (2 * second) + np.take_along_axis(ib, j, 1)


def second_dimensions(rows: int, d: int, cell_rows: int) -> int:
    """Dimensions of the second axis so that a table has about ``rows / cell_rows`` cells (0: one axis is enough)."""
    full = 1 << max(0, (d - 1).bit_length())
    want = rows / cell_rows / (2 * full)
    return 0 if want <= 1 else int(min(full, np.ceil(want / 2)))


def needed_probes(x: np.ndarray, y: np.ndarray, table: int, second: int, seed: int) -> np.ndarray:
    """The probes with which row i of ``x`` meets row i of ``y`` in a table (unit rows; cells of equal rank are counted in)."""
    def shortfalls(part: int, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
        a, b = (axes(rotated(z, table, part, seed)[:, :dims]) for z in (x, y))
        loss = (a.max(axis=1, keepdims=True) - a) ** 2
        return np.sort(loss, axis=1), np.take_along_axis(loss, b.argmax(axis=1)[:, None], 1)

    top, own = shortfalls(0, None)
    if not second:
        return (top <= own + 1e-12).sum(axis=1)
    bot, also = shortfalls(1, second)
    left = own + also - top + 1e-12
    return np.array([np.searchsorted(b, row, side="right").sum() for b, row in zip(bot, left)], np.int64)


def _units(x: np.ndarray) -> np.ndarray:
    # Halving exponents first keeps the squares of huge and tiny components finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _in_blocks(asking: DataFrame, held: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of _meet() for comparing all of ``asking`` with all of ``held``, in blocks."""
    flat = lambda df, *more: df.select("key", *more, "raw", "d", F.lit(-1).alias("t"))
    every = flat(held, "ids").withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    few = flat(asking).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return few, every


def wanted_probes(queries: DataFrame, index: DataFrame, n: int, k: int, tables: int, cell_rows: int, seed: int,
                  recall: float, sample: int) -> dict[int, int]:
    """By length of vector, the probes at which a sample of the queries finds the share ``recall`` of its true neighbours.

    Up to ``sample`` queries of every length, the first by a hash, are compared with all vectors.  A neighbour is found
    when its cell is among those looked into in one of the tables.  A query's own vector does not count.
    """
    nth = F.row_number().over(W.partitionBy("d").orderBy(F.xxhash64("key"), "key"))
    some = keep(queries.select("key", "raw", "d").withColumn("nth", nth).filter(F.col("nth") <= sample).drop("nth"), "ann-sample")
    met = _meet(*_in_blocks(some, index, max(1, -(-n // SAMPLE_BLOCK_ROWS))), k).filter(F.col("other") != F.col("key"))
    once = met.groupBy("key", "other").agg(F.min("loss").alias("loss"))
    best = once.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("loss", "other"))).filter(F.col("nth") <= k)
    pairs = best.select("key", "other").join(some, "key").join(index.select(F.col("key").alias("other"), F.col("raw").alias("w")), "other")

    def count(batches):
        for batch in batches:
            size = batch.column("d").to_numpy()
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                step = max(1, ELEMENTS // (4 << max(0, int(d - 1).bit_length())))
                for at in range(0, part.num_rows, step):
                    x, y = (_units(unpacked(part.slice(at, step).column(c).to_pylist(), int(d))) for c in ("raw", "w"))
                    second = second_dimensions(n, int(d), cell_rows)
                    need = np.min([needed_probes(x, y, t, second, seed) for t in range(tables)], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d), pa.int32()), pa.array(need, pa.int64())], names=["d", "need"])

    # Where only copies are near, any probe finds them.
    least = some.select("d", F.lit(1).cast("long").alias("need")).distinct()
    need = pairs.select("raw", "w", "d").mapInArrow(count, "d int, need long").unionByName(least).groupBy("d").agg(F.sort_array(F.collect_list("need")).alias("need"))
    last = F.greatest(F.lit(1), F.ceil(F.size("need") * F.lit(recall))).cast("int")
    return {r.d: r.probes for r in need.select("d", F.element_at("need", last).alias("probes")).collect()}


def nearest(vectors: DataFrame, query_ids: Column, k: int = 5, tables: int = TABLES, probes: int = PROBES, cell_rows: int = CELL_ROWS,
            seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found of every query row.

    ``query_ids`` is a condition on the column ``id``; candidates are all other rows.  The score is the
    cosine in double precision on the original vectors; ties go to the smaller id.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor rows with a null id.
    A row whose id repeats is a candidate for its namesakes' queries only under another id.  An id with several vectors is a
    neighbour once, with the nearest of them; as a query it has ``k`` neighbours for each of its vectors.
    ``probes`` is the least number of cells looked into in a table; there are as many as a sample of ``sample`` queries
    needs to find the share ``recall`` of its true neighbours.
    Queries that meet fewer than ``k`` candidates in their cells are compared with all vectors, in
    blocks of rows, so that every query gets ``min(k, candidates)`` neighbours.  Vectors
    of different lengths are never neighbours.  An empty table gives no rows.
    """
    v = F.transform(vectors[f"`{vector_col}`"], lambda x: x.cast("double"))
    usable = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    # Vectors as bytes: equal ones are equal bytes.  Zeros of either sign are equal.
    rows = _raw(usable.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))).withColumn("asked", query_ids).distinct()
    vector = ["raw", "d"]
    # Spark keeps at most k + 1 rows of a vector per task before it moves them.
    nth = F.row_number().over(W.partitionBy(*vector).orderBy("id"))
    index = keep(rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy(*vector)
                 .agg(F.sort_array(F.collect_list("id")).alias("ids"))
                 .withColumn("key", F.monotonically_increasing_id()), "ann-index")
    asked = keep(rows.filter("asked").select("id", *vector), "ann-asked")
    queries = keep(asked.select(*vector).distinct().join(index.select(*vector, "key"), vector), "ann-queries")
    n = index.count()
    looked = {d: max(probes, p) for d, p in wanted_probes(queries, index, n, k, tables, cell_rows, seed, recall, sample).items()}

    def in_cells(df: DataFrame, probe: dict[int, int]) -> DataFrame:
        payload = [c for c in df.columns if c not in ("raw", "d")]
        fields = ", ".join(f"{c} {t}" for c, t in df.select(*payload).dtypes)

        def place(batches):
            for batch in batches:
                size = batch.column("d").to_numpy()
                for d in np.unique(size):
                    if int(d) not in probe:
                        continue
                    most, second = probe[int(d)], second_dimensions(n, int(d), cell_rows)
                    ranked = min(2 << int(d - 1).bit_length(), most) * (min(2 * second, most) or 1)
                    step = max(1, min(ELEMENTS // ranked, PLACED_ROWS // most))
                    same = batch.filter(pa.array(size == d))
                    for at in range(0, same.num_rows, step):
                        part = same.slice(at, step)
                        raw = part.column("raw")
                        unit = _units(unpacked(raw.to_pylist(), int(d)))
                        for t in range(tables):
                            own = cells(unit, t, second, most, seed)
                            take = pa.array(np.repeat(np.arange(len(unit)), own.shape[1]))
                            m = len(take)
                            yield pa.RecordBatch.from_arrays(
                                [*[part.column(c).take(take) for c in payload], raw.take(take), pa.array(np.full(m, d), pa.int32()),
                                 pa.array(np.full(m, t), pa.int32()), pa.array(own.ravel(), pa.int64())], names=[*payload, "raw", "d", "t", "cell"])

        return df.mapInArrow(place, f"{fields}, raw binary, d int, t int, cell long")

    met = _meet(in_cells(queries.select("key", "raw", "d"), looked), in_cells(index.select("key", "ids", "raw", "d"), dict.fromkeys(looked, 1)), k)
    best = keep(_best(met, k), "ann-best")
    # Every query meets itself; whoever meets too few others is compared with all, in blocks.
    blocks = max(1, -(-n // BLOCK_ROWS))
    short = queries.select("key", "raw", "d").join(best.filter(F.size("near") > k), "key", "left_anti")
    if not short.isEmpty():
        late = _best(_meet(*_in_blocks(short, index, blocks), k), k)
        best = best.join(late.select("key"), "key", "left_anti").unionByName(late)
    answer = asked.join(queries, vector).join(best, "key").select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)))
    return answer.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias(id_col), (-F.col("col.loss")).alias("score"))


def packed(x: np.ndarray) -> bytes:
    """A vector's bytes, in single precision where that is exact."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return single.tobytes() if (single == x).all() else x.tobytes()


def unpacked(raw: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(raw), d))
    for i, data in enumerate(raw):
        out[i] = np.frombuffer(data, np.float32 if len(data) == 4 * d else np.float64)
    return out


def _raw(df: DataFrame) -> DataFrame:
    """(id, raw, d) of rows (id, v): the vector as bytes, and its length."""
    def pack(batches):
        for batch in batches:
            column = batch.column("v")
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([packed(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                                              pa.array(np.diff(ends), pa.int32())], names=["id", "raw", "d"])

    return df.mapInArrow(pack, "id long, raw binary, d int")


def _meet(asking: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(key of the query, key of the vector, id, loss = -cosine): in each cell, the best ``k + 1`` ids of every query.

    The best are those of the least loss, and of equal losses the smaller ids, however many are equal.  An id that
    stands at several vectors counts once, with the best of them.

    A cell's rows on either side are cut into blocks, so that no group holds more than about ``BLOCK_ROWS`` rows of
    each; every block of queries meets every block of vectors.
    """
    place = ["d", "t", "cell"]
    sizes = asking.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("nq")) \
        .join(held.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("ni")), place)
    sizes = keep(sizes, "ann-cells")
    again = sizes.select(*[F.col(c).alias(c) for c in sizes.columns])  # both sides of the cogroup need columns of their own
    q = asking.join(sizes, place).withColumn("bq", F.pmod(F.xxhash64("key"), F.col("nq"))) \
        .withColumn("bi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1)))
    i = held.join(again, place).withColumn("bi", F.pmod(F.xxhash64("key"), F.col("ni"))) \
        .withColumn("bq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)))
    group = [*place, "bq", "bi"]

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("id", pa.int64()), ("loss", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, y = (unpacked(side.column("raw").to_pylist(), side.column("d")[0].as_py()) for side in (left, right))
        x, y = (z / np.exp2(np.floor(np.log2(np.abs(z).max(axis=1, keepdims=True)))) for z in (x, y))  # exact
        nx, ny = (np.sqrt((z * z).sum(axis=1)) for z in (x, y))
        keys, others, ids = left.column("key").to_numpy(), right.column("key").to_numpy(), right.column("ids").combine_chunks()
        # One column for every vector and id, in the order of the ids.
        at_vector, ids = np.repeat(np.arange(len(y)), pc.list_value_length(ids).to_numpy()), ids.flatten().to_numpy()
        by_id = np.argsort(ids, kind="stable")
        at_vector, ids = at_vector[by_id], ids[by_id]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        m, d = min(k + 1, len(starts)), x.shape[1]
        few = max(1, ELEMENTS // d)
        out = []
        for at in range(0, len(x), 256):
            rough = (-(x[at:at + 256] @ y.T) / ny)[:, at_vector]
            of_id = rough if len(starts) == len(ids) else np.minimum.reduceat(rough, starts, axis=1)
            # Whatever rounding may have put behind the m-th is kept, and with it all that tie.
            border = np.partition(of_id, m - 1, axis=1)[:, m - 1] + 8 * d * EPSILON * nx[at:at + 256]
            own, pick = np.nonzero(rough <= border[:, None])
            own, pick, named = own + at, at_vector[pick], ids[pick]
            # Summed row by row, so that a score does not hang on what else is in the block.
            loss = np.concatenate([-(x[o] * y[p]).sum(axis=1) / (nx[o] * ny[p])
                                   for o, p in ((own[i:i + few], pick[i:i + few]) for i in range(0, len(own), few))])
            order = np.lexsort((loss, named, own))
            own, pick, named, loss = own[order], pick[order], named[order], loss[order]
            once = np.append(True, (own[1:] != own[:-1]) | (named[1:] != named[:-1]))
            own, pick, named, loss = own[once], pick[once], named[once], loss[once]
            order = np.lexsort((named, loss, own))
            best = order[np.arange(len(own)) - np.searchsorted(own, own) < m]
            out.append((keys[own[best]], others[pick[best]], named[best], loss[best]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return q.groupBy(*group).cogroup(i.groupBy(*group)).applyInArrow(rank, "key long, other long, id long, loss double")


def _best(met: DataFrame, k: int) -> DataFrame:
    """(key, near): each query's best ``k + 1`` ids as structs (loss, id), best first."""
    once = met.groupBy("key", "id").agg(F.min("loss").alias("loss"))
    ranked = once.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("loss", "id"))).filter(F.col("nth") <= k + 1)
    return ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("loss", "id"))).alias("near"))
