"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are put into a seeded random order and cut into blocks of
equal word shares.  Its target gives a number of whole passes and a rest; all blocks of the whole passes and those of the
rest, the last of them cut at the document nearest to the target, are the source's quota.
A binary tree splits the quotas of all sources among the output shards: at every
node, the blocks going left are drawn without replacement, so that the left child's
quotas follow the multivariate hypergeometric law and every block of every pass has
exactly one shard.  A shard's blocks of a source are consecutive in its passes through the random order,
hence disjoint within a pass; each shard shuffles its own documents by a place of their own.

Only DataFrame and SQL functions are used.  Words and digests are worked out once, into a narrow table.  The random order is a digest, so
its ranges are known beforehand: rows are dealt by (source, first digits of the digest), which cuts a large source into as many
pieces as there are partitions, and a piece's totals come from one row per source and range.  The tree works on blocks, at most
a few hundred per source, in groups of ``GROUP_SOURCES`` sources.  What passes through one task is a row per source, for their targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratus.llm.common import keep, partitions

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCKS = 64
SHARD_LEVELS = 4
GROUP_SOURCES = 1000
PLACE_DIGITS = 16


def words_in(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII white-space ones (null: 0)."""
    flat = F.trim(F.regexp_replace(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " +", " "))
    return F.coalesce(F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "))) + 1), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target of every source (columns s_null, s, source_size): its weight's share of all words, at most ``cap`` times its size.

    The excess goes to the others by weight until none is above.  Sources are
    filled in the order of cap / weight; the level at which all others stay below their cap is the share of one unit of weight.
    """
    every = W.orderBy("s_null", "s")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = W.orderBy("ratio", "s_null", "s").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = totals.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(cap).cast("long")) \
        .withColumn("ratio", F.col("most") / F.col("weight"))
    t = t.select("*", F.sum("source_size").over(whole).alias("all_size"), F.sum("weight").over(whole).alias("all_weight"),
                 F.sum("most").over(first).alias("full"), F.sum("weight").over(first).alias("full_weight"))
    # The level if exactly the sources before this one are full.
    t = t.withColumn("level", (F.col("all_size") - (F.col("full") - F.col("most"))).cast("double") / (F.col("all_weight") - (F.col("full_weight") - F.col("weight"))))
    # It rises while sources fill up and never again after, so the largest is the right one.
    level = F.max("level").over(whole)
    return t.withColumn("unit", level).select("s_null", "s", "source_size",
                                              F.least(F.col("most").cast("double"), F.col("unit") * F.col("weight")).alias("target"))


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """Splits every source's quota of blocks (columns s_null, s, quota) among ``2 ** levels`` shards.

    Returns (s_null, s, bounds): the blocks numbered from bounds[k] (included) to
    bounds[k + 1] (left out) go to shard k.  A node hands its left child half of its
    blocks, those that come first in a random order of its own: a draw without replacement, so the numbers of blocks by source
    have their multivariate hypergeometric law.  The draws hang on the seed alone.  Sources beyond ``GROUP_SOURCES`` get trees of their own.
    """
    group = F.floor((F.row_number().over(W.orderBy("s_null", "s")) - 1) / GROUP_SOURCES)
    sources = quotas.select("s_null", "s", "quota", group.alias("tree"))
    blocks = sources.filter("quota > 0").select("s_null", "s", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("block"), F.lit(0).alias("node"))
    for level in range(levels):
        draw = F.md5(F.concat_ws("|", F.lit(f"{seed}|{level}"), "node", F.col("s_null").cast("int"), "s", "block"))
        inside = W.partitionBy("tree", "node")
        nth, size = F.row_number().over(inside.orderBy("draw", "s_null", "s", "block")), F.count(F.lit(1)).over(inside)
        blocks = blocks.withColumn("draw", draw).withColumns({"nth": nth, "size": size}) \
            .select("s_null", "s", "tree", "block", (F.col("node") * 2 + F.when(F.col("nth") <= F.floor(F.col("size") / 2), 0).otherwise(1)).alias("node"))
    shares = blocks.groupBy("s_null", "s").agg(*[F.count_if(F.col("node") == k).alias(f"n{k}") for k in range(2 ** levels)])
    counts = F.array(*[F.coalesce(f"n{k}", F.lit(0)).cast("long") for k in range(2 ** levels)])
    out = sources.select("s_null", "s").join(shares, ["s_null", "s"], "left").select("s_null", "s", counts.alias("each"))
    return out.select("s_null", "s", F.expr("aggregate(each, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))").alias("bounds"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, blocks: int = BLOCKS, levels: int = SHARD_LEVELS,
                seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """How often every row is taken so that sources come near their target words.

    Returns ``id_col``, the ``carry`` columns, mix_source, size (words), source_size, target,
    taken (words taken of the row, repeats counted), passes (times it is taken), order (its place in the random order)
    and, one for each time it is taken, shards (output shards) and places (their order within a shard).
    Sources are ordered by code point, null last, and
    weigh ``weights`` in turn.  A null source is a source; null, empty and white-space texts have no words and are
    never taken; rows with equal or null ids are rows of their own; an empty table gives no
    rows.  The random order depends on the seed, id and text only, so that reruns agree.
    """
    spark = docs.sparkSession
    text, source = docs[f"`{text_col}`"], docs[f"`{source_col}`"]
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), docs[f"`{id_col}`"].cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    part = F.expr(f"cast(conv(substring(order, 1, 7), 16, 10) as long) * {partitions(spark)} div {1 << 28}")
    table = keep(docs.select(docs[f"`{id_col}`"].alias("id"), *[docs[f"`{c}`"].alias(f"c_{c}") for c in carry],
                             source.isNull().alias("s_null"), F.coalesce(source, F.lit("")).alias("s"), words_in(text).alias("size"),
                             order.alias("order")).withColumn("part", part), "mix-rows")
    key = ["s_null", "s"]
    # One row per range of the order and source.
    shares = keep(table.groupBy("part", *key).agg(F.sum("size").alias("share")), "mix-shares")
    totals = shares.groupBy(*key).agg(F.sum("share").alias("source_size"))
    targets = source_targets(totals, weights, cap).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)) \
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")) \
        .withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(blocks)))) \
        .withColumn("pass_blocks", F.ceil(F.col("source_size") / F.col("block"))) \
        .withColumn("quota", (F.col("whole") * F.col("pass_blocks") + F.ceil(F.col("rest") / F.col("block"))).cast("long"))
    targets = keep(targets, "mix-targets")
    plan = targets.join(split_quotas(targets, levels, seed), key).drop("quota")
    before = F.coalesce(F.sum("share").over(W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_range = shares.withColumn("before", before).join(plan, key).drop("share")
    own = W.partitionBy("part", *key).orderBy("order", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = table.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0))).join(per_range, ["part", *key]) \
        .withColumn("start", F.col("before") + F.col("inside"))
    # The row belongs to the partial pass if more than half of it lies before the target.
    partial = (F.col("size") > 0) & (2 * F.col("start") + F.col("size") < 2 * F.col("rest"))
    passes = F.when(F.col("size") > 0, F.col("whole") + partial.cast("int")).otherwise(0).cast("int")
    numbers = "transform(if(passes > 0, sequence(0, passes - 1), cast(array() as array<int>)), p -> {})"
    # A block's number in all passes, and the shard whose bounds hold it.
    shards = numbers.format("size(filter(bounds, b -> b <= p * pass_blocks + start div block)) - 1")
    places = numbers.format(f"substring(md5(concat_ws('|', order, cast(p as string))), 1, {PLACE_DIGITS})")
    return placed.withColumn("passes", passes).select(
        F.col("id").alias(id_col), *[F.col(f"c_{c}").alias(c) for c in carry], F.when(~F.col("s_null"), F.col("s")).alias("mix_source"),
        "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "passes", "order",
        F.expr(shards).alias("shards"), F.expr(places).alias("places"))


def mixture(plan: DataFrame) -> DataFrame:
    """The mixture's rows, shuffled within each shard: every row of a plan as often as it is taken, with its shard and place.

    Rows lie in the order of (shard, place) within a partition; a shard is cut by the first digits of the place, which is a
    digest, so a large shard is written by many tasks and its pieces follow each other.
    """
    n = partitions(plan.sparkSession)
    copies = plan.select(*[c for c in plan.columns if c not in ("shards", "places")], F.explode(F.arrays_zip("shards", "places")).alias("_copy"))
    rows = copies.select(*copies.columns[:-1], F.col("_copy.shards").alias("shard"), F.col("_copy.places").alias("place"))
    piece = F.expr(f"cast(conv(substring(place, 1, 7), 16, 10) as long) * {n} div {1 << 28}")
    return rows.repartition(n, "shard", piece).sortWithinPartitions("shard", "place")
