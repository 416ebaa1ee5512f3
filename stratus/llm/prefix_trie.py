"""Conversation prefix trie: every distinct sequence of first turns is a node.

* **Digests.**  The first d turns of a conversation have the digest  sum of t_k * B**k mod 2**127 - 1,  t_k a number made of turn k's SHA-256.
  Digests of pieces add up, so turns are dealt by ranges of (conversation, place) and a long conversation is
  cut anywhere: what a piece adds is known from one row per cut conversation and range.
* **Nodes** are the distinct digests: one aggregate, combined before it is shuffled.
* **Segments.**  Along the path of a node's smallest member, the number of members falls right after a node at which conversations
  part or end, and only there.  So the nodes of equal (smallest member, number of members) are a chain whose last
  node alone has other than one child, or ends; a chain, however long, is one row.  There are at most two segments per distinct conversation.
* **Subtrees.**  Segments of prefixes that few conversations share hang below a cut; whole subtrees below cuts are dealt to shards.  A shard
  numbers its segments by a minimal perfect hash of their digests, each slot verified against the digest it keeps, scatters
  counts into flat arrays and adds them up through the array of parent slots, deepest first.  Above the cuts, where a
  segment has over 1/2000 of all conversations, the same sums take one join and aggregate per level.
* **Members that end at a node** are hashed in order of their ids: ranges of (node, id) are joined to texts, and the
  texts of a node run through one SHA-256, which cannot be split.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import join_uneven, keep, partitions
from stratus.llm.perfect_hash import PerfectHash, as_words

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:16], "big") % PRIME
CUT_MEMBERS = 200           # a subtree of at most so many members, or of CUT_SHARE of all, goes to one shard
CUT_SHARE = 2000
SHARD_SEGMENTS = 200_000
CHUNK_IDS = 50_000

_LOCAL = pa.schema([("conv_id", pa.int64()), ("range", pa.int32()), ("place", pa.int64()), ("chain", pa.binary()), ("before", pa.binary()),
                    ("total", pa.int64()), ("key", pa.binary()), ("bytes", pa.int64()), ("last", pa.bool_())])
_LOCAL_SQL = "conv_id long, range int, place long, chain binary, before binary, total long, key binary, bytes long, last boolean"


def _pieces(batches):
    """Rows (conv_id, key, bytes, range) sorted by conversation and place -> ``_LOCAL``, counted from the start of the range.

    ``last`` marks a conversation's last row in the range, so a row is handed on when the next one is known.
    """
    conv, place, power, chain, total, held = None, 0, 1, 0, 0, None
    out: list[tuple] = []

    def flush():
        columns = list(zip(*out)) or [[]] * len(_LOCAL)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LOCAL)], schema=_LOCAL)

    for batch in batches:
        for id_, key, size, part in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None:
                out.append((*held, id_ != conv))
            if id_ != conv:
                conv, place, power, chain, total = id_, 0, 1, 0, 0
            before = chain
            place, power, total = place + 1, power * BASE % PRIME, total + size
            if key is not None:
                chain = (chain + (1 + int.from_bytes(key, "big") % (PRIME - 1)) * power) % PRIME
            held = (id_, part, place, chain.to_bytes(16, "big"), before.to_bytes(16, "big"), total, key, size)
        if out:
            yield flush()
            out.clear()
    if held is not None:
        out.append((*held, True))
        yield flush()


def chained(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` (conv_id, key, bytes and the columns of ``order``) as (conv_id, place, chain, before, total, key, bytes, last).

    ``order`` starts with conv_id.  place counts a conversation's rows from 1, chain is the digest up to the row, before that up to the row
    before it, total the bytes so far; last marks its last row.  A null key takes a place and adds nothing.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    local = keep(dealt.select("conv_id", "key", "bytes", F.spark_partition_id().alias("range")).mapInArrow(_pieces, _LOCAL_SQL), label)
    # A conversation in several ranges has the first row of a range in all but one of them, so these are fewer than two rows per range.
    cut = local.filter("last").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("range", "place", "chain", "total"))).alias("parts")) \
        .filter(F.size("parts") > 1).collect()
    carried: dict[int, dict[int, tuple]] = {}
    for conv, parts in cut:
        place, chain, total = 0, 0, 0
        for p in parts:
            carried.setdefault(conv, {})[p["range"]] = (place, chain, total, p is parts[-1])
            chain = (chain + int.from_bytes(p["chain"], "big") * pow(BASE, place, PRIME)) % PRIME
            place, total = place + p["place"], total + p["total"]

    def join(batches):
        cut_ids = pa.array(list(carried), pa.int64())
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            hit = np.flatnonzero(np.isin(columns["conv_id"].to_numpy(), cut_ids.to_numpy())) if carried else ()
            if len(hit):
                rows_ = batch.to_pylist()
                for i in hit:
                    r = rows_[i]
                    place, chain, total, final = carried[r["conv_id"]][r["range"]]
                    power = pow(BASE, place, PRIME)
                    for c in ("chain", "before"):
                        r[c] = ((chain + int.from_bytes(r[c], "big") * power) % PRIME).to_bytes(16, "big")
                    r["place"], r["total"], r["last"] = r["place"] + place, r["total"] + total, r["last"] and final
                batch = pa.RecordBatch.from_pylist(rows_, schema=_LOCAL)
            yield batch

    return local.mapInArrow(join, _LOCAL_SQL).drop("range")


def numbered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv_id, place, key, bytes) of every turn: its place in its conversation from 1, the digest of (role, text), the text's bytes.

    Turns are ordered by ``turn_col``, null first, equal ones by their digest.  A null role or text counts as empty; rows without a conversation
    id belong to none and are left out.  Other columns play no part.
    """
    role = F.coalesce(conversations[f"`{role_col}`"].cast("string"), F.lit(""))
    text = F.coalesce(conversations[f"`{text_col}`"].cast("string"), F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(
        conversations[f"`{id_col}`"].cast("long").alias("conv_id"), conversations[f"`{turn_col}`"].cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("key"),
        F.octet_length(text).cast("long").alias("bytes")).filter("conv_id is not null")
    return chained(keep(rows, "trie-turns"), ["conv_id", "turn", "key"], "trie-places").select("conv_id", "place", "key", "bytes")


def rebuild(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that start like another: c's first h turns are those of c - c % ``family``, its own follow from the (h+1)th on.

    h is the CRC-32 of the id's decimal form modulo ``heads``.  Returns (conv_id, part, place, key, bytes), in that order a rebuilt conversation, with a
    row of part 0 and no key for every conversation, also for one left without turns.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = turns.select("conv_id").distinct()
    asked = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    first = turns.filter((F.col("conv_id") % family == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    head = asked.join(first, "base").filter("place <= h").select("conv_id", F.lit(1).alias("part"), "place", "key", "bytes")
    own = turns.filter(F.col("place") > h).select("conv_id", F.lit(2).alias("part"), "place", "key", "bytes")
    return starts(convs).unionByName(head).unionByName(own)


def starts(convs: DataFrame) -> DataFrame:
    """The row of part 0 of every conversation."""
    return convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("key"),
                        F.lit(0).cast("long").alias("bytes"))


def as_they_are(turns: DataFrame) -> DataFrame:
    """The conversations of :func:`numbered_turns` in the form of :func:`rebuild`, unchanged."""
    return starts(turns.select("conv_id").distinct()).unionByName(turns.select("conv_id", F.lit(1).alias("part"), "place", "key", "bytes"))


def hashed_ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) from rows (node, conv_id): the SHA-256 of the node's ids in decimal, ascending, joined by commas."""
    n = partitions(rows.sparkSession)
    texts_schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])

    def texts(batches):
        node, ids = None, []
        out: list[tuple] = []
        for batch in batches:
            for key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (key != node or len(ids) == CHUNK_IDS):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = key
                ids.append(conv)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 3, texts_schema)], schema=texts_schema)
            out.clear()
        if ids:
            yield pa.RecordBatch.from_pydict({"node": [node], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, schema=texts_schema)

    def hashes(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array([x[0] for x in out], pa.binary()), "ends_sha256": pa.array([x[1] for x in out], pa.string())})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": [state.hexdigest()]})

    dealt = rows.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    parts = dealt.mapInArrow(texts, "node binary, first long, ids string")
    return parts.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(hashes, "node binary, ends_sha256 string")


def subtree_sums(nodes: np.ndarray, ups: np.ndarray, depth: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, sums below) of each tree node of a shard, in the order given.

    ``nodes`` and ``ups`` are digests (:func:`as_words`) of the nodes and their parents; a parent that is not among the nodes is
    outside the shard.  ``own`` is each node's own amount.
    """
    table = PerfectHash(nodes)
    slot, up = table.slots(nodes), table.slots(ups)
    if (slot < 0).any():
        raise ValueError("a digest has no slot of its own")
    parent, level, below, amount = (np.empty(len(nodes), np.int64) for _ in range(4))
    parent[slot], level[slot], amount[slot] = up, depth, own
    below[:] = 0
    leaves = (np.bincount(up[up >= 0], minlength=len(nodes)) == 0).astype(np.int64)
    order = np.argsort(-level, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        part = part[parent[part] >= 0]
        np.add.at(leaves, parent[part], leaves[part])
        np.add.at(below, parent[part], below[part] + amount[part])
    return leaves[slot], below[slot]


def _shard(batches):
    rows = [b for b in batches if b.num_rows]
    if rows:
        t = pa.Table.from_batches(rows)
        up = [u or b"\xff" * 16 for u in t["up"].to_pylist()]
        nodes = t["node"].to_pylist()
        leaves, below = subtree_sums(as_words(nodes), as_words(up), t["depth"].to_numpy(), t["own"].to_numpy())
        for at in range(0, len(nodes), 50_000):
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[at:at + 50_000], pa.binary()), "leaves": leaves[at:at + 50_000],
                                              "below": below[at:at + 50_000]})


def _segments(nodes: DataFrame) -> DataFrame:
    """One row per chain of nodes with the same members, with its parent's conv_id and whether that parent lies above the cuts."""
    chains = keep(nodes.groupBy("conv_id", "n_convs").agg(
        F.count(F.lit(1)).alias("size"), F.min("depth").alias("top"), F.max("depth").alias("depth"), F.min_by("parent", "depth").alias("up"),
        F.max_by("node", "depth").alias("node"), F.max("total").alias("total"), F.sum("bytes").alias("bytes"))
        .withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes"), "trie-chains")
    members = chains.filter("up is null").select("n_convs").first()
    limit = max(CUT_MEMBERS, (members[0] if members else 0) // CUT_SHARE)
    chains = chains.withColumn("crown", (F.col("n_convs") > limit) | F.col("up").isNull())
    kids = keep(chains.filter("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("n_children")), "trie-children")
    above = kids.join(chains.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("crown").alias("under_crown")), "up")
    linked = join_uneven(chains.filter("up is not null"), above, ["up"], "n_children").drop("n_children")
    root = chains.filter("up is null").withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("under_crown", F.lit(False))
    counted = linked.unionByName(root).join(kids.withColumnRenamed("up", "node"), "node", "left").fillna(0, ["n_children"])
    return keep(counted, "trie-segments")


def _cuts(small: DataFrame) -> DataFrame:
    """(node, cut): the segment under the crown in whose subtree each segment lies, by doubling steps."""
    links = keep(small.select("node", F.when(F.col("under_crown"), F.col("node")).otherwise(F.col("up")).alias("cut")), "trie-cuts")
    while True:
        further = links.select(F.col("node").alias("cut"), F.col("cut").alias("next"))
        doubled = keep(links.join(further, "cut").select("node", F.col("next").alias("cut"), (F.col("cut") != F.col("next")).alias("moved")), "trie-cuts")
        links = doubled.drop("moved")
        if doubled.filter("moved").isEmpty():
            return links


def _totals(segments: DataFrame) -> DataFrame:
    """(node, leaves, below) of every segment: childless nodes in its subtree, and the amounts of the segments below it."""
    spark = segments.sparkSession
    small = segments.filter("not crown")
    shards = max(partitions(spark), math.ceil(segments.count() / SHARD_SEGMENTS))
    dealt = small.select("node", "up", "depth", "own").join(_cuts(small), "node").repartition(shards, "cut")
    done = keep(dealt.select("node", "up", "depth", "own").mapInArrow(_shard, "node binary, leaves long, below long"), "trie-shards")

    def handed_up(part: DataFrame) -> DataFrame:
        return part.groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum(F.col("below") + F.col("own")).alias("more_below")) \
            .withColumnRenamed("up", "node")

    def taken(part: DataFrame, sums: DataFrame) -> DataFrame:
        return part.join(sums, "node", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)),
                                                            "below": F.col("below") + F.coalesce("more_below", F.lit(0))}).drop("more_leaves", "more_below")

    bottom = small.filter("under_crown").select("node", "up", "own").join(done, "node")
    crown = segments.filter("crown").select("node", "up", "own", (F.col("n_children") == 0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("below"))
    open_ = keep(taken(crown, handed_up(bottom)), "trie-crown")
    while not open_.isEmpty():
        # A level: segments without a child that is still open.
        waiting = open_.select(F.col("up").alias("node")).filter("node is not null").distinct()
        ready = open_.join(waiting, "node", "left_anti")
        done = done.unionByName(ready.select("node", "leaves", "below"))
        open_ = keep(taken(open_.join(waiting, "node", "left_semi"), handed_up(ready.filter("up is not null"))), "trie-crown")
    return done


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations in the form of :func:`rebuild` or :func:`as_they_are`: one row per node.

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id, null for the root; n_convs: members; n_children;
    n_leaves: childless nodes in the subtree, itself included; saved_tokens: over the subtree, (n_convs - 1) times the bytes of a node's last text;
    ends_sha256: SHA-256 (lowercase hex) of the ids of members that end here, in decimal, ascending, joined by commas, of the empty string if
    none ends here.  The root has depth 0 and all conversations as members, also those without turns.  No conversation gives no rows.
    """
    rows = keep(chained(keep(conversations, "trie-rebuilt"), ["conv_id", "part", "place"], "trie-chain").select(
        "conv_id", (F.col("place") - 1).alias("depth"), F.col("chain").alias("node"), F.when(F.col("place") > 1, F.col("before")).alias("parent"),
        "bytes", "total", "last"), "trie-prefixes")
    nodes = keep(rows.groupBy("node", "parent", "depth", "bytes", "total").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")), "trie-nodes")
    ends = hashed_ends(rows.filter("last").select("node", "conv_id"))
    segments = _segments(nodes)
    values = segments.join(_totals(segments), "node").select(
        "conv_id", "n_convs", "size", "top", F.col("depth").alias("bottom"), "parent_conv_id", "n_children", F.col("total").alias("bottom_total"), "leaves", "below")
    out = join_uneven(nodes, values, ["conv_id", "n_convs"], "size").join(ends, "node", "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") == F.col("bottom"), F.col("n_children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        ((F.col("n_convs") - 1) * (F.col("bottom_total") - F.col("total") + F.col("bytes")) + F.col("below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
