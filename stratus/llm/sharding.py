"""Sharding: minimax contiguous partition of ordered groups.

Groups (equal texts) are ordered by the digest of their text and never split.
The smallest shard capacity for which a greedy walk over the groups needs no
more than the given shards is found by binary search.

The walk never sees all groups.  The driver holds *cells*, runs of consecutive
groups, a bounded number of them whatever the input.  Taking cells as unsplittable gives
a feasible capacity; the true one is lower by at most one cell.  That bounds
every cut to a window, and only cells inside windows are refined, until
those windows hold single groups.

With the capacity found, the groups are cut where shards come nearest to equal sizes: each cut takes the
group boundary nearest to its share of the total among those that keep every shard, and what is left for the later ones, within the capacity.
Cells touched by such a choice are refined in the same way.  With as many groups as shards no shard stays empty.

A group above the mean size of a shard makes the smallest capacity large, and a walk with that
capacity would leave shards empty.  Such groups get shards of their own, and the other groups are cut, by the same search,
into the shards that remain.  The largest shard never grows by this.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import keep, numbered

CELLS = 4096
SINGLE_GROUPS = 50_000


@dataclass(frozen=True)
class Cell:
    """A run of consecutive groups: where it starts, its size, its groups and its first row's number."""

    start: int
    size: int
    groups: int
    first_row: int


@dataclass(frozen=True)
class Group:
    """A group of equal texts: where it starts, its size, its rows and the number of its first one."""

    start: int
    size: int
    rows: int
    first_row: int


Fetch = Callable[[list[tuple[int, int]], int], list[Cell]]


def walk(starts: list[int], total: int, capacity: int, shards: int) -> list[int] | None:
    """Cut positions of the greedy walk, or None if it needs more shards."""
    cuts, at = [0], 0
    while at + capacity < total:
        nxt = starts[bisect_right(starts, at + capacity) - 1]
        if nxt <= at or len(cuts) == shards:
            return None
        cuts.append(nxt)
        at = nxt
    return cuts


def smallest_capacity(starts: list[int], total: int, low: int, high: int, shards: int) -> int:
    """Binary search; ``high`` must be feasible."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if walk(starts, total, mid, shards) is not None else (mid + 1, high)
    return low


def _refined(fetch: Fetch, known: list[Cell], coarse: list[Cell], width: int, cells: int, single: int) -> tuple[list[Cell], int]:
    """``known`` with the cells of several groups in ``coarse`` cut up, and the width now used."""
    few = sum(c.groups for c in coarse) <= single
    width = 1 if few else max(1, min(width // 2, -(-sum(c.size for c in coarse) // cells)))
    picked = set(coarse)
    return [c for c in known if c not in picked] + fetch(_merged([(c.start, c.start + c.size) for c in coarse]), width), width


def _search(fetch: Fetch, total: int, largest: int, shards: int, cells: int, single: int) -> tuple[int, list[Cell], int]:
    """(smallest feasible capacity, cells that hold single groups wherever its walk cuts, their width)."""
    # Sizes are at least 1, so no two groups start at the same place.
    width = max(1, -(-total // cells))
    known = fetch([(0, total)], width)
    floor = max(largest, -(-total // shards))
    while True:
        known.sort(key=lambda c: c.start)
        starts = [c.start for c in known]
        high = smallest_capacity(starts, total, floor, total, shards)
        slack = max((c.size for c in known if c.groups > 1), default=0)
        low = max(floor, high - slack)
        near, far, spans = 0, 0, []
        for _ in range(shards - 1):
            near = starts[bisect_right(starts, near + low) - 1] if near + low < total else total
            far = min(total, far + high)
            spans.append((near, far))
        coarse = [c for c in known if c.groups > 1 and any(c.start < b and c.start + c.size > a for a, b in spans)]
        if not coarse:
            return high, known, width
        known, width = _refined(fetch, known, coarse, width, cells, single)


def minimax_cuts(fetch: Fetch, total: int, largest: int, shards: int, cells: int = CELLS,
                 single: int = SINGLE_GROUPS) -> tuple[int, list[Cell]]:
    """(smallest feasible capacity, the cells at which shards begin).

    ``fetch(spans, width)`` returns the cells of all groups that start within
    one of the spans [from, to): groups with the same ``start // width`` form a
    cell, but a group larger than ``width`` is a cell by itself.
    """
    capacity, known, width = _search(fetch, total, largest, shards, cells, single)
    while True:
        known.sort(key=lambda c: c.start)
        cuts, touched = even_cuts(known, total, capacity, shards)
        if not touched:
            return capacity, cuts
        known, width = _refined(fetch, known, touched, width, cells, single)


def even_cuts(known: list[Cell], total: int, capacity: int, shards: int) -> tuple[list[Cell], list[Cell]]:
    """(cells at which shards begin, cells of several groups that a choice fell into).

    Shards come nearest to equal sizes within a feasible ``capacity``; the choice is final once no cell of several groups is touched.
    """
    starts = [c.start for c in known]
    left = list(accumulate((c.groups for c in reversed(known))))[::-1]
    shards = min(shards, left[0])
    touched: set[Cell] = set()

    def cell(x: int) -> int:
        """The cell that holds x; inside one of several groups the choice is open."""
        i = bisect_right(starts, x) - 1
        if known[i].groups > 1 and starts[i] < x:
            touched.add(known[i])
        return i

    # The first place at which the last j shards can begin.
    lowest = [total]
    for _ in range(shards - 1):
        x = max(0, lowest[-1] - capacity)
        i = cell(x)
        lowest.append(x if starts[i] == x else starts[i + 1] if i + 1 < len(starts) else total)
    cuts = [known[0]]
    for k in range(1, shards):
        share = k * total / shards
        low, high = max(lowest[shards - k], cuts[-1].start + 1), min(cuts[-1].start + capacity, total - 1)
        # Enough groups have to be left for the shards after this one.
        most = bisect_right(left, -(shards - k), key=lambda n: -n) - 1
        i = cell(int(min(max(share, low), high)))
        choices = [j for j in (min(i, most), i + 1) if 0 <= j <= most and low <= starts[j] <= high]
        if not choices:  # only where a cell of several groups stands in the way
            choices = [min(cell(high), most)]
        cuts.append(known[min(choices, key=lambda j: (abs(starts[j] - share), starts[j]))])
    return cuts, list(touched)


def oversized(sizes: list[int], total: int, shards: int) -> int:
    """How many of the largest groups (``sizes``, largest first) are each above the mean of the shards left for the rest."""
    n = 0
    while n < min(len(sizes), shards - 1) and sizes[n] * (shards - n) > total:
        total -= sizes[n]
        n += 1
    return n


def near_equal_cuts(fetch_without: Callable[[list[Group]], Fetch], top: list[Group], total: int, shards: int, cells: int = CELLS,
                    single: int = SINGLE_GROUPS) -> tuple[list[Group], list[Cell]]:
    """(groups with a shard of their own, the cells at which the shards of the others begin).

    ``top`` holds the ``shards`` largest groups, largest first; ``fetch_without`` gives the fetch() over all groups but
    some, as if these had never been there.  The largest shard is no larger than minimax_cuts() over all groups makes it.
    """
    own = oversized([g.size for g in top], total, shards)
    most, plain = minimax_cuts(fetch_without([]), total, top[0].size, shards, cells, single)
    for n in range(own, 0, -1):
        rest = total - sum(g.size for g in top[:n])
        if not rest:
            return top[:n], []
        capacity, cuts = minimax_cuts(fetch_without(top[:n]), rest, top[n].size, shards - n, cells, single)
        if capacity <= most:
            return top[:n], cuts
    return [], plain


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                    overhead: int = 16, cells: int = CELLS, single: int = SINGLE_GROUPS) -> DataFrame:
    """Put all rows into shards 0 to ``shards - 1`` of nearly equal size; equal texts stay together.

    Texts of more than the mean size of a shard, with their copies, have shards of their own, numbered after the others.

    A row's size is the UTF-8 length of its text plus ``overhead`` (at least
    1).  Returns ``id_col``, size, text_crc32, group_key, shard, slot (from 0
    without gaps within the shard).  Null texts count as one group with no
    bytes and crc 0, empty texts as another; rows with equal or null ids are
    kept; an empty table gives no rows; only with fewer groups than shards
    do the last shards stay empty.  Extra columns are left out.
    """
    if overhead < 1 or shards < 1:
        raise ValueError("overhead and shards must be at least 1")
    text = docs[f"`{text_col}`"]
    rows = docs.select(
        docs[f"`{id_col}`"].alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("group_key"))
    table = keep(numbered(rows, ["group_key", "id"], {"start": "size"}, "row_number", "shard-rows"), "shard-numbered")
    groups = keep(table.groupBy("group_key").agg(
        F.min("start").alias("start"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"),
        F.min("row_number").alias("first_row")), "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    top = [Group(*r) for r in groups.orderBy(F.desc("size"), "start").limit(shards).select("start", "size", "rows", "first_row").collect()]

    def without(column: str, own: list[Group], what: str) -> Column:
        """A row's start or number as if the groups ``own`` were not there."""
        out = F.col(column)
        for g in own:
            out = out - F.when(F.col("start") > g.start, F.lit(getattr(g, what)).cast("long")).otherwise(F.lit(0).cast("long"))
        return out

    def fetch_without(own: list[Group]) -> Fetch:
        left = groups if not own else groups.filter(~F.col("start").isin([g.start for g in own])).select(
            without("start", own, "size").alias("start"), "size", without("first_row", own, "rows").alias("first_row"))
        return lambda spans, width: fetch(left, spans, width, total - sum(g.size for g in own))

    def fetch(left: DataFrame, spans: list[tuple[int, int]], width: int, end: int) -> list[Cell]:
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | ((F.col("start") >= a) & (F.col("start") < b))
        found = left.filter(inside) if spans != [(0, end)] else left
        by = found.groupBy(F.expr(f"start div {width}L").alias("cell"), (F.col("size") > width).alias("big"))
        return [Cell(*r) for r in by.agg(F.min("start"), F.sum("size"), F.count(F.lit(1)), F.min("first_row"))
                .select("min(start)", "sum(size)", "count(1)", "min(first_row)").collect()]

    own, cuts = near_equal_cuts(fetch_without, top, total, shards, cells, single) if total else ([], [])
    begin = F.array(*[F.lit(c.start).cast("long") for c in cuts])
    first = F.array(*[F.lit(c.first_row).cast("long") for c in cuts])
    at, number = without("start", own, "size"), without("row_number", own, "rows")
    shard = (F.size(F.filter(begin, lambda c: c <= at)) - 1) if cuts else F.lit(0)
    slot = number - (F.get(first, shard) if cuts else F.lit(0))
    for i, g in enumerate(sorted(own, key=lambda g: g.start)):
        mine = (F.col("start") >= g.start) & (F.col("start") < g.start + g.size)
        shard = F.when(mine, F.lit(len(cuts) + i)).otherwise(shard)
        slot = F.when(mine, F.col("row_number") - g.first_row).otherwise(slot)
    return table.select(F.col("id").alias(id_col), "size", "text_crc32", "group_key", shard.cast("int").alias("shard"), slot.alias("slot"))
