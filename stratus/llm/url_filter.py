"""URL filter with dated lists: a temporal list join.

A list is a history of entries: from a day on, a host (with all below it) or a path under a host is
blocked, allowed, or taken off the list.  A host entry needs two labels or more to hold for the hosts below it
(``com`` is the host ``com`` alone).  A path entry of any depth holds for the paths below it, on its own host
only: one for ``example.com/a`` says nothing of ``www.example.com/a``.  Entries of the same key become validity intervals
that end where the next entry begins.  A capture is judged by the entries that were
active when it was fetched: the as-of join is an equi-join on the key with a check of the day against the
interval.  A key has one active interval at most, so the join gives a capture no more rows than it has keys.

The most specific active entry decides: a longer path, then a longer host.

Only DataFrame and SQL functions are used.  The list is joined without a hint: Spark broadcasts it if
it is small, else it shuffles both sides and splits a hot host's captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without scheme, user, port and trailing dot; null if there is none."""
    rest = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(rest, r"^[^@]*@", ""), r"\.?(:[0-9]*)?$", ""))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The first segment of the path ("" if there is none)."""
    return F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1), F.lit(""))


def segments_of(url: Column) -> Column:
    """All segments of the path."""
    return F.split(F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), F.lit("")), "/")


def keys_of(host: Column, segments: Column) -> Column:
    """Every key an entry may have to match: the host and its parent domains of two labels or more, and the host with every leading part of the path."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ends = F.filter(F.sequence(F.lit(1), F.size(segments)), lambda i: F.element_at(segments, i) != "")
    paths = F.transform(ends, lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))
    return F.array_distinct(F.concat(parents, paths))


def intervals(entries: DataFrame) -> DataFrame:
    """Entries (entry_id, key, action, since) as intervals [since, until); an ``unlist`` ends one and begins none.

    Several entries of one key and day: the last by entry_id counts.  Entries with a null key, action
    or day are left out; repeated rows count once.  A slash at the end of a key is left off.
    """
    known = entries.select("entry_id", F.regexp_replace(F.lower("key"), "/+$", "").alias("key"), "action", F.col("since").cast("date").alias("since")).dropna().distinct()
    last = W.partitionBy("key", "since").orderBy(F.col("entry_id").desc(), F.col("action"))
    following = F.lead("since").over(W.partitionBy("key").orderBy("since"))
    one = known.withColumn("nth", F.row_number().over(last)).filter("nth = 1")
    return one.withColumn("until", F.coalesce(following, F.lit(OPEN_END).cast("date"))).filter("action <> 'unlist'") \
        .select("entry_id", "key", "action", "since", "until")


def temporal_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """``id_col``, host, ``day_col``, n_active (entries active for the capture), entry_id and action of the deciding one, kept.

    A capture without an active entry is kept, with null entry_id and action; one whose URL is null or has no host, or whose
    day is null, meets no entry.  Rows with equal or null ids are judged one by one.
    Empty tables give no rows, or every capture kept.  Extra columns are left out.
    """
    rows = captures.select(F.monotonically_increasing_id().alias("row"), captures[f"`{id_col}`"].alias("id"), captures[f"`{url_col}`"].alias("url"), captures[f"`{day_col}`"].cast("date").alias("day")) \
        .select("row", "id", "day", host_of(F.col("url")).alias("host"), segments_of(F.col("url")).alias("segments"))
    asked = rows.select("row", "id", "day", "host", F.explode_outer(keys_of(F.col("host"), F.col("segments"))).alias("asked"))
    span = intervals(entries)
    met = asked.join(span, (asked.asked == span.key) & (asked.day >= span.since) & (asked.day < span.until), "left")
    # A path outranks every host, and a longer one a shorter one; of two hosts, the one with more labels.
    rank = F.struct(F.size(F.split("key", "/")), F.size(F.split(F.split("key", "/")[0], r"\.")))
    best = F.max(F.when(F.col("key").isNotNull(), F.struct(rank.alias("rank"), "entry_id", "action")))
    judged = met.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("day").alias("day"),
                                    F.count("key").alias("n_active"), best.alias("best"))
    return judged.select(F.col("id").alias(id_col), "host", F.col("day").alias(day_col), "n_active", F.col("best.entry_id").alias("entry_id"),
                         F.col("best.action").alias("action"), (F.coalesce(F.col("best.action"), F.lit("allow")) != "block").alias("kept"))
