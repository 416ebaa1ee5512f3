"""What several operators share: the shared folder, saved tables, global numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir`` or the context's checkpoint
    folder.  Only a local session without either gets a folder of its own; on
    a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stratus-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/stratus/{label}-{uuid.uuid4().hex}"


_KEPT: list[str] = []


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks it ran, not what was
    computed before.  :func:`drop_kept` removes the tables.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> int:
    """Delete the tables of :func:`keep` made so far by this process; to be called once their results are written."""
    n = len(_KEPT)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _KEPT:
        path = files.Path(_KEPT.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until none of ``columns`` has it (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[str], sums: dict[str, str], index: str, label: str) -> DataFrame:
    """Number all rows in ``order`` and add running totals, without one big sort.

    The rows are dealt by ranges of ``order`` and saved with their range's
    number; a range's rows are numbered in one task, and the totals of the
    ranges before it (a table of one row per range) are added.  ``sums`` maps a
    new column to the column whose total over all earlier rows it takes;
    ``index`` names the row's number from 0.  ``order`` must tell rows apart
    where their places matter; rows equal in it stay in one range.
    """
    spark = df.sparkSession
    n = partitions(spark)
    table = keep(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), label)
    whole = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = table.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = totals.select("_range", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_n"),
                           *[F.coalesce(F.sum(f"_t_{k}").over(whole), F.lit(0)).alias(f"_t_{k}") for k in sums])
    # At most one row per range: its size is the number of shuffle partitions.
    rows = table.join(F.broadcast(before), "_range")
    own = W.partitionBy("_range").orderBy(*order)
    earlier = own.rowsBetween(W.unboundedPreceding, -1)
    return rows.select(
        *[F.col(c) for c in df.columns],
        (F.col("_n") + F.row_number().over(own) - 1).alias(index),
        *[(F.col(f"_t_{k}") + F.coalesce(F.sum(c).over(earlier), F.lit(0))).alias(k) for k, c in sums.items()])


# A key counts as hot if it holds more than one row in so many.
HOT_SHARE = 1000


def join_uneven(rows: DataFrame, table: DataFrame, on: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with a table that has one row per key and, in ``size``, the key's number of rows.

    Hot keys, fewer than ``HOT_SHARE`` as their sizes add up to the total, are joined by
    broadcast, so that their rows are not shuffled into one task; all others by shuffle.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > total
    hot = table.filter(is_hot)
    few = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.filter(~is_hot), on)
    return few.unionByName(rest)
