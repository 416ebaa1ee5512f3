"""Small intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the context's checkpoint folder; only a local session without either gets one of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stratus-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_SAVED: list[str] = []


def save_small(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    Runs a job now.  The table's size is then known to the planner, which broadcasts it in a
    join if it is below ``spark.sql.autoBroadcastJoinThreshold`` and joins by shuffle otherwise, and a lost executor
    does not compute it again.  :func:`drop_saved` removes the tables.
    """
    path = f"{shared_folder(df.sparkSession)}/stratus-saved/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SAVED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession) -> int:
    """Delete the tables of :func:`save_small` made so far by this process; results built on them can no longer run."""
    n = len(_SAVED)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _SAVED:
        path = jvm.org.apache.hadoop.fs.Path(_SAVED.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
