"""Session construction."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job of this library relies on.  The session time zone does
# not change any result (times are TIMESTAMP_NTZ in UTC), UTC just keeps
# printed values readable.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # HotSpot does not JIT-compile methods over 8000 bytes of bytecode; a fused
    # stage above that size would run interpreted, so fall back to per-operator
    # code for such subtrees instead (Spark's documented setting for HotSpot).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "stratus", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """A session for tests and local runs (on a cluster, use the cluster's)."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
