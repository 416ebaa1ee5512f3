"""Result sink (S7): statistics leave the engine as long-format tables.

Every operator already returns a long ("tidy") DataFrame with one row per
(group, cell), so writing is a plain DataFrame write.  Results are small
(bounded by stations x cells), so they are written without repartitioning
beyond what the last aggregate produced, partitioned by station if asked.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: tuple[str, ...] = ()) -> None:
    """Write one statistic (Parquet by default; ``fmt="json"`` gives JSON lines)."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_results(results: Mapping[str, DataFrame], root: str, fmt: str = "parquet",
                  mode: str = "overwrite") -> dict[str, str]:
    """Write several named statistics under ``root/<name>``; returns the paths."""
    paths = {}
    for name, df in results.items():
        path = f"{root.rstrip('/')}/{name}"
        write_result(df, path, fmt=fmt, mode=mode)
        paths[name] = path
    return paths
