"""Streaming.

The statistics are long-term climatologies over a finished archive; the
original application has no streaming path (no watermarks, windows over
event time, or state).  The only streaming piece kept is the observation
source as a file stream, so that new observation files can be appended to a
normalised archive with :func:`append_observations`; the statistics then run
as batch jobs over that archive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratus.sources.observations import OBSERVATION_SCHEMA, normalize_observations


def read_observations_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """S1 as a file stream: new Parquet files under ``path``, fixed schema, normalised."""
    raw = (spark.readStream.schema(OBSERVATION_SCHEMA)
           .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))
    return normalize_observations(raw)


def append_observations(stream: DataFrame, archive_path: str, checkpoint_path: str,
                        available_now: bool = False):
    """Append a normalised observation stream to a Parquet archive, partitioned
    by year (exactly-once via the file sink and its checkpoint, which must be
    on shared storage).  ``available_now=True`` processes what is there and
    stops (scheduled batch-style ingestion)."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_path)
              .partitionBy("year"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(archive_path)
