"""Day states: what A2, A3 and A7 need of an observation stream, kept up to date batch by batch.

A state is a row per (station, local 9 am day, calendar year, month) of flags, extremes and counts.  All of them merge: two states of the same
key become one by OR, max, min and sum, in any order, so an observation may come late by any time.  Every micro-batch is reduced
to its own states, which go to a folder of the batch's number; a batch that is repeated after a failure
overwrites its folder, so nothing counts twice.  Readers merge all folders; :func:`compact_day_states` does it once and for all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.functions import constants as K
from stratus.operators import current as A

_FLAGS = ["rain", "thunder"]
_HIGHEST, _LOWEST = ["t_max", "td_max"], ["t_min", "td_min"]
_COUNTS = ["n_obs", "fog", *[f"band_{i}" for i in range(len(K.CEILING_BAND_LABELS))]]
_DAY_KEYS = ["obs_day", "year", "month"]


def partial_day_states(obs: DataFrame, airports: DataFrame | None = None, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """The states of a set of observations: one partial and final aggregate.  Observations without a time are in no day."""
    cols = set(obs.columns)
    rows = A.with_obs_day(obs, airports, by)
    parts = [A.rain_thunder_grain(cols), A.extremes_grain(), A.fog_cloud_grain(cols)]
    defined = {n: c for g in parts for n, c in g.rows.items()}
    aggs = {n: c for g in parts for n, c in g.aggs.items()} | {"n_obs": F.count(F.lit(1))}
    rows = rows.select("*", *[c.alias(n) for n, c in defined.items()])
    return rows.groupBy(*by, *_DAY_KEYS).agg(*[c.alias(n) for n, c in aggs.items()])


def merge_day_states(states: DataFrame, by: Sequence[str] = K.DEFAULT_BY, keys: Sequence[str] = tuple(_DAY_KEYS)) -> DataFrame:
    """States of equal keys as one; fewer ``keys`` roll them up."""
    return states.groupBy(*by, *keys).agg(
        *[F.bool_or(c).alias(c) for c in _FLAGS], *[F.max(c).alias(c) for c in _HIGHEST], *[F.min(c).alias(c) for c in _LOWEST],
        *[F.sum(c).alias(c) for c in _COUNTS])


def rain_thunder_from_states(states: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """A2 from (partial) states."""
    return A.rain_thunder_from_cells(merge_day_states(states, by, ["obs_day"]), list(by))


def extremes_from_states(states: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """A3 from (partial) states."""
    return A.extremes_from_cells(merge_day_states(states, by, ["obs_day"]), list(by))


def fog_low_cloud_from_states(states: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """A7 from (partial) states: the day's flag joins the day's states, not observations."""
    by = list(by)
    merged = merge_day_states(states, by)
    wet = states.groupBy(*by, "obs_day").agg(F.bool_or("rain").alias("is_rain_day"))
    split = [*by, "is_rain_day"]
    counts = [c for c in _COUNTS if c != "n_obs"]
    cells = merged.join(wet, [*by, "obs_day"]).groupBy(*split, "year", "month").agg(*[F.sum(c).alias(c) for c in counts])
    return A.fog_cloud_from_cells(cells, split)


def _schema(by: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(b, T.StringType()) for b in by] + [T.StructField("obs_day", T.DateType()), T.StructField("year", T.IntegerType()),
                        T.StructField("month", T.IntegerType())] + [T.StructField(c, T.BooleanType()) for c in _FLAGS]
                        + [T.StructField(c, T.DoubleType()) for c in _HIGHEST + _LOWEST] + [T.StructField(c, T.LongType()) for c in _COUNTS])


def update_day_states(stream: DataFrame, path: str, checkpoint_path: str, airports: DataFrame | None = None, by: Sequence[str] = K.DEFAULT_BY,
                      available_now: bool = False):
    """Start a query that adds the states of every micro-batch of an observation stream under ``path`` (shared storage, as the checkpoint)."""
    columns = _schema(by).fieldNames()

    def add(batch: DataFrame, number: int) -> None:
        partial_day_states(batch, airports, by).select(*columns).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint_path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_day_states(spark: SparkSession, path: str, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """The merged states of all batches under ``path``."""
    return merge_day_states(spark.read.schema(_schema(by)).parquet(path).drop("batch"), by)


def compact_day_states(spark: SparkSession, path: str, target: str, by: Sequence[str] = K.DEFAULT_BY) -> None:
    """Write the merged states of ``path`` as the first batch folder of ``target``, a new folder for a query with a new checkpoint."""
    read_day_states(spark, path, by).select(*_schema(by).fieldNames()).write.parquet(f"{target.rstrip('/')}/batch=-1")
