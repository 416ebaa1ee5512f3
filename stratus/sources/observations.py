"""Observation fact table: schema, ingest normalisation, UTC parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.sources.timetext import parse_utc

OBSERVATION_SCHEMA = T.StructType([
    T.StructField("TARGET_ICAO", T.StringType(), False),
    T.StructField("TM_FULL", T.TimestampNTZType(), True),
    T.StructField("year", T.IntegerType(), False),
    T.StructField("month", T.IntegerType(), False),
    T.StructField("hour", T.IntegerType(), False),
    T.StructField("WND_DIR", T.DoubleType(), True),
    T.StructField("WND_SPD", T.DoubleType(), True),
    T.StructField("MAX_WND_GUST_10", T.DoubleType(), True),
    T.StructField("AIR_TEMP", T.DoubleType(), True),
    T.StructField("DWPT", T.DoubleType(), True),
    T.StructField("VSBY", T.DoubleType(), True),
    T.StructField("PRST_WX_DSC_1", T.StringType(), True),
    T.StructField("PRST_WX_DSC_2", T.StringType(), True),
    T.StructField("PRST_WX_PHENOM_1", T.StringType(), True),
    T.StructField("PRST_WX_PHENOM_2", T.StringType(), True),
    T.StructField("CEIL_CLD_AMT_1", T.StringType(), True),
    T.StructField("CEIL_CLD_AMT_2", T.StringType(), True),
    T.StructField("CEIL_CLD_HT_1", T.DoubleType(), True),
    T.StructField("CEIL_CLD_HT_2", T.DoubleType(), True),
])

INT_COLUMNS = ["year", "month", "hour"]
DOUBLE_COLUMNS = ["WND_DIR", "WND_SPD", "MAX_WND_GUST_10", "AIR_TEMP", "DWPT", "VSBY",
                  "CEIL_CLD_HT_1", "CEIL_CLD_HT_2"]
STRING_COLUMNS = ["TARGET_ICAO", "PRST_WX_DSC_1", "PRST_WX_DSC_2", "PRST_WX_PHENOM_1",
                  "PRST_WX_PHENOM_2", "CEIL_CLD_AMT_1", "CEIL_CLD_AMT_2"]

def nan_to_null(c: Column) -> Column:
    """NaN becomes null, so Spark's null-skipping aggregates skip it too
    (Spark orders NaN above every number, so max() would return it)."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def _epoch_ntz() -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")


def instant_to_utc_ntz(ltz: Column) -> Column:
    """TIMESTAMP (an instant) -> TIMESTAMP_NTZ holding its UTC wall-clock
    time, independent of the session time zone."""
    secs = (F.unix_micros(ltz).cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)")
    return _epoch_ntz() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def _as_utc_ntz(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, T.TimestampType):
        return instant_to_utc_ntz(c)
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    return parse_utc(name)


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def normalize_observations(df: DataFrame) -> DataFrame:
    """Bring any observation frame to the canonical schema.

    Casts present columns to their canonical types (numbers given as text are
    coerced, junk -> null), turns NaN into null, and makes ``TM_FULL`` a UTC
    TIMESTAMP_NTZ.  Missing optional columns are left out; extra columns are
    kept untouched.  Written as one SQL projection (a single call from Python,
    however many columns there are).
    """
    exprs = []
    needs_columns = False
    for name in df.columns:
        q = _sql_name(name)
        if name == "TM_FULL":
            needs_columns = needs_columns or not isinstance(
                df.schema[name].dataType, T.TimestampNTZType)
            exprs.append(None)
        elif name in INT_COLUMNS:
            exprs.append(f"try_cast({q} AS INT) AS {q}")
        elif name in DOUBLE_COLUMNS:
            exprs.append(f"nanvl(try_cast({q} AS DOUBLE), CAST(NULL AS DOUBLE)) AS {q}")
        elif name in STRING_COLUMNS:
            exprs.append(f"CAST({q} AS STRING) AS {q}")
        else:
            exprs.append(q)
    if not needs_columns:
        return df.selectExpr(*[e if e is not None else "TM_FULL" for e in exprs])
    cols = [F.expr(e) if e is not None else _as_utc_ntz(df, "TM_FULL").alias("TM_FULL") for e in exprs]
    return df.select(*cols)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Scan observation Parquet (lazy) and normalise it.

    Only the columns an operator later selects are read (Catalyst prunes the
    projection into the Parquet ``ReadSchema``), and range filters on
    ``year/month/hour/TARGET_ICAO`` are pushed into the scan.
    """
    return normalize_observations(spark.read.parquet(path))


def write_observations(obs: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Write a normalised observation archive laid out for station/year
    selections.

    Directories per ``year`` give partition pruning on the year range; inside,
    rows are range-partitioned and sorted by (station, time), so Parquet
    row-group statistics let a station filter skip most of the data.  Time is
    part of the range key, so a station with a very large share of the rows
    is still cut into many files.  ``files`` defaults to the session's shuffle
    partition count.  Range partitioning samples the input first (one extra
    read), which is worth it for an archive written once and read many times.
    """
    spark = obs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    laid_out = normalize_observations(obs).repartitionByRange(n, "year", "TARGET_ICAO", "TM_FULL") \
        .sortWithinPartitions("year", "TARGET_ICAO", "TM_FULL")
    laid_out.write.mode(mode).partitionBy("year").parquet(path)


def drop_unparsed_times(df: DataFrame) -> DataFrame:
    """S6 second half: rows whose observation time is unknown are dropped."""
    return df.filter(F.col("TM_FULL").isNotNull())
