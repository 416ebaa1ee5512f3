"""Airport dimension and station lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.functions import constants as K

AIRPORT_SCHEMA = T.StructType([
    T.StructField("ICAO", T.StringType(), False),
    T.StructField("LAT", T.DoubleType(), True),
    T.StructField("LONG", T.DoubleType(), True),
    T.StructField("tz", T.StringType(), True),
])


def read_airports(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Airport coordinates keyed by ICAO (CSV with header, or Parquet).

    ``tz`` (IANA zone name) is an input column here; a missing column is
    added as null, which later resolves to UTC.
    """
    if fmt == "csv":
        raw = spark.read.csv(path, header=True)
    else:
        raw = spark.read.format(fmt).load(path)
    cols = set(raw.columns)
    return raw.select(
        F.col("ICAO").cast("string").alias("ICAO"),
        F.col("LAT").try_cast("double").alias("LAT"),
        F.col("LONG").try_cast("double").alias("LONG"),
        (F.col("tz").cast("string") if "tz" in cols else F.lit(None).cast("string")).alias("tz"),
    )


def list_airports(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """S3: distinct stations, ascending (one partial+final aggregate)."""
    return obs.select(*by).distinct().orderBy(*by)


def options(obs: DataFrame, station: str = "TARGET_ICAO", legacy: bool = False) -> DataFrame:
    """One row with the default airport, the month names and default selection ranges.

    The airports themselves are rows of :func:`list_airports`.

    Default airport: the preferred code when present, else the smallest code,
    else null.  Computed as one global aggregate (partial per partition).
    ``legacy=True`` gives the legacy page's default years (2015-2024).
    """
    years = K.LEGACY_DEFAULT_YEAR_RANGE if legacy else K.DEFAULT_YEAR_RANGE
    agg = obs.agg(
        F.min(F.when(F.col(station) == F.lit(K.DEFAULT_AIRPORT), F.col(station))).alias("_pref"),
        F.min(F.col(station)).alias("_first"),
        F.count_distinct(F.col(station)).alias("n_airports"),
    )
    months = F.array(*[F.lit(m) for m in K.MONTH_TO_NUM])
    return agg.select(
        F.coalesce("_pref", "_first").alias("default_airport"),
        "n_airports",
        F.lit(years[0]).alias("year_start"),
        F.lit(years[1]).alias("year_end"),
        F.lit(K.DEFAULT_MONTH_RANGE[0]).alias("month_start"),
        F.lit(K.DEFAULT_MONTH_RANGE[1]).alias("month_end"),
        F.lit(K.DEFAULT_HOUR_RANGE[0]).alias("hour_start"),
        F.lit(K.DEFAULT_HOUR_RANGE[1]).alias("hour_end"),
        F.lit(False).alias("invert_month"),
        F.lit(False).alias("invert_hour"),
        F.lit(K.DEFAULT_SECTION).alias("section"),
        F.concat_ws(",", months).alias("months"),
    )


# Fixed offsets accepted as zones: Z, +hh, +hh:mm, +hh:mm:ss.
_OFFSET_ZONE = r"^(Z|[+-]\d{2}(:\d{2}(:\d{2})?)?)$"


def known_zone_names(spark) -> list[str]:
    """Region zone IDs the JVM knows (what Spark's zone conversion accepts);
    Python's zone database where the JVM is not reachable."""
    try:
        return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    except Exception:
        import zoneinfo
        return sorted(zoneinfo.available_timezones())


def usable_zone(spark: SparkSession, tz: Column) -> Column:
    """Whether Spark can convert to this zone."""
    return tz.isin(*known_zone_names(spark)) | tz.rlike(_OFFSET_ZONE)


def airport_zones(airports: DataFrame) -> DataFrame:
    """One zone per ICAO (deterministic if the dimension repeats a code).

    A zone name Spark cannot use (misspelt, unknown) is treated like a
    missing one, so it resolves to UTC instead of failing the job.
    """
    tz = F.col("tz")
    return airports.groupBy("ICAO").agg(F.min(F.when(usable_zone(airports.sparkSession, tz), tz)).alias("tz"))


def with_timezone(obs: DataFrame, airports: DataFrame | None, station: str = "TARGET_ICAO") -> DataFrame:
    """Add ``tz`` per observation; unknown station, no zone or an unusable zone name -> 'UTC'.

    One plain left join: the zone table is an aggregate, so adaptive execution
    knows its real size, broadcasts it if it fits and otherwise splits the
    partitions of a station that holds a large share of the observations.
    An observation frame that already has a ``tz`` column keeps its usable zones.
    """
    if "tz" in obs.columns:
        usable = usable_zone(obs.sparkSession, F.col("tz"))
        return obs.withColumn("tz", F.coalesce(F.when(usable, F.col("tz")), F.lit("UTC")))
    if airports is None:
        return obs.withColumn("tz", F.lit("UTC"))
    zones = airport_zones(airports).withColumnRenamed("ICAO", "_zone_icao")
    joined = obs.join(zones, obs[station] == zones["_zone_icao"], "left")
    return joined.drop("_zone_icao").withColumn("tz", F.coalesce(F.col("tz"), F.lit("UTC")))
