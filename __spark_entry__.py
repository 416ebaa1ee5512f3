"""

``entry(spark)`` runs the flagship statistic (wind rose of every station) on
sf0.001.  ``queries()`` holds one callable per implemented operator; each
derives observations from the driver's ``lineitem`` (and airports from
``nation``) with the mapping of FIXTURES.md, runs the operator over the whole
table and rounds doubles to 6 decimals.  ``oracle_sql()`` holds the DuckDB
statement for every key (see ``oracle_sql.py``).
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stratus.functions import constants as K  # noqa: E402
from stratus.operators import contours as CN  # noqa: E402
from stratus.operators import current as A  # noqa: E402
from stratus.operators import monthly as M  # noqa: E402
from stratus.operators import tiles as TL  # noqa: E402
from stratus.operators.filters import select_observations  # noqa: E402
from stratus.plans.documents import section_documents, section_rows  # noqa: E402
from stratus.plans.sections import SECTIONS, section_from_one_scan  # noqa: E402
from stratus.plans.shared import shared_folder  # noqa: E402
from stratus.sources.airports import list_airports, options, read_airports, with_timezone  # noqa: E402
from stratus.sources.fixture import load_airports, load_observations  # noqa: E402
from stratus.sources.observations import parse_utc, read_observations, write_observations  # noqa: E402
from stratus.sources.sinks import write_result  # noqa: E402
from stratus.sources.zones import zone_by_polygon  # noqa: E402
from stratus.streaming.daystate import partial_day_states, rain_thunder_from_states  # noqa: E402

try:
    import stratus.llm.entry as llm_entry  # noqa: E402
except ImportError:  # the library also works without this subpackage, or without what it needs
    llm_entry = None

SMOKE_DIR = "/root/testdata/sf0.001"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (summation order differs between engines)."""
    cols = [F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: wind rose (% per sector and speed band) of every station."""
    return rounded(A.wind_rose_pct(load_observations(spark, SMOKE_DIR)))


def _obs(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: rounded(op(load_observations(spark, sf)))


def _obs_air(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: rounded(op(load_observations(spark, sf), load_airports(spark, sf)))


def _air(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: rounded(op(load_airports(spark, sf)))


_ROW_COLS = ["TARGET_ICAO", "year", "month", "hour", "WND_SPD"]

PAIRED_CATEGORIES = {
    "Rain": {"tokens": K.RAIN_DAY_TOKENS, "fields": K.WX_FIELDS},
    "Thunderstorm": {"tokens": K.THUNDER_TOKENS, "fields": K.DSC_FIELDS},
}


def _zone_counts(obs: DataFrame, air: DataFrame) -> DataFrame:
    return with_timezone(obs, air).groupBy("TARGET_ICAO", "tz").agg(F.count(F.lit(1)).alias("n_obs"))


def _times_as_text(obs: DataFrame) -> DataFrame:
    """Every observation time written in several text forms and read again."""
    t = F.col("TM_FULL")
    ahead = F.date_format(t + F.expr("INTERVAL '10' HOUR"), "yyyy-MM-dd HH:mm")
    texts = obs.select(
        "TARGET_ICAO", "TM_FULL", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("iso"), F.date_format(t, "yyyy/MM/dd HH:mm").alias("slash"),
        F.date_format(t, "yyyyMMdd HHmm").alias("compact"), F.concat(ahead, F.lit(" +10:00")).alias("offset"),
        F.concat(ahead, F.lit(" Australia/Sydney")).alias("named"), F.concat(F.lit("x"), ahead).alias("junk"))

    def same(text):
        return F.count_if(parse_utc(text) == t)

    return texts.groupBy("TARGET_ICAO").agg(
        F.count(F.lit(1)).alias("n_obs"), same("iso").alias("n_same_iso"), same("slash").alias("n_same_slash"),
        same("compact").alias("n_same_compact"), same("offset").alias("n_same_offset"),
        F.count(parse_utc("named")).alias("n_named_zone"), F.count(parse_utc("junk")).alias("n_junk"))


def _written_times(obs: DataFrame) -> DataFrame:
    """Observation times in forms with names and one-digit parts, read again."""
    t = F.col("TM_FULL")
    texts = obs.select(
        "TARGET_ICAO", "TM_FULL", F.date_format(t, "yyyy-M-d H:mm").alias("short"), F.date_format(t, "d MMM yyyy HH:mm:ss").alias("day_first"),
        F.date_format(t, "MMMM d, yyyy h:mm a").alias("month_first"), F.date_format(t, "M/d/yyyy HH:mm").alias("numbers"),
        F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit(".000000789Z")).alias("nanoseconds"))
    names = ["short", "day_first", "month_first", "numbers", "nanoseconds"]
    return texts.groupBy("TARGET_ICAO").agg(F.count(F.lit(1)).alias("n_obs"), *[F.count_if(parse_utc(n) == t).alias(f"n_same_{n}") for n in names])


_SMOKE_KEYS = ["TARGET_ICAO", "phenomenon"]


def _smoke_hist(obs: DataFrame) -> DataFrame:
    rows = A.smoke_observations(obs).filter(
        F.col("WND_DIR").isNotNull() & F.col("WND_SPD").isNotNull()
        & F.col("phenomenon").isin(*K.SMOKE_CONTOUR_ORDER))
    return CN.polar_histogram(rows, _SMOKE_KEYS, K.SMOKE_CONTOUR_MAX_SPEED)


def _smoke_levels(obs: DataFrame) -> DataFrame:
    peaks = CN.smoothed_grids(_smoke_hist(obs), _SMOKE_KEYS).filter(F.col("peak") >= F.lit(K.CONTOUR_CUTOFF_PCT))
    return peaks.select(*_SMOKE_KEYS, F.posexplode(CN.contour_levels(F.col("peak"))).alias("level_idx", "level"))


def _round_trip(obs: DataFrame, air: DataFrame) -> DataFrame:
    """Observations and airports written as an archive and a CSV, read again; the statistic written and read."""
    spark = obs.sparkSession
    root = f"{shared_folder(spark)}/stratus-archive/{uuid.uuid4().hex}"
    write_observations(obs, f"{root}/observations")
    air.write.csv(f"{root}/airports", header=True)
    back = with_timezone(read_observations(spark, f"{root}/observations"), read_airports(spark, f"{root}/airports"))
    stat = back.groupBy("TARGET_ICAO", "tz").agg(
        F.count(F.lit(1)).alias("n_obs"), F.countDistinct("TM_FULL").alias("n_times"), F.sum("WND_DIR").alias("sum_dir"), F.sum("AIR_TEMP").alias("sum_temp"),
        F.count("PRST_WX_PHENOM_1").alias("n_phenom"), F.max("CEIL_CLD_HT_2").alias("max_height"))
    write_result(stat, f"{root}/result")
    return spark.read.parquet(f"{root}/result")


def _zone_points(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer as a point, in zones drawn around the nations: slanted boxes, some with a hole, some with a second part."""
    nation = spark.read.parquet(f"{sf}/nation.parquet").selectExpr(
        "n_nationkey as k", "concat('Zone/', lpad(cast(n_nationkey as string), 2, '0')) as zone", "115 + 1.5D * n_nationkey as x", "-(10D + n_nationkey) as y")
    lines = """array(
        struct(0 as part, 0 as ring, true as drawn, array(-1.25D, 1.5D, 1.25D, -1.5D) as dx, array(-0.75D, -0.5D, 0.75D, 0.5D) as dy),
        struct(0 as part, 1 as ring, k % 3 = 0 as drawn, array(-0.25D, 0.5D, 0D) as dx, array(-0.25D, -0.125D, 0.25D) as dy),
        struct(1 as part, 0 as ring, k % 4 = 0 as drawn, array(20D, 23D, 21D) as dx, array(5D, 6D, 7D) as dy))"""
    rings = nation.selectExpr("zone", "x", "y", f"inline({lines})").filter("drawn") \
        .selectExpr("zone", "part", "ring", "x", "y", "dy", "posexplode(dx) as (seq, d)").selectExpr("zone", "part", "ring", "seq", "x + d as lon", "y + dy[seq] as lat")
    points = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey as point", "113 + (c_custkey * 37 % 6000) / 100D as LONG", "-(8 + (c_custkey * 53 % 3000) / 100D) as LAT")
    return zone_by_polygon(points, rings, key="point")


def _nearest_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The airports on a tile set with gaps, made from the suppliers."""
    tiles = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_suppkey % 3 = 0") \
        .selectExpr("410 + s_suppkey * 7 % 70 as x", "265 + s_suppkey * 11 % 50 as y")
    return TL.nearest_tile(load_airports(spark, sf), tiles)


def _daily_state(obs: DataFrame, air: DataFrame) -> DataFrame:
    """A2 from the merged day states of three parts of the observations, none of which holds whole days."""
    parts = [partial_day_states(obs.filter(F.col("hour") % 3 == k), air) for k in range(3)]
    return rain_thunder_from_states(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _documents(obs: DataFrame, air: DataFrame) -> DataFrame:
    """The documents of every section."""
    out = None
    for section in SECTIONS:
        docs = section_documents(section_from_one_scan(obs, section, air)).withColumn("section", F.lit(section))
        out = docs if out is None else out.unionByName(docs)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # sources, selection, days
        "list_airports": _obs(list_airports),
        "options": _obs(options),
        "with_timezone": _obs_air(_zone_counts),
        "range_filter": _obs(lambda o: select_observations(
            o, years=(1996, 2000), months=(3, 9), hours=(6, 18)).select(*_ROW_COLS)),
        "range_filter_inverted": _obs(lambda o: select_observations(
            o, years=(1995, 2001), months=("Apr", "Sep"), hours=(8, 20),
            invert_month=True, invert_hour=True).select(*_ROW_COLS)),
        "empty_selection": _obs(lambda o: select_observations(o, icao="none", years=(1996, 2000)).select(*_ROW_COLS)),
        "parse_utc": _obs(_times_as_text),
        "parse_utc_written": _obs(_written_times),
        "obs_day": _obs_air(A.obs_day_counts),
        # current generation
        "wind_rose_pct": _obs(A.wind_rose_pct),
        "rain_thunder_days": _obs_air(A.rain_thunder_days),
        "temp_dewpoint_daily_extremes": _obs_air(A.temp_dewpoint_daily_extremes),
        "fog_monthly_count": _obs(A.fog_monthly_count),
        "low_cloud_monthly_by_band": _obs(A.low_cloud_monthly_by_band),
        "fog_low_cloud_frequency": _obs(A.fog_low_cloud_frequency),
        "fog_low_cloud_by_rain_day": _obs_air(A.fog_low_cloud_by_rain_day),
        "gale_by_weather": _obs(A.gale_by_weather),
        "visibility_given_precip": _obs(A.visibility_given_precip),
        "smoke_monthly": _obs(A.smoke_monthly),
        "smoke_hourly": _obs(A.smoke_hourly),
        "smoke_scatter": _obs(A.smoke_scatter),
        "smoke_linear_fit": _obs(A.smoke_linear_fit),
        "summary_metrics": _obs(A.summary_metrics),
        # contours
        "wind_contours": _obs(CN.wind_contours),
        "smoke_wind_contours": _obs(CN.smoke_wind_contours),
        "fog_low_cloud_wind_contours": _obs_air(CN.fog_low_cloud_wind_contours),
        "polar_histogram": _obs(_smoke_hist),
        "smooth_polar": _obs(lambda o: CN.smooth_polar(_smoke_hist(o), _SMOKE_KEYS).drop("n", "peak")),
        "contour_levels": _obs(_smoke_levels),
        "display_radius": _obs(lambda o: CN.smoke_wind_contours(o).select(
            "TARGET_ICAO", "display_max_speed").distinct()),
        # unrouted helpers
        "monthly_flag_frequency": _obs(lambda o: M.monthly_flag_frequency(o, K.FOG_TOKENS, "Fog")),
        "paired_monthly_frequency": _obs(lambda o: M.paired_monthly_frequency(o, PAIRED_CATEGORIES)),
        "low_cloud_cumulative_frequency": _obs(M.low_cloud_cumulative_frequency),
        # legacy generation
        "wind_rose_count": _obs(M.wind_rose_count),
        "monthly_temp_extremes": _obs(M.monthly_temp_extremes),
        "monthly_rain_thunder": _obs(M.monthly_rain_thunder),
        "monthly_fog_low_cloud": _obs(M.monthly_fog_low_cloud),
        "monthly_fog_low_cloud_br": _obs(lambda o: M.monthly_fog_low_cloud(o, K.LEGACY_FOG_PAGE_TOKENS)),
        "wind_direction_count": _obs(M.wind_direction_count),
        "monthly_wind_gust": _obs(M.monthly_wind_gust),
        "convective_split": _obs(M.convective_split),
        "cloud_amount_distribution": _obs(M.cloud_amount_distribution),
        "monthly_smoke": _obs(M.monthly_smoke),
        "phenomenon_breakdown": _obs(M.phenomenon_breakdown),
        # archive, states, places
        "archive_round_trip": _obs_air(_round_trip),
        "daily_state": _obs_air(_daily_state),
        "zone_by_polygon": _zone_points,
        "nearest_tile": _nearest_tiles,
        # whole sections
        "section_overview": _obs_air(lambda o, a: section_rows(section_from_one_scan(o, "overview", a))),
        "section_documents": _obs_air(_documents),
        # airport dimension
        "tile_address": _air(TL.tile_address),
        "tile_neighbourhood": _air(TL.tile_neighbourhood),
        # training-data operators and pipeline
        **(llm_entry.queries() if llm_entry else {}),
    }


def oracle_sql() -> dict[str, str]:
    from oracle_sql import statements
    sql = {**statements(), **(llm_entry.oracle_sql() if llm_entry else {})}
    return {name: sql[name] for name in queries() if name in sql}
