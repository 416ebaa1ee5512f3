"""Observation and airport frames derived from the driver's TPC-H-style tables.

The driver's tables hold no weather observations, so ``lineitem`` is mapped
row by row to an observation and ``nation`` to an airport (the mapping is
described in FIXTURES.md).  The values are not weather; they only make every
branch of every statistic non-empty.  The same mapping exists as DuckDB SQL
in ``oracle_sql.py`` for the correctness oracle (there as CASE expressions;
here the code lookups are array lookups, which give the same values while
referencing each helper key once, so that filters pushed through the
mapping stay small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratus.sources.observations import normalize_observations

# Helper keys per lineitem row (BIGINT).
_HELPERS = [
    "l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7 + l_suppkey * 3 AS h",
    "l_orderkey * 13 + l_partkey * 5 + l_linenumber AS g",
    "l_suppkey",
    "l_shipdate",
    "l_quantity",
]

_OBSERVATION_EXPRS = [
    "concat('N', lpad(CAST(l_suppkey % 25 AS STRING), 3, '0')) AS TARGET_ICAO",
    "l_shipdate + make_dt_interval(0, CAST(h % 24 AS INT), CAST(g % 2 AS INT) * 30, 0) AS TM_FULL",
    "CASE WHEN g % 29 = 0 THEN NULL ELSE CAST((g % 36) * 10 AS DOUBLE) END AS WND_DIR",
    "CASE WHEN g % 31 = 0 THEN NULL ELSE l_quantity * CAST(0.5 AS DOUBLE) END AS WND_SPD",
    "CASE WHEN h % 5 = 0 THEN NULL ELSE l_quantity * CAST(0.625 AS DOUBLE) END AS MAX_WND_GUST_10",
    "CASE WHEN h % 37 = 0 THEN NULL ELSE CAST(h % 70 AS DOUBLE) / 2 END AS AIR_TEMP",
    "CASE WHEN g % 41 = 0 THEN NULL ELSE CAST(h % 70 AS DOUBLE) / 2 - CAST(g % 12 AS DOUBLE) END AS DWPT",
    "CASE WHEN g % 43 = 0 THEN NULL ELSE CAST(h % 101 AS DOUBLE) / 10 END AS VSBY",
    "try_element_at(array('SH', 'TS', 'FZ'), CAST(h % 11 AS INT) + 1) AS PRST_WX_DSC_1",
    "try_element_at(array('SH', 'TS'), CAST(g % 47 AS INT) + 1) AS PRST_WX_DSC_2",
    "try_element_at(array('RA', 'FG', 'DZ', 'FU', 'DU', 'BR', 'VA', 'sa', 'HZ', '+RA'), CAST(h % 23 AS INT) + 1)"
    " AS PRST_WX_PHENOM_1",
    "try_element_at(array('FG', 'RA', 'DU', 'FU'), CAST(g % 53 AS INT) + 1) AS PRST_WX_PHENOM_2",
    "try_element_at(array('BKN', 'OVC', 'FEW', 'SCT'), CAST(h % 7 AS INT) + 1) AS CEIL_CLD_AMT_1",
    "CASE WHEN h % 7 < 4 THEN CAST((g % 30) * 100 AS DOUBLE) END AS CEIL_CLD_HT_1",
    "try_element_at(array('BKN', 'OVC', 'FEW'), CAST(g % 19 AS INT) + 1) AS CEIL_CLD_AMT_2",
    "CASE WHEN g % 19 < 3 THEN CAST((h % 50) * 100 AS DOUBLE) END AS CEIL_CLD_HT_2",
]

_CALENDAR_EXPRS = [
    "CAST(year(TM_FULL) AS INT) AS year",
    "CAST(month(TM_FULL) AS INT) AS month",
    "CAST(hour(TM_FULL) AS INT) AS hour",
]

_COLUMN_ORDER = ["TARGET_ICAO", "TM_FULL", "year", "month", "hour", "WND_DIR", "WND_SPD",
                 "MAX_WND_GUST_10", "AIR_TEMP", "DWPT", "VSBY", "PRST_WX_DSC_1", "PRST_WX_DSC_2",
                 "PRST_WX_PHENOM_1", "PRST_WX_PHENOM_2", "CEIL_CLD_AMT_1", "CEIL_CLD_AMT_2",
                 "CEIL_CLD_HT_1", "CEIL_CLD_HT_2"]

_AIRPORT_EXPRS = [
    "concat('N', lpad(CAST(n_nationkey AS STRING), 3, '0')) AS ICAO",
    "-(10 + CAST(n_nationkey AS DOUBLE)) AS LAT",
    "115 + CAST(1.5 AS DOUBLE) * n_nationkey AS LONG",
    "CASE n_nationkey % 5 WHEN 0 THEN 'Australia/Sydney' WHEN 1 THEN 'Australia/Perth' "
    "WHEN 2 THEN 'Australia/Adelaide' WHEN 3 THEN 'Asia/Kolkata' END AS tz",
]


def observations_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One observation per lineitem row (narrow: no shuffle, scan-pruned)."""
    mapped = lineitem.selectExpr(*_HELPERS).selectExpr(*_OBSERVATION_EXPRS)
    mapped = mapped.selectExpr("*", *_CALENDAR_EXPRS).select(*_COLUMN_ORDER)
    return normalize_observations(mapped)


def airports_from_nation(nation: DataFrame) -> DataFrame:
    """One airport per nation."""
    return nation.selectExpr(*_AIRPORT_EXPRS)


def load_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return observations_from_lineitem(lineitem)


def load_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return airports_from_nation(spark.read.parquet(f"{sf_dir}/nation.parquet"))
