"""Results as documents (S7): one JSON text per station and chart, with ordered column arrays.

A dashboard draws a chart from traces: a name, the values of the horizontal axis and the values of the vertical axis.
Long results are gathered in two ordered aggregates, first into traces, then into charts.  A trace holds at most a grid (12
months, 36 directions, 24 hours), so a document is bounded.  The smoke scatter has one point per observation: equal
points become one with its count, and a station's points are split into numbered parts of at most ``PART_POINTS``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.functions import constants as K

PART_POINTS = 1000


@dataclass(frozen=True)
class Chart:
    """Where a result's axis, trace names and values are; without ``series`` each value column is a trace."""

    axis: str | None
    series: tuple[str, ...]
    values: tuple[str, ...]


CHARTS: dict[str, Chart] = {
    "wind_rose": Chart("dir_bin", ("speed_range",), ("frequency",)),
    "rain_thunder": Chart("month", ("Type",), ("avg_days",)),
    "temp_dewpoint": Chart("month", (), ("avg_daily_max_t", "avg_daily_min_t", "avg_daily_max_td", "avg_daily_min_td")),
    "fog_low_cloud": Chart("month", ("Type", "Threshold"), ("Count",)),
    "gale_weather_split": Chart("month", ("category",), ("avg_obs",)),
    "monthly_precip": Chart("month", ("Type",), ("avg_days",)),
    "precip_split": Chart("dir_bin_10", ("label",), ("pct",)),
    "fog_low_cloud_by_rain_day": Chart("month", ("is_rain_day", "Type", "Threshold"), ("Count",)),
    "fog_low_cloud_wind_contours": Chart("dir_center", ("is_rain_day", "category", "level_idx"), ("radius",)),
    "monthly_smoke": Chart("month", ("phenomenon",), ("avg_count",)),
    "hourly_smoke": Chart("hour", ("phenomenon",), ("n_obs",)),
    "scatter_fit": Chart(None, ("phenomenon",), ("x_min", "y_min", "x_max", "y_max")),
    "radial_scatter_dust": Chart("dir_center", ("phenomenon", "level_idx"), ("radius",)),
    "metrics": Chart(None, (), ("observations", "mean_speed", "max_gust", "avg_temp")),
}
SCATTER = "scatter_wind_dewpt"
NAME_SEPARATOR = " / "


def _decimal(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).cast("decimal(24,6)")


def long_rows(result: DataFrame, chart: str, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """A result as rows (by, chart, trace, x, y); x is null for charts without an axis, y may be null."""
    c = CHARTS[chart]
    series = [F.col(s).cast("string") for s in c.series]
    several = len(c.values) > 1
    axis = F.col(c.axis).cast("double") if c.axis else F.lit(None).cast("double")
    points = F.array(*[F.struct(F.concat_ws(NAME_SEPARATOR, *series, *([F.lit(v)] if several else [])).alias("trace"), axis.alias("x"),
                                F.col(v).cast("double").alias("y")) for v in c.values])
    return result.select(*by, F.lit(chart).alias("chart"), F.inline(points))


def section_rows(results: Mapping[str, DataFrame], by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """All results of a section but the scatter as one long table."""
    out = None
    for chart in sorted(set(results) & set(CHARTS)):
        rows = long_rows(results[chart], chart, by)
        out = rows if out is None else out.unionByName(rows)
    return out


def chart_documents(rows: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """(by, chart, part, document) from the long rows of :func:`long_rows`: traces by name, points by x."""
    points = F.array_sort(F.collect_list(F.struct(_decimal("x").alias("x"), _decimal("y").alias("y"))))
    traces = rows.groupBy(*by, "chart", "trace").agg(points.alias("points"))
    traces = traces.select(*by, "chart", F.lit(0).alias("part"),
                           F.struct(F.col("trace").alias("name"), F.col("points.x").alias("x"), F.col("points.y").alias("y")).alias("trace"))
    return _gathered(traces, by)


def _gathered(traces: DataFrame, by: Sequence[str]) -> DataFrame:
    docs = traces.groupBy(*by, "chart", "part").agg(F.array_sort(F.collect_list("trace")).alias("traces"))
    return docs.select(*by, "chart", "part", F.to_json(F.struct("chart", "part", "traces"), {"ignoreNullFields": "false"}).alias("document"))


def scatter_documents(points: DataFrame, by: Sequence[str] = K.DEFAULT_BY, part_points: int = PART_POINTS) -> DataFrame:
    """The scatter (A12) as (by, chart, part, document): per code x, y and n, the number of observations at that point.

    Points are numbered per station in the order of code, x and y and cut into parts.  What is ordered per station are its
    distinct points, bounded by the resolution of the two measurements, not by its observations.
    """
    distinct = points.groupBy(*by, "phenomenon", "DWPT", "WND_SPD").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy("phenomenon", "DWPT", "WND_SPD")
    numbered = distinct.withColumn("part", F.floor((F.row_number().over(order) - 1) / F.lit(part_points)).cast("int"))
    point = F.struct(_decimal("DWPT").alias("x"), _decimal("WND_SPD").alias("y"), "n")
    traces = numbered.groupBy(*by, "part", "phenomenon").agg(F.array_sort(F.collect_list(point)).alias("points")).select(
        *by, F.lit(SCATTER).alias("chart"), "part", F.struct(F.col("phenomenon").alias("name"), F.col("points.x").alias("x"),
                                                            F.col("points.y").alias("y"), F.col("points.n").alias("n")).alias("trace"))
    return _gathered(traces, by)


def section_documents(results: Mapping[str, DataFrame], by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """One document per (by, chart) of a section's results, several numbered parts for the scatter."""
    docs = chart_documents(section_rows(results, by), by)
    return docs.unionByName(scatter_documents(results[SCATTER], by)) if SCATTER in results else docs
