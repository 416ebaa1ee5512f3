"""Dashboard sections as plans: one selection, several statistics.

A request of the original dashboard names a section and a selection (station,
year/month/hour ranges with optional inversion) and receives a fixed set of
statistics plus summary metrics.  Here a section is a dict of lazy
DataFrames over one shared selection; nothing runs until a result is
collected or written.  The selection may be computed for one station or for
all of them -- every statistic is grouped by station either way.

Sharing: the results of :func:`section_results` each scan the selection.
:func:`section_from_one_scan` computes a whole section from one pass: the
cells of all its statistics are one aggregate over several grains
(:mod:`stratus.plans.grains`), saved once, and every result is rolled up from that
small table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.functions import columns as C
from stratus.functions import constants as K
from stratus.operators import contours as CN
from stratus.operators import current as A
from stratus.operators import monthly as M
from stratus.operators.filters import select_observations
from stratus.plans.grains import Grain, cells_of, shared_cells
from stratus.plans.shared import save_small

Section = Callable[[DataFrame, DataFrame | None], dict[str, DataFrame]]

SECTIONS: dict[str, Section] = {
    "overview": lambda o, a: {
        "wind_rose": A.wind_rose_pct(o),
        "rain_thunder": A.rain_thunder_days(o, a),
        "temp_dewpoint": A.temp_dewpoint_daily_extremes(o, a),
        "fog_low_cloud": A.fog_low_cloud_frequency(o),
    },
    "wind": lambda o, a: {
        "wind_rose": A.wind_rose_pct(o),
        "gale_weather_split": A.gale_by_weather(o),
    },
    "precipitation": lambda o, a: {
        "monthly_precip": A.rain_thunder_days(o, a),
        "precip_split": A.visibility_given_precip(o),
    },
    "fog_low_cloud": lambda o, a: {
        "fog_low_cloud_by_rain_day": A.fog_low_cloud_by_rain_day(o, a),
        "fog_low_cloud_wind_contours": CN.fog_low_cloud_wind_contours(o, a),
    },
    "smoke_dust": lambda o, a: {
        "monthly_smoke": A.smoke_monthly(o),
        "hourly_smoke": A.smoke_hourly(o),
        "scatter_wind_dewpt": A.smoke_scatter(o),
        "scatter_fit": A.smoke_linear_fit(o),
        "radial_scatter_dust": CN.smoke_wind_contours(o),
    },
}

LEGACY_SECTIONS: dict[str, Section] = {
    "overview": lambda o, a: {
        "wind_rose": M.wind_rose_count(o),
        "temp_dewpoint": M.monthly_temp_extremes(o),
        "rain_thunder": M.monthly_rain_thunder(o),
        "fog_low_cloud": M.monthly_fog_low_cloud(o, K.LEGACY_FOG_TOKENS),
    },
    "wind": lambda o, a: {
        "wind_direction": M.wind_direction_count(o),
        "wind_speed_gust": M.monthly_wind_gust(o),
    },
    "precipitation": lambda o, a: {
        "rain_thunder": M.monthly_rain_thunder(o),
        "convective_split": M.convective_split(o),
    },
    "fog_low_cloud": lambda o, a: {
        "fog_low_cloud": M.monthly_fog_low_cloud(o, K.LEGACY_FOG_PAGE_TOKENS),
        "cloud_amounts": M.cloud_amount_distribution(o),
    },
    "smoke_dust": lambda o, a: {
        "monthly_smoke": M.monthly_smoke(o),
        "phenomenon_breakdown": M.phenomenon_breakdown(o),
    },
}


def section_results(selection: DataFrame, section: str = K.DEFAULT_SECTION, airports: DataFrame | None = None,
                    legacy: bool = False) -> dict[str, DataFrame]:
    """Statistics of one section over a selection, plus ``metrics``.

    Each result scans the selection (but see :func:`section_from_one_scan`).  An unknown
    section yields only the metrics, as the original service does.
    """
    table = LEGACY_SECTIONS if legacy else SECTIONS
    out = dict(table[section](selection, airports)) if section in table else {}
    out["metrics"] = A.summary_metrics(selection)
    return out


def run_section(obs: DataFrame, section: str = K.DEFAULT_SECTION, airports: DataFrame | None = None,
                icao: str | None = None, years: tuple[int, int] | None = None, months=K.DEFAULT_MONTH_RANGE,
                hours=K.DEFAULT_HOUR_RANGE, invert_month: bool = False, invert_hour: bool = False,
                legacy: bool = False) -> dict[str, DataFrame]:
    """:func:`section_results` over one selection (default: all years).

    Month names are validated (``ValueError("Invalid month range.")``).
    """
    selection = select_observations(obs, icao, years, months, hours, invert_month, invert_hour)
    return section_results(selection, section, airports, legacy)


# Per section and result: its grain (from the selection's columns) and the roll-up of the grain's cells.
Rollup = tuple[Callable[[set[str]], Grain], Callable[[DataFrame, Sequence[str]], DataFrame]]

ONE_SCAN: dict[str, dict[str, Rollup]] = {
    "overview": {
        "wind_rose": (lambda cols: A.rose_grain(), A.rose_from_cells),
        "rain_thunder": (A.rain_thunder_grain, A.rain_thunder_from_cells),
        "temp_dewpoint": (lambda cols: A.extremes_grain(), A.extremes_from_cells),
        "fog_low_cloud": (A.fog_cloud_grain, A.fog_cloud_from_cells),
    },
    "wind": {
        "wind_rose": (lambda cols: A.rose_grain(), A.rose_from_cells),
        "gale_weather_split": (lambda cols: A.gale_grain(), A.gales_from_cells),
    },
    "precipitation": {
        "monthly_precip": (A.rain_thunder_grain, A.rain_thunder_from_cells),
        "precip_split": (A.visibility_grain, A.visibility_from_cells),
    },
    "fog_low_cloud": {
        "fog_low_cloud_by_rain_day": (lambda cols: A.fog_cloud_grain(cols, ("is_rain_day",)),
                                      lambda cells, by: A.fog_cloud_from_cells(cells, [*by, "is_rain_day"])),
        "fog_low_cloud_wind_contours": (lambda cols: CN.fog_wind_grain(), CN.fog_wind_from_cells),
    },
    "smoke_dust": {
        "monthly_smoke": (lambda cols: A.smoke_month_grain(), A.smoke_month_from_cells),
        "hourly_smoke": (lambda cols: A.smoke_hour_grain(), lambda cells, by: cells),
        "scatter_fit": (lambda cols: A.smoke_fit_grain(), A.smoke_fit_from_cells),
        "radial_scatter_dust": (lambda cols: CN.smoke_wind_grain(), CN.smoke_wind_from_cells),
    },
}

# Sections whose results need the local 9 am day.
_BY_DAY = {"overview", "precipitation", "fog_low_cloud"}


def section_cells(selection: DataFrame, section: str, airports: DataFrame | None = None,
                  by: Sequence[str] = K.DEFAULT_BY) -> tuple[DataFrame, dict[str, Grain]]:
    """The shared cells of a section's results (and ``metrics``), not yet computed, and the grain of each."""
    cols = set(selection.columns)
    grains = {name: grain(cols) for name, (grain, _) in ONE_SCAN.get(section, {}).items()} | {"metrics": A.metrics_grain()}
    rows = A.with_obs_day(selection, airports, by, keep_unparsed=True) if section in _BY_DAY else selection
    if section == "fog_low_cloud":
        # The split needs the rain days first: a scan of its own, of the time and the weather fields.
        rows = C.with_cloud_columns(A.with_rain_day(rows, A.rain_days(selection, airports, by), by))
        rows = rows.withColumn("is_rain_day", F.when(F.col("obs_day").isNotNull(), F.col("is_rain_day")))
    return shared_cells(rows, by, list(grains.values())), grains


def section_from_one_scan(selection: DataFrame, section: str = K.DEFAULT_SECTION, airports: DataFrame | None = None,
                          by: Sequence[str] = K.DEFAULT_BY) -> dict[str, DataFrame]:
    """:func:`section_results` of the current generation from one pass over the selection.

    Runs the pass now and saves its cells, which are bounded by stations times days, months and bins.  Row-level results (the
    smoke scatter) are no aggregates and keep their own scan.  In ``fog_low_cloud`` the rain days take a second one.
    """
    table, grains = section_cells(selection, section, airports, by)
    table = save_small(table, f"section-{section}")
    shared = list(grains.values())
    rollups = {name: rollup for name, (_, rollup) in ONE_SCAN.get(section, {}).items()} | {"metrics": lambda cells, by: cells}
    out = {name: rollups[name](cells_of(table, by, shared, grain), list(by)) for name, grain in grains.items()}
    if section == "smoke_dust":
        out["scatter_wind_dewpt"] = A.smoke_scatter(selection, by)
    return out
