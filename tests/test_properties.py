"""Properties: per-station results equal filter-then-compute, shares sum to
100, cumulative thresholds are monotone, partitioning does not matter."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from stratus.operators import contours as CN
from stratus.operators import current as A
from stratus.operators import monthly as M
from stratus.sources.fixture import load_airports, load_observations


@pytest.fixture(scope="module")
def obs(spark, sf001):
    return load_observations(spark, sf001).cache()


@pytest.fixture(scope="module")
def air(spark, sf001):
    return load_airports(spark, sf001)


def _rows(df, digits=9):
    out = []
    for r in df.collect():
        out.append(tuple(round(v, digits) if isinstance(v, float) else v for v in r))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


OPS = {
    "rose": lambda o, a: A.wind_rose_pct(o),
    "rain": lambda o, a: A.rain_thunder_days(o, a),
    "temp": lambda o, a: A.temp_dewpoint_daily_extremes(o, a),
    "split": lambda o, a: A.fog_low_cloud_by_rain_day(o, a),
    "bands": lambda o, a: A.low_cloud_monthly_by_band(o),
    "gale": lambda o, a: A.gale_by_weather(o),
    "vis": lambda o, a: A.visibility_given_precip(o),
    "smoke": lambda o, a: A.smoke_monthly(o),
    "cum": lambda o, a: M.low_cloud_cumulative_frequency(o),
    "c7": lambda o, a: CN.smoke_wind_contours(o),
    "c6": lambda o, a: CN.fog_low_cloud_wind_contours(o, a),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_station_slice_equals_filter_then_compute(obs, air, name):
    station = "N003"
    op = OPS[name]
    whole = op(obs, air).filter(F.col("TARGET_ICAO") == station)
    alone = op(obs.filter(F.col("TARGET_ICAO") == station), air)
    assert _rows(whole) == _rows(alone)


def test_rose_sums_to_100(obs):
    sums = A.wind_rose_pct(obs).groupBy("TARGET_ICAO").agg(F.sum("frequency").alias("s")).collect()
    assert sums and all(math.isclose(r.s, 100.0, rel_tol=1e-12) for r in sums)


def test_visibility_monotone_in_threshold(obs):
    rows = A.visibility_given_precip(obs).collect()
    cells = {}
    for r in rows:
        cells.setdefault((r.TARGET_ICAO, r.dir_bin_10), []).append((r.threshold, r.pct))
    for vals in cells.values():
        pcts = [p for _, p in sorted(vals)]
        assert pcts == sorted(pcts) and len(pcts) == 4


@pytest.mark.parametrize("name", ["rain", "split", "c7"])
def test_partitioning_and_order_do_not_matter(obs, air, name):
    op = OPS[name]
    a = op(obs.repartition(1), air)
    b = op(obs.repartition(7, "hour").sortWithinPartitions(F.desc("TM_FULL")), air)
    assert _rows(a) == _rows(b)


def test_dense_shapes(obs):
    n_st = obs.select("TARGET_ICAO").distinct().count()
    assert A.gale_by_weather(obs).count() == n_st * 36
    assert A.fog_monthly_count(obs).count() == n_st * 12
    assert A.low_cloud_monthly_by_band(obs).count() == n_st * 48
