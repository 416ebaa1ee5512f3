"""Plan-shape guards on a real Parquet observation archive: every statistic
scans the archive exactly once, reads only the columns it needs and gets the
selection pushed into the scan."""

from __future__ import annotations

import re
import tempfile

import pytest

from stratus.operators import contours as CN
from stratus.operators import current as A
from stratus.operators import monthly as M
from stratus.operators.filters import select_observations
from stratus.sources.fixture import load_airports, load_observations
from stratus.sources.observations import read_observations

STATS = {
    "A1": lambda o, a: A.wind_rose_pct(o), "A2": lambda o, a: A.rain_thunder_days(o, a),
    "A3": lambda o, a: A.temp_dewpoint_daily_extremes(o, a), "A4": lambda o, a: A.fog_monthly_count(o),
    "A5": lambda o, a: A.low_cloud_monthly_by_band(o), "A6": lambda o, a: A.fog_low_cloud_frequency(o),
    "A7": lambda o, a: A.fog_low_cloud_by_rain_day(o, a), "A8": lambda o, a: A.gale_by_weather(o),
    "A9": lambda o, a: A.visibility_given_precip(o), "A10": lambda o, a: A.smoke_monthly(o),
    "A11": lambda o, a: A.smoke_hourly(o), "A13": lambda o, a: A.smoke_linear_fit(o),
    "A14": lambda o, a: A.summary_metrics(o), "C6": lambda o, a: CN.fog_low_cloud_wind_contours(o, a),
    "C7": lambda o, a: CN.smoke_wind_contours(o), "U2": lambda o, a: M.paired_monthly_frequency(
        o, {"R": {"tokens": ["RA"], "fields": ["PRST_WX_PHENOM_1"]}}),
    "U3": lambda o, a: M.low_cloud_cumulative_frequency(o), "L7": lambda o, a: M.convective_split(o),
    "L8": lambda o, a: M.cloud_amount_distribution(o), "L10": lambda o, a: M.phenomenon_breakdown(o),
}


@pytest.fixture(scope="module")
def archive(spark, sf001):
    path = tempfile.mkdtemp(prefix="stratus-archive-", dir="/tmp") + "/obs"
    load_observations(spark, sf001).repartition(8).write.parquet(path)
    return path


@pytest.mark.parametrize("name", sorted(STATS))
def test_archive_scanned_once(spark, sf001, archive, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")   # untruncated PushedFilters
    obs = select_observations(read_observations(spark, archive), years=(1996, 2000),
                              months=("Apr", "Sep"), hours=(8, 20), invert_month=True, invert_hour=True)
    df = STATS[name](obs, load_airports(spark, sf001))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "== Final Plan ==" in plan:   # adaptive plans also print their initial plan
        plan = plan.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    scans = [m for m in re.findall(r"FileScan parquet \[[^\]]*\][^\n]*", plan) if "/obs]" in m or "obs," in m
             or archive.split("/")[-2] in m]
    assert len(scans) == 1, f"{name}: {len(scans)} scans of the archive"
    scan = scans[0]
    assert "Or(LessThanOrEqual(month,4),GreaterThanOrEqual(month,9))" in scan
    read_schema = re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1)
    assert len(read_schema.split(",")) < 19, f"{name} reads every column"
