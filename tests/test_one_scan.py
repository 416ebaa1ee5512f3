"""A section from one pass equals its single statistics, and scans the archive once."""

from __future__ import annotations

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from stratus.plans.sections import SECTIONS, section_cells, section_from_one_scan, section_results
from stratus.plans.shared import drop_saved
from stratus.sources.fixture import load_airports, load_observations
from stratus.sources.observations import read_observations
from tests.helpers import airports_frame, obs_frame


def rows(df):
    cols = sorted(df.columns)
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()],
                  key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("section", [*sorted(SECTIONS), "unknown"])
def test_equal_to_single_results(spark, sf001, section):
    obs, air = load_observations(spark, sf001), load_airports(spark, sf001)
    # Some times and stations unknown, so that the days of one statistic are not the rows of another.
    obs = obs.withColumn("TM_FULL", F.when(F.col("hour") % 7 > 0, F.col("TM_FULL")))
    want, got = section_results(obs, section, air), section_from_one_scan(obs, section, air)
    assert set(want) == set(got)
    for name in want:
        assert sorted(want[name].dtypes) == sorted(got[name].dtypes), name
        assert rows(want[name]) == rows(got[name]), name


def test_two_grouping_keys_and_odd_rows(spark):
    obs = obs_frame(spark, [{"TARGET_ICAO": s, "TM_FULL": t, "PRST_WX_PHENOM_1": p, "PRST_WX_DSC_1": d, "WND_DIR": w, "WND_SPD": 3.0}
                            for s in ("A", "B") for t in ("2020-01-01 03:00:00", "junk") for p in (None, "RA", "FG") for d in (None, "TS")
                            for w in (None, 10.0, 350.0)])
    air = airports_frame(spark, [("A", 1.0, 1.0, "Australia/Perth")])
    for section in SECTIONS:
        want, got = section_results(obs, section, air), section_from_one_scan(obs, section, air)
        for name in want:
            assert rows(want[name]) == rows(got[name]), (section, name)


def test_one_scan_of_the_archive(spark, sf001):
    path = tempfile.mkdtemp(prefix="stratus-archive-", dir="/tmp") + "/obs"
    load_observations(spark, sf001).write.parquet(path)
    table, _ = section_cells(read_observations(spark, path), "overview", load_airports(spark, sf001))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet [^\n]*" + re.escape(path.split("/")[-2]), plan)) == 1
    out = section_from_one_scan(read_observations(spark, path), "overview", load_airports(spark, sf001))
    for df in out.values():
        assert path.split("/")[-2] not in df._jdf.queryExecution().executedPlan().toString()
    assert drop_saved(spark) > 0
    with pytest.raises(Exception):
        out["wind_rose"].collect()
