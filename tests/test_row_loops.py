"""Statistics with involved rules against plain loops over rows, written from SURVEY's wording.

One station, one row at a time: sets of days, dicts of counts, the standard library's zones.
"""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timedelta, timezone
from statistics import mean
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from stratus.operators import current as A
from stratus.sources.fixture import load_airports, load_observations
from tests.helpers import airports_frame, obs_frame

STATION = "N002"   # Australia/Adelaide: half-hour offset and daylight saving


@pytest.fixture(scope="module")
def data(spark, sf001):
    obs = load_observations(spark, sf001).filter(F.col("TARGET_ICAO") == STATION)
    air = load_airports(spark, sf001)
    zone = ZoneInfo(air.filter(F.col("ICAO") == STATION).first().tz)
    return obs, air, [r.asDict() for r in obs.collect()], zone


def mentions(row, codes, *kinds):
    """Some code occurs in one of the row's two groups of the given kinds (DSC, PHENOM), whatever the case."""
    groups = [row[f"PRST_WX_{kind}_{i}"] for kind in kinds for i in (1, 2)]
    return any(code in group.upper() for group in groups if group for code in codes)


def nine_am_day(row, zone):
    """The calendar day that the local clock showed nine elapsed hours earlier."""
    return (row["TM_FULL"].replace(tzinfo=timezone.utc) - timedelta(hours=9)).astimezone(zone).date()


@pytest.mark.parametrize("utc, day", [("2023-09-30 22:30:00", "2023-09-30"), ("2023-10-01 22:30:00", "2023-10-02"), ("2023-04-01 22:30:00", "2023-04-02"),
                                      ("2023-06-01 22:59:00", "2023-06-01"), ("2023-06-01 23:00:00", "2023-06-02")])
def test_change_days(spark, utc, day):
    """The loop's day and the operator's around the change days of Sydney."""
    row = {"TM_FULL": datetime.fromisoformat(utc)}
    assert str(nine_am_day(row, ZoneInfo("Australia/Sydney"))) == day
    out = A.with_obs_day(obs_frame(spark, [{"TM_FULL": utc}]), airports_frame(spark, [("YAAA", 0.0, 0.0, "Australia/Sydney")]))
    assert str(out.first().obs_day) == day


def is_wet(row):
    return mentions(row, ["RA", "DZ", "SH", "TS"], "DSC", "PHENOM")


def mean_by(values, key):
    """{key of k: mean of the values whose k has it}."""
    out = defaultdict(list)
    for k, v in values.items():
        out[key(k)].append(v)
    return {k: mean(v) for k, v in out.items()}


def test_rain_thunder_days(data):
    obs, air, rows, zone = data
    days = {"Rain": set(), "Thunderstorm": set(), "all": set()}
    for r in rows:
        day = nine_am_day(r, zone)
        days["all"].add(day)
        if is_wet(r):
            days["Rain"].add(day)
        if mentions(r, ["TS"], "DSC"):
            days["Thunderstorm"].add(day)
    want = {}
    for kind in ("Rain", "Thunderstorm"):
        per_month = {(d.year, d.month): 0 for d in days["all"]}
        for d in days[kind]:
            per_month[d.year, d.month] += 1
        want |= {(m, kind): v for m, v in mean_by(per_month, lambda k: k[1]).items()}
    got = {(r.month, r.Type): r.avg_days for r in A.rain_thunder_days(obs, air).collect()}
    assert got == pytest.approx(want)


def test_temperature_daily_extremes(data):
    obs, air, rows, zone = data
    highs, lows = defaultdict(list), defaultdict(list)
    for r in rows:
        day = nine_am_day(r, zone)
        if r["AIR_TEMP"] is not None:
            highs[day].append(r["AIR_TEMP"])
        if r["DWPT"] is not None:
            lows[day].append(r["DWPT"])
    warmest = mean_by({d: max(v) for d, v in highs.items()}, lambda d: d.month)
    driest = mean_by({d: min(v) for d, v in lows.items()}, lambda d: d.month)
    for r in A.temp_dewpoint_daily_extremes(obs, air).collect():
        assert r.avg_daily_max_t == pytest.approx(warmest[r.month])
        assert r.avg_daily_min_td == pytest.approx(driest[r.month])


def test_fog_and_low_cloud_by_rain_day(data):
    obs, air, rows, zone = data
    wet = {nine_am_day(r, zone) for r in rows if is_wet(r)}
    got = {(r.is_rain_day, r.Type, r.Threshold, r.month): r.Count for r in A.fog_low_cloud_by_rain_day(obs, air).collect()}
    for split in {k[0] for k in got}:
        own = [r for r in rows if (nine_am_day(r, zone) in wet) == split]
        years = len({r["year"] for r in own})
        fog, cloud = defaultdict(int), defaultdict(int)
        for r in own:
            fog[r["month"]] += mentions(r, ["FG"], "PHENOM")
            amounts = [(r[f"CEIL_CLD_AMT_{i}"] or "").upper() for i in (1, 2)]
            if any(code in a for a in amounts for code in ("BKN", "OVC")):
                for i in (1, 2):
                    h = r[f"CEIL_CLD_HT_{i}"]
                    if h is not None:
                        # The lowest of the four ceilings that the height is under; above all of them it stays in the last.
                        limit = next((x for x in (500, 1000, 1500) if h < x), 2000)
                        cloud[r["month"], f"below {limit}ft"] += 1
        for (s, kind, band, month), v in got.items():
            if s == split:
                assert v == pytest.approx(fog[month] if kind == "Fog" else cloud[month, band] / years)


def test_gales(data):
    obs, _, rows, _ = data
    seen = defaultdict(int)
    for r in rows:
        if (r["WND_SPD"] or 0) > 17.49 or (r["MAX_WND_GUST_10"] or 0) > 21.09:
            if mentions(r, ["TS"], "DSC"):
                kind = "TS"
            elif mentions(r, ["SH"], "DSC") and mentions(r, ["RA"], "PHENOM"):
                kind = "SHRA"
            else:
                kind = "No wx"
            seen[r["year"], r["month"], kind] += 1
    want = mean_by(seen, lambda k: k[1:])
    got = {(r.month, r.category): r.avg_obs for r in A.gale_by_weather(obs).collect()}
    assert len(got) == 36
    assert got == pytest.approx({k: want.get(k, 0.0) for k in got})


def test_visibility_given_precip(data):
    obs, _, rows, _ = data
    sight = defaultdict(list)
    for r in rows:
        if r["WND_DIR"] is not None and r["VSBY"] is not None and mentions(r, ["RA", "DZ", "SN", "GS", "GR", "PL", "SH", "TS"], "DSC", "PHENOM"):
            nearest = min(range(0, 370, 10), key=lambda c: (abs(r["WND_DIR"] - c), -c))
            sight[nearest % 360].append(r["VSBY"])
    for r in A.visibility_given_precip(obs).collect():
        seen = sight[r.dir_bin_10]
        assert r.pct == pytest.approx(100 * sum(v < r.threshold for v in seen) / len(seen) if seen else 0)


def test_smoke_monthly(data):
    obs, _, rows, _ = data
    seen = defaultdict(int)
    for r in rows:
        code = next((c for c in ("FU", "DU", "SA", "VA") if mentions(r, [c], "PHENOM")), None)
        if code:
            seen[r["year"], r["month"], code] += 1
    got = {(r.month, r.phenomenon): r.avg_count for r in A.smoke_monthly(obs).collect()}
    assert got == pytest.approx(mean_by(seen, lambda k: k[1:]))
