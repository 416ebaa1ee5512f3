"""Section runner, result sink and the streaming observation source."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from stratus.plans.sections import LEGACY_SECTIONS, SECTIONS, run_section
from stratus.sources.fixture import load_airports, load_observations
from stratus.sources.observations import read_observations
from stratus.sources.sinks import write_result, write_results
from stratus.streaming import append_observations, read_observations_stream


@pytest.fixture(scope="module")
def obs(spark, sf001):
    return load_observations(spark, sf001)


@pytest.mark.parametrize("legacy", [False, True])
@pytest.mark.parametrize("section", sorted(SECTIONS))
def test_sections_run(spark, sf001, obs, section, legacy):
    air = load_airports(spark, sf001)
    out = run_section(obs, section, air, icao="N001", years=(1995, 2001), months=("Mar", "Oct"),
                      hours=(6, 20), invert_hour=True, legacy=legacy)
    expected = set((LEGACY_SECTIONS if legacy else SECTIONS)[section](obs, air)) | {"metrics"}
    assert set(out) == expected
    for name, df in out.items():
        stations = {r[0] for r in df.select("TARGET_ICAO").distinct().collect()}
        assert stations <= {"N001"}, name


def test_unknown_section_gives_metrics_only(obs):
    out = run_section(obs, "nope")
    assert list(out) == ["metrics"]


def test_empty_selection_keeps_schema(obs):
    out = run_section(obs, "wind", icao="NONE")
    for df in out.values():
        assert df.count() == 0 and df.columns


def test_invalid_month_name(obs):
    with pytest.raises(ValueError, match="Invalid month range"):
        run_section(obs, "wind", months=("Jan", "Foo"))


def test_write_and_read_back(spark, obs):
    root = tempfile.mkdtemp(prefix="stratus-sink-", dir="/tmp")
    out = run_section(obs, "wind")
    paths = write_results(out, root)
    back = spark.read.parquet(paths["gale_weather_split"])
    assert back.count() == out["gale_weather_split"].count()
    write_result(out["metrics"], root + "/metrics_json", fmt="json")
    assert spark.read.json(root + "/metrics_json").count() == out["metrics"].count()


def test_stream_appends_to_archive(spark, obs):
    root = tempfile.mkdtemp(prefix="stratus-stream-", dir="/tmp")
    incoming, archive, ckpt = (os.path.join(root, p) for p in ("in", "archive", "ckpt"))
    obs.filter(F.col("year") == 1996).write.parquet(incoming + "/batch1")
    stream = read_observations_stream(spark, incoming + "/*")
    q = append_observations(stream, archive, ckpt, available_now=True)
    q.awaitTermination(120)
    got = read_observations(spark, archive)
    assert got.count() == obs.filter(F.col("year") == 1996).count()
    # A second batch of files is picked up by a restarted query (checkpointed progress).
    obs.filter(F.col("year") == 1997).write.parquet(incoming + "/batch2")
    q = append_observations(read_observations_stream(spark, incoming + "/*"), archive, ckpt, available_now=True)
    q.awaitTermination(120)
    assert read_observations(spark, archive).count() == obs.filter(F.col("year").isin(1996, 1997)).count()


def test_read_airports_csv_and_zone_default(spark):
    from stratus.sources.airports import read_airports, with_timezone
    from tests.helpers import obs_frame
    root = tempfile.mkdtemp(prefix="stratus-csv-", dir="/tmp")
    with open(os.path.join(root, "airports.csv"), "w") as fh:
        fh.write("ICAO,LAT,LONG\nYSSY,-33.9,151.2\nYPPH,-31.9,abc\n")
    air = read_airports(spark, os.path.join(root, "airports.csv"))
    assert [f.name for f in air.schema.fields] == ["ICAO", "LAT", "LONG", "tz"]
    got = {r.ICAO: (r.LONG, r.tz) for r in air.collect()}
    assert got == {"YSSY": (151.2, None), "YPPH": (None, None)}
    obs = obs_frame(spark, [{"TARGET_ICAO": "YSSY"}, {"TARGET_ICAO": "ZZZZ"}])
    assert {r.tz for r in with_timezone(obs, air).collect()} == {"UTC"}


def test_a_changed_dimension_is_joined_as_it_is(spark, obs):
    """The zone join carries no hint of its own: Spark decides from the sizes it measures."""
    from stratus.sources.airports import with_timezone
    root = tempfile.mkdtemp(prefix="stratus-dim-", dir="/tmp") + "/airports"
    for n in (5, 5000):
        rows = spark.range(n).selectExpr("concat('N', lpad(cast(id as string), 3, '0')) AS ICAO", "0D AS LAT", "0D AS LONG",
                                         "'Australia/Perth' AS tz")
        rows.write.mode("overwrite").parquet(root)
        out = with_timezone(obs, spark.read.parquet(root))
        assert "ResolvedHint" not in out._jdf.queryExecution().analyzed().toString()
        known = out.filter("tz = 'Australia/Perth'").select("TARGET_ICAO").distinct().count()
        assert known == obs.filter(F.substring("TARGET_ICAO", 2, 3).cast("int") < n).select("TARGET_ICAO").distinct().count() > 0


def test_a_bad_zone_on_the_observations_is_utc(spark):
    from stratus.sources.airports import with_timezone
    df = spark.createDataFrame([("A", "Not/AZone"), ("B", "Australia/Perth"), ("C", None), ("D", "+10:00")], "TARGET_ICAO string, tz string")
    assert {r.TARGET_ICAO: r.tz for r in with_timezone(df, None).collect()} == {"A": "UTC", "B": "Australia/Perth", "C": "UTC", "D": "+10:00"}


def test_all_years_by_default(obs):
    from stratus.operators.filters import select_observations
    early = obs.withColumn("year", F.col("year") - 100)
    assert select_observations(early).count() == obs.count()
    assert run_section(early, "nope")["metrics"].count() == run_section(obs, "nope")["metrics"].count() > 0


def test_figure_maximum_sees_the_grid_not_the_days(spark):
    """C6 with one station holding most rows: what is exchanged by (station, split) does not grow with the days."""
    from stratus.operators.contours import fog_low_cloud_wind_contours
    from stratus.sources.observations import normalize_observations

    def plan_rows(days):
        df = spark.range(days * 24).selectExpr(
            "if(id % 3 = 0, 'N001', concat('N', id % 7)) AS TARGET_ICAO", "timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) AS TM_FULL",
            "cast(id % 36 * 10 as double) AS WND_DIR", "cast(id % 20 as double) AS WND_SPD", "'FG' AS PRST_WX_PHENOM_1", "cast(null as string) AS PRST_WX_PHENOM_2",
            "if(id % 50 = 0, 'SH', cast(null as string)) AS PRST_WX_DSC_1", "cast(null as string) AS PRST_WX_DSC_2", "cast(null as string) AS CEIL_CLD_AMT_1",
            "cast(null as string) AS CEIL_CLD_AMT_2", "cast(null as double) AS CEIL_CLD_HT_1", "cast(null as double) AS CEIL_CLD_HT_2",
            "2000 AS year", "1 AS month", "1 AS hour")
        out = fog_low_cloud_wind_contours(normalize_observations(df))
        out.collect()
        text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
        lines = text.splitlines()
        at = next(i for i, line in enumerate(lines) if "Window [" in line and "max_spd" in line)
        # Below the window: its exchange, which carries the summed grid, not the day cells.
        return [line for line in lines[at + 1:] if "Aggregate" in line or "Window" in line][0]
    assert "Aggregate" in plan_rows(30) and "obs_day" not in plan_rows(30)


def test_archive_layout_prunes_year_and_pushes_station(spark, obs):
    from stratus.operators.filters import select_observations
    from stratus.sources.observations import write_observations
    path = tempfile.mkdtemp(prefix="stratus-layout-", dir="/tmp") + "/obs"
    write_observations(obs, path, files=4)
    back = read_observations(spark, path)
    assert back.count() == obs.count()
    assert sorted(back.columns) == sorted(obs.columns)
    sel = select_observations(back, icao="N001", years=(1997, 1998))
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "EqualTo(TARGET_ICAO,N001)" in plan
    assert sel.count() == obs.filter("TARGET_ICAO = 'N001' AND year BETWEEN 1997 AND 1998").count()
