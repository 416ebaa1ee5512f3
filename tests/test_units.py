"""Golden unit rows for the traps listed in FIXTURES.md section 3."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from stratus.functions import columns as C
from stratus.functions import constants as K
from stratus.operators import current as A
from stratus.operators import monthly as M
from stratus.operators.filters import month_number, range_filter, select_observations
from tests.helpers import airports_frame, as_dicts, obs_frame


def _band(kt: float) -> str:
    for edge, label in zip(K.SPEED_BAND_EDGES, K.SPEED_BAND_LABELS):
        if kt < edge:
            return label
    return K.SPEED_BAND_LABELS[-1]


# --- direction bins ------------------------------------------------------------

DIRS = [0.0, 11.24, 11.25, 348.74, 348.75, 355.0, 359.99, 360.0]


def test_dir_bin_16_edges(spark):
    df = obs_frame(spark, [{"WND_DIR": d} for d in DIRS])
    got = [r[0] for r in df.select(C.dir_bin_16("WND_DIR")).collect()]
    assert got == [0.0, 0.0, 22.5, 337.5, 0.0, 0.0, 0.0, 0.0]


def test_dir_bin_10_edges(spark):
    df = obs_frame(spark, [{"WND_DIR": d} for d in [0.0, 4.99, 5.0, 354.99, 355.0, 360.0]])
    got = [r[0] for r in df.select(C.dir_bin_10("WND_DIR")).collect()]
    assert got == [0, 0, 10, 350, 0, 0]


def test_rose_drops_null_and_nan_direction(spark):
    rows = [{"WND_DIR": d, "WND_SPD": 3.0} for d in DIRS] + [
        {"WND_DIR": None, "WND_SPD": 3.0}, {"WND_DIR": float("nan"), "WND_SPD": 3.0}]
    rose = as_dicts(A.wind_rose_pct(obs_frame(spark, rows)), "dir_bin")
    assert sum(r["n_obs"] for r in rose) == len(DIRS)
    assert math.isclose(sum(r["frequency"] for r in rose), 100.0)
    assert {r["dir_bin"] for r in rose} == {0.0, 22.5, 337.5}


# --- speed bands ---------------------------------------------------------------

@pytest.mark.parametrize("kt", [0.99, 1.0, 5.0, 10.0, 15.0, 22.0])
def test_speed_band_from_mps(spark, kt):
    mps = kt / K.MPS_TO_KT
    df = obs_frame(spark, [{"WND_SPD": mps}])
    got = df.select(C.speed_band("WND_SPD")).first()[0]
    assert got == _band(mps * K.MPS_TO_KT)


@pytest.mark.parametrize("raw", [0.99, 1.0, 5.0, 10.0, 15.0, 22.0])
def test_speed_band_raw(spark, raw):
    df = obs_frame(spark, [{"WND_SPD": raw}])
    assert df.select(C.speed_band("WND_SPD", 1.0)).first()[0] == _band(raw)


def test_speed_band_null(spark):
    df = obs_frame(spark, [{"WND_SPD": None}])
    assert df.select(C.speed_band("WND_SPD")).first()[0] is None


# --- range filter -------------------------------------------------------------

def test_range_filter_plain_and_inverted(spark):
    df = obs_frame(spark, [{"hour": h} for h in range(24)] + [{"hour": None}])
    plain = sorted(r.hour for r in range_filter(df, "hour", 6, 18).collect())
    inv = sorted(r.hour for r in range_filter(df, "hour", 6, 18, invert=True).collect())
    assert plain == list(range(6, 19))
    assert inv == list(range(0, 7)) + list(range(18, 24))   # both ends in both forms
    assert set(plain) | set(inv) == set(range(24))


def test_range_filter_start_equals_end(spark):
    df = obs_frame(spark, [{"hour": h} for h in range(24)])
    assert [r.hour for r in range_filter(df, "hour", 5, 5).collect()] == [5]
    assert len(range_filter(df, "hour", 5, 5, invert=True).collect()) == 24


def test_reversed_plain_range_selects_nothing(spark):
    df = obs_frame(spark, [{"year": y} for y in (2000, 2001, 2002)])
    assert select_observations(df, years=(2002, 2000)).count() == 0
    with pytest.raises(ValueError):
        select_observations(df, years=(2002, 2000), strict=True)


def test_month_names():
    assert month_number("Jan") == 1 and month_number("Dec") == 12 and month_number(7) == 7
    with pytest.raises(ValueError, match="Invalid month range"):
        month_number("Foo")


def test_select_one_station(spark):
    df = obs_frame(spark, [{"TARGET_ICAO": "A"}, {"TARGET_ICAO": "B"}])
    got = select_observations(df, icao="A", years=(2000, 2025)).collect()
    assert [r.TARGET_ICAO for r in got] == ["A"]


# --- 9 am day -----------------------------------------------------------------

NINE_AM = [
    ("2023-09-30 22:30:00", "2023-09-30"),
    ("2023-10-01 22:30:00", "2023-10-02"),
    ("2023-04-01 22:30:00", "2023-04-02"),
    ("2023-06-01 22:59:00", "2023-06-01"),
    ("2023-06-01 23:00:00", "2023-06-02"),
]


def test_obs_day_sydney_dst(spark):
    df = obs_frame(spark, [{"TARGET_ICAO": "YSSY", "TM_FULL": t} for t, _ in NINE_AM])
    air = airports_frame(spark, [("YSSY", -33.9, 151.2, "Australia/Sydney")])
    got = as_dicts(A.with_obs_day(df, air).select(F.col("TM_FULL").cast("string").alias("t"),
                                                  F.col("obs_day").cast("string").alias("d")))
    assert {r["t"]: r["d"] for r in got} == dict(NINE_AM)


def test_obs_day_independent_of_session_zone(spark):
    df = obs_frame(spark, [{"TARGET_ICAO": "YSSY", "TM_FULL": t} for t, _ in NINE_AM])
    air = airports_frame(spark, [("YSSY", -33.9, 151.2, "Australia/Sydney")])
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = as_dicts(A.with_obs_day(df, air).select(F.col("TM_FULL").cast("string").alias("t"),
                                                      F.col("obs_day").cast("string").alias("d")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert {r["t"]: r["d"] for r in got} == dict(NINE_AM)


def test_obs_day_unparsable_and_unknown_station(spark):
    df = obs_frame(spark, [
        {"TARGET_ICAO": "YSSY", "TM_FULL": "not a time"},
        {"TARGET_ICAO": "XXXX", "TM_FULL": "2023-06-01 08:00:00"},
        {"TARGET_ICAO": "NOTZ", "TM_FULL": "2023-06-01 09:00:00"},
        {"TARGET_ICAO": "YSSY", "TM_FULL": "2023-06-01T08:00:00Z"},
        {"TARGET_ICAO": "YSSY", "TM_FULL": "2023-06-01T18:00:00+10:00"},
    ])
    air = airports_frame(spark, [("YSSY", -33.9, 151.2, "Australia/Sydney"), ("NOTZ", 0.0, 0.0, None)])
    got = as_dicts(A.with_obs_day(df, air).select("TARGET_ICAO", "tz", F.col("obs_day").cast("string").alias("d")),
                   "TARGET_ICAO", "d")
    assert got == [
        {"TARGET_ICAO": "NOTZ", "tz": "UTC", "d": "2023-06-01"},
        {"TARGET_ICAO": "XXXX", "tz": "UTC", "d": "2023-05-31"},
        {"TARGET_ICAO": "YSSY", "tz": "Australia/Sydney", "d": "2023-06-01"},
        {"TARGET_ICAO": "YSSY", "tz": "Australia/Sydney", "d": "2023-06-01"},
    ]


def test_unusable_zone_falls_back_to_utc(spark):
    df = obs_frame(spark, [{"TARGET_ICAO": "BAD", "TM_FULL": "2023-06-01 08:00:00"},
                           {"TARGET_ICAO": "OFF", "TM_FULL": "2023-06-01 08:00:00"}])
    air = airports_frame(spark, [("BAD", 0.0, 0.0, "Mars/Base"), ("OFF", 0.0, 0.0, "+10:00")])
    got = {r.TARGET_ICAO: (r.tz, str(r.obs_day)) for r in A.with_obs_day(df, air).collect()}
    assert got == {"BAD": ("UTC", "2023-05-31"), "OFF": ("+10:00", "2023-06-01")}


def test_parse_utc_ignores_session_zone(spark):
    df = obs_frame(spark, [{"TM_FULL": "2023-06-01T18:00:00+10:00"}, {"TM_FULL": "2023-06-01 08:00:00"}])
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [str(r[0]) for r in df.select("TM_FULL").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == ["2023-06-01 08:00:00", "2023-06-01 08:00:00"]


# --- tokens -------------------------------------------------------------------

def test_token_rules(spark):
    rows = [
        {},                                                    # all null
        {"PRST_WX_PHENOM_1": "ra"},                            # lower case
        {"PRST_WX_PHENOM_1": "+RA"},                           # intensity prefix
        {"PRST_WX_PHENOM_2": "RA"},                            # only the second field
        {"PRST_WX_DSC_1": "TS"},                               # descriptor-only TS
        {"PRST_WX_PHENOM_1": "TS"},                            # phenomenon-only TS
    ]
    df = obs_frame(spark, rows)
    got = df.select(C.is_rain_obs().alias("rain"), C.is_thunder_obs().alias("ts"),
                    C.phenom_mask(["RA"]).alias("ra")).collect()
    assert [(r.rain, r.ts, r.ra) for r in got] == [
        (False, False, False), (True, False, True), (True, False, True), (True, False, True),
        (True, True, False), (True, False, False)]


def test_token_mask_missing_fields(spark):
    df = obs_frame(spark, [{"PRST_WX_PHENOM_1": "FG"}]).drop("PRST_WX_PHENOM_1", "PRST_WX_PHENOM_2")
    assert df.select(C.phenom_mask(["FG"], df.columns)).first()[0] is False


def test_legacy_thunder_on_phenomenon_only(spark):
    df = obs_frame(spark, [{"PRST_WX_DSC_1": "TS"}, {"PRST_WX_PHENOM_1": "TS"}])
    got = as_dicts(M.convective_split(df), "Type")
    assert [(r["Type"], r["Count"]) for r in got] == [("Rain", 0), ("Thunderstorm", 1)]


# --- cloud --------------------------------------------------------------------

def _bands(df):
    got = {(r["month"], r["threshold"]): r["avg_obs"] for r in as_dicts(A.low_cloud_monthly_by_band(df))}
    return {k: v for k, v in got.items() if v}


def test_other_layer_height_counts(spark):
    # Layer 2 is the ceiling, but both heights enter the band statistic.
    df = obs_frame(spark, [{"CEIL_CLD_AMT_1": "FEW", "CEIL_CLD_HT_1": 400, "CEIL_CLD_AMT_2": "BKN",
                            "CEIL_CLD_HT_2": 1800}])
    assert _bands(df) == {(1, "below 500ft"): 1.0, (1, "below 2000ft"): 1.0}


def test_band_top_is_open_and_null_or_text_heights(spark):
    df = obs_frame(spark, [
        {"CEIL_CLD_AMT_1": "OVC", "CEIL_CLD_HT_1": 2500},
        {"CEIL_CLD_AMT_1": "BKN", "CEIL_CLD_HT_1": None},
        {"CEIL_CLD_AMT_1": "BKN020", "CEIL_CLD_HT_1": "1200"},
        {"CEIL_CLD_AMT_1": "BKN", "CEIL_CLD_HT_1": "abc"},
    ])
    assert _bands(df) == {(1, "below 2000ft"): 1.0, (1, "below 1500ft"): 1.0}


def test_band_divides_by_distinct_years_of_all_input(spark):
    df = obs_frame(spark, [
        {"CEIL_CLD_AMT_1": "BKN", "CEIL_CLD_HT_1": 300, "year": 2020},
        {"year": 2021}, {"year": 2022}, {"year": 2023},
    ])
    assert _bands(df) == {(1, "below 500ft"): 0.25}
    assert len(as_dicts(A.low_cloud_monthly_by_band(df))) == 48


def test_layered_flags_not_exclusive(spark):
    df = C.with_cloud_columns(obs_frame(spark, [
        {"CEIL_CLD_AMT_1": "bkn", "CEIL_CLD_HT_1": 1600, "CEIL_CLD_AMT_2": "OVC", "CEIL_CLD_HT_2": 400}]))
    r = df.select(*[C.layered_ceiling_flag(lo, hi).alias(lab) for lab, lo, hi in K.LOW_CLOUD_LAYERS]).first()
    assert [r[i] for i in range(4)] == [True, False, False, True]


def test_legacy_ceiling_prefix_is_case_sensitive(spark):
    df = obs_frame(spark, [{"CEIL_CLD_AMT_1": "bkn"}, {"CEIL_CLD_AMT_1": "BKN"}, {"PRST_WX_PHENOM_1": "BR"}])
    fg = as_dicts(M.monthly_fog_low_cloud(df))
    br = as_dicts(M.monthly_fog_low_cloud(df, K.LEGACY_FOG_PAGE_TOKENS))
    assert fg[0]["fog_low_cloud"] == 1 and br[0]["fog_low_cloud"] == 2


def test_fog_count_is_raw_total(spark):
    df = obs_frame(spark, [{"PRST_WX_PHENOM_1": "FG", "year": y} for y in (2020, 2021, 2022)])
    got = {r["month"]: r["fog_obs"] for r in as_dicts(A.fog_monthly_count(df))}
    assert got[1] == 3.0 and sum(got.values()) == 3.0 and len(got) == 12


# --- averaging ----------------------------------------------------------------

def test_rain_days_average_includes_zero_months(spark):
    # Year 2020: two rain days in January; year 2021: January observed, dry.
    rows = [{"TM_FULL": "2020-01-10 03:00:00", "PRST_WX_PHENOM_1": "RA"},
            {"TM_FULL": "2020-01-11 03:00:00", "PRST_WX_DSC_1": "SH"},
            {"TM_FULL": "2020-01-11 04:00:00", "PRST_WX_PHENOM_1": "RA"},
            {"TM_FULL": "2021-01-10 03:00:00"}]
    got = {r["Type"]: r["avg_days"] for r in as_dicts(A.rain_thunder_days(obs_frame(spark, rows), None))}
    assert got == {"Rain": 1.0, "Thunderstorm": 0.0}


def test_gale_average_excludes_years_without_gales(spark):
    rows = [{"WND_SPD": 20.0, "year": 2020}, {"WND_SPD": 20.0, "year": 2020},
            {"WND_SPD": 20.0, "year": 2021}, {"WND_SPD": 1.0, "year": 2022}]
    got = {(r["month"], r["category"]): r["avg_obs"] for r in as_dicts(A.gale_by_weather(obs_frame(spark, rows)))}
    assert len(got) == 36
    assert got[(1, "No wx")] == 1.5 and got[(1, "TS")] == 0.0 and got[(2, "No wx")] == 0.0


def test_smoke_average_over_years_present(spark):
    rows = [{"PRST_WX_PHENOM_1": "FU", "year": 2020}, {"PRST_WX_PHENOM_1": "FU", "year": 2020},
            {"PRST_WX_PHENOM_1": "FU", "year": 2021}, {"year": 2022}]
    got = as_dicts(A.smoke_monthly(obs_frame(spark, rows)))
    assert [(r["phenomenon"], r["avg_count"]) for r in got] == [("FU", 1.5)]


def test_paired_frequency_includes_zero_year_months(spark):
    rows = [{"PRST_WX_PHENOM_1": "RA", "year": 2020}, {"year": 2021}]
    cats = {"Rain": {"tokens": ["RA"], "fields": K.PHENOM_FIELDS}}
    got = as_dicts(M.paired_monthly_frequency(obs_frame(spark, rows), cats))
    assert [(r["Type"], r["Count"]) for r in got] == [("Rain", 0.5)]


# --- gale ---------------------------------------------------------------------

def test_gale_thresholds_and_categories(spark):
    rows = [
        {"WND_SPD": 17.49}, {"MAX_WND_GUST_10": 21.09},                       # not gales (strict)
        {"WND_SPD": None, "MAX_WND_GUST_10": 30.0},                          # gust only
        {"WND_SPD": 20.0, "PRST_WX_DSC_1": "SH", "PRST_WX_PHENOM_1": "RA"},   # SHRA
        {"WND_SPD": 20.0, "PRST_WX_DSC_1": "SH", "PRST_WX_PHENOM_1": "RA", "PRST_WX_DSC_2": "TS"},  # TS wins
    ]
    df = obs_frame(spark, rows)
    got = df.select(C.is_gale().alias("g"), C.gale_category().alias("c")).collect()
    assert [(r.g, r.c) for r in got] == [(False, "No wx"), (False, "No wx"), (True, "No wx"),
                                        (True, "SHRA"), (True, "TS")]


# --- smoke --------------------------------------------------------------------

def test_phenomenon_priority_and_fit_conditions(spark):
    rows = [
        {"TARGET_ICAO": "A", "PRST_WX_PHENOM_1": "DU", "PRST_WX_PHENOM_2": "FU", "DWPT": 1.0, "WND_SPD": 2.0},
        {"TARGET_ICAO": "B", "PRST_WX_PHENOM_1": "DU", "DWPT": 1.0, "WND_SPD": 2.0},      # one point
        {"TARGET_ICAO": "C", "PRST_WX_PHENOM_1": "sa", "DWPT": 5.0, "WND_SPD": 2.0},
        {"TARGET_ICAO": "C", "PRST_WX_PHENOM_1": "SA", "DWPT": 5.0, "WND_SPD": 4.0},      # same x
        {"TARGET_ICAO": "D", "PRST_WX_PHENOM_1": "VA", "DWPT": 0.0, "WND_SPD": 1.0},
        {"TARGET_ICAO": "D", "PRST_WX_PHENOM_1": "VA", "DWPT": 2.0, "WND_SPD": 5.0},
    ]
    df = obs_frame(spark, rows)
    codes = as_dicts(A.smoke_observations(df).select("TARGET_ICAO", "phenomenon"), "TARGET_ICAO")
    assert codes[0] == {"TARGET_ICAO": "A", "phenomenon": "FU"}
    fit = as_dicts(A.smoke_linear_fit(df))
    assert len(fit) == 1 and fit[0]["TARGET_ICAO"] == "D"
    assert math.isclose(fit[0]["slope"], 2.0) and math.isclose(fit[0]["intercept"], 1.0)
    assert math.isclose(fit[0]["y_max"], 5.0)


def test_breakdown_keeps_zero_codes_and_counts_rows_twice(spark):
    df = obs_frame(spark, [{"PRST_WX_PHENOM_1": "FU", "PRST_WX_PHENOM_2": "HZ"}])
    got = {r["phenomenon"]: r["n_obs"] for r in as_dicts(M.phenomenon_breakdown(df))}
    assert got == {"FU": 1, "DU": 0, "SA": 0, "HZ": 1, "VA": 0}


# --- summary and options ------------------------------------------------------

def test_summary_all_null_column(spark):
    df = obs_frame(spark, [{"WND_SPD": None, "AIR_TEMP": 10.0}, {"WND_SPD": float("nan"), "AIR_TEMP": 20.0}])
    r = A.summary_metrics(df).first()
    assert r.observations == 2 and r.mean_speed is None and r.avg_temp == 15.0


def test_options_default_airport(spark):
    from stratus.sources.airports import options
    assert options(obs_frame(spark, [{"TARGET_ICAO": "ZZZZ"}, {"TARGET_ICAO": "YMML"}])).first().default_airport == "YMML"
    assert options(obs_frame(spark, [{"TARGET_ICAO": "ZZZZ"}, {"TARGET_ICAO": "AAAA"}])).first().default_airport == "AAAA"
    legacy = options(obs_frame(spark, [{"TARGET_ICAO": "A"}]), legacy=True).first()
    assert (legacy.year_start, legacy.year_end) == (2015, 2024)
    empty = obs_frame(spark, [{"TARGET_ICAO": "X"}]).filter("false")
    assert options(empty).first().default_airport is None


def test_drop_null_rows(spark):
    from stratus.operators.filters import drop_null_rows
    df = obs_frame(spark, [{"WND_DIR": 1.0, "VSBY": 2.0}, {"WND_DIR": None, "VSBY": 2.0},
                           {"WND_DIR": float("nan"), "VSBY": 1.0}, {"WND_DIR": 3.0, "VSBY": None}])
    assert drop_null_rows(df, ["WND_DIR", "VSBY"]).count() == 1


@pytest.mark.parametrize("text, want", [
    ("2023-09-30 22:30 +10:00", "2023-09-30 12:30:00"), ("2023-09-30 22:30+1000", "2023-09-30 12:30:00"), ("2023-09-30T22:30:05Z", "2023-09-30 22:30:05"),
    ("2023/09/30 22:30", "2023-09-30 22:30:00"), ("20230930 2230", "2023-09-30 22:30:00"), ("2023-09-30 22:30 UTC", "2023-09-30 22:30:00"),
    ("2023-09-30 01:30 -09:30", "2023-09-30 11:00:00"), ("2023-09-30", "2023-09-30 00:00:00"), (" 2023-09-30 22:30:00.25 ", "2023-09-30 22:30:00.250000"),
    ("2023-09-30 22:30:00 Australia/Sydney", None), ("2023-13-30 22:30", None), ("2023-09-30 25:30", None), ("soon", None), ("", None), (None, None),
    ("2023-09-30 22:30 +99:00", None)])
def test_time_text_forms(spark, text, want):
    from stratus.sources.observations import parse_utc
    got = spark.createDataFrame([(text,)], "t string").select(parse_utc("t").alias("t")).first().t
    assert (None if got is None else str(got)) == want


def test_contours_leave_out_infinite_pairs(spark):
    from stratus.operators.contours import polar_histogram
    inf = float("inf")
    df = spark.createDataFrame([("A", inf, 3.0), ("A", 10.0, inf), ("A", -inf, 1.0), ("A", 10.0, 3.0), ("A", None, 3.0)],
                               "TARGET_ICAO string, WND_DIR double, WND_SPD double")
    assert [(r.sbin, r.dbin, r.cnt) for r in polar_histogram(df, ["TARGET_ICAO"], 40.0).collect()] == [(3, 1, 1)]


def test_days_of_every_zone_around_its_changes(spark):
    """The 9 am day equals the plain conversion of the instant in every zone, every half hour around the changes of the year and far away ones."""
    from stratus.functions import columns as C
    from stratus.sources.airports import known_zone_names
    zones = spark.createDataFrame([(z,) for z in [*known_zone_names(spark), "+10:00", "-03:30", "Z"]], "tz string")
    times = spark.sql("""select explode(array_union(
        sequence(timestamp_ntz'2023-01-01 00:15:00', timestamp_ntz'2023-12-31 23:45:00', interval 3 hours),
        array(timestamp_ntz'0001-02-03 04:05:06', timestamp_ntz'1883-11-18 12:00:00', timestamp_ntz'1969-12-31 23:59:59', timestamp_ntz'1970-01-01 08:59:59',
              timestamp_ntz'1970-01-01 09:00:00', timestamp_ntz'2200-06-01 08:59:59.999999'))) as TM_FULL""")
    hours = spark.sql("select explode(sequence(timestamp_ntz'2023-03-24 00:00:00', timestamp_ntz'2023-04-03 00:00:00', interval 30 minutes)) as TM_FULL")
    rows = times.unionByName(hours).crossJoin(zones)
    plain = F.to_date(F.convert_timezone(F.lit("UTC"), F.col("tz"), F.col("TM_FULL") - F.expr("INTERVAL 9 HOURS")))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session in ("UTC", "Australia/Sydney"):
            spark.conf.set("spark.sql.session.timeZone", session)
            assert rows.filter(~C.obs_day("TM_FULL", "tz").eqNullSafe(plain)).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
