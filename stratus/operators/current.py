"""Climatology statistics, current generation.

Every operator takes an observation frame (normalised, already selected with
:func:`stratus.operators.filters.select_observations`) and grouping keys
``by`` (default: the station) and returns a lazy DataFrame.  All statistics
are computed for every station at once; filtering the result to one station
equals computing on that station alone, because every denominator (totals,
distinct years, day counts) is taken per ``by`` group.

Plan shape: the large observation scan is touched once per operator and only
through partial+final hash aggregates (map-side combine), so what crosses the
network is bounded by the number of (station, day|month|bin) cells, not by the
number of observations.  Later steps work on those small aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.functions import columns as C
from stratus.functions import constants as K
from stratus.plans.grains import Grain
from stratus.plans.joins import densify
from stratus.plans.shared import save_small
from stratus.sources.airports import with_timezone
from stratus.sources.observations import drop_unparsed_times

MONTHS = list(range(1, 13))


def _by(by: Sequence[str]) -> list[str]:
    return list(by)


def _with_month_label(df: DataFrame, month: str = "month") -> DataFrame:
    return df.withColumn("month_name", C.month_label(month))


# ---------------------------------------------------------------------------
# A1 wind rose
# ---------------------------------------------------------------------------

def rose_grain(unit_factor: float = K.MPS_TO_KT) -> Grain:
    known = F.col("WND_DIR").isNotNull() & F.col("WND_SPD").isNotNull()
    return Grain("rose", ("dir_bin", "speed_range"), {"n_obs": F.count(F.lit(1))},
                 {"dir_bin": F.when(known, C.dir_bin_16("WND_DIR")), "speed_range": F.when(known, C.speed_band("WND_SPD", unit_factor))},
                 ("dir_bin", "speed_range"))


def rose_from_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    total = F.sum("n_obs").over(Window.partitionBy(*by))
    return cells.withColumn("frequency", F.col("n_obs") / total * F.lit(100.0))


def wind_rose_pct(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY,
                  unit_factor: float = K.MPS_TO_KT) -> DataFrame:
    """A1: share (%) of observations per 16-point sector and speed band.

    Rows with a null direction or speed are dropped; the denominator is the
    number of kept rows of the group.
    """
    by = _by(by)
    rows = obs.filter(F.col("WND_DIR").isNotNull() & F.col("WND_SPD").isNotNull())
    return rose_from_cells(rose_grain(unit_factor).cells(rows, by), by)


# ---------------------------------------------------------------------------
# 9 am days
# ---------------------------------------------------------------------------

def with_obs_day(obs: DataFrame, airports: DataFrame | None, by: Sequence[str] = K.DEFAULT_BY, keep_unparsed: bool = False) -> DataFrame:
    """S6 + S5 + D5: parsed times only (or all, ``obs_day`` null for the others), station zone attached, ``obs_day`` added."""
    rows = obs if keep_unparsed else drop_unparsed_times(obs)
    rows = with_timezone(rows, airports)
    return rows.withColumn("obs_day", C.obs_day("TM_FULL", "tz"))


def obs_day_counts(obs: DataFrame, airports: DataFrame | None, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """D5/D6 as a statistic: observations per local 9 am day."""
    by = _by(by)
    rows = with_obs_day(obs, airports, by)
    return rows.groupBy(*by, "tz", "obs_day").agg(F.count(F.lit(1)).alias("n_obs")) \
        .withColumn("obs_year", F.year("obs_day")).withColumn("obs_month", F.month("obs_day"))


def rain_thunder_grain(cols: set[str]) -> Grain:
    return Grain("wet", ("obs_day",), {"rain": F.bool_or("_rain"), "thunder": F.bool_or("_thunder")},
                 {"_rain": C.is_rain_obs(cols), "_thunder": C.is_thunder_obs(cols)}, ("obs_day",))


def rain_thunder_from_cells(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    monthly = daily.groupBy(*by, F.year("obs_day").alias("obs_year"), F.month("obs_day").alias("month")).agg(
        F.sum(F.col("rain").cast("long")).alias("Rain"),
        F.sum(F.col("thunder").cast("long")).alias("Thunderstorm"))
    avg = monthly.groupBy(*by, "month").agg(
        F.avg("Rain").alias("Rain"), F.avg("Thunderstorm").alias("Thunderstorm"))
    long = avg.unpivot([*by, "month"], ["Rain", "Thunderstorm"], "Type", "avg_days")
    return _with_month_label(long)


def rain_thunder_days(obs: DataFrame, airports: DataFrame | None = None,
                      by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """A2: average number of rain days and thunderstorm days per month.

    A day (local 9 am to 9 am) is a rain day if any of its observations has
    RA/DZ/SH/TS in any weather field, a thunder day if any has TS in a
    descriptor field.  Days are counted per (year, month) of the day -- months
    with observations but no rain count as zero -- and averaged over years.
    """
    by = _by(by)
    return rain_thunder_from_cells(rain_thunder_grain(set(obs.columns)).cells(with_obs_day(obs, airports, by), by), by)


def extremes_grain() -> Grain:
    return Grain("extremes", ("obs_day",), {"t_max": F.max("AIR_TEMP"), "t_min": F.min("AIR_TEMP"),
                                            "td_max": F.max("DWPT"), "td_min": F.min("DWPT")}, {}, ("obs_day",))


def extremes_from_cells(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    monthly = daily.groupBy(*by, F.month("obs_day").alias("month")).agg(
        F.avg("t_max").alias("avg_daily_max_t"), F.avg("t_min").alias("avg_daily_min_t"),
        F.avg("td_max").alias("avg_daily_max_td"), F.avg("td_min").alias("avg_daily_min_td"))
    return _with_month_label(monthly)


def temp_dewpoint_daily_extremes(obs: DataFrame, airports: DataFrame | None = None,
                                 by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """A3: per local day max/min of temperature and dew point, then the mean of
    each over all days of a calendar month (not per year first)."""
    by = _by(by)
    return extremes_from_cells(extremes_grain().cells(with_obs_day(obs, airports, by), by), by)


# ---------------------------------------------------------------------------
# A4-A7 fog and low cloud by month
# ---------------------------------------------------------------------------

def _band_columns(cols: set[str]) -> dict:
    """Per row: fog flag, whether an amount field contains BKN or OVC, and the
    exclusive band of each layer height."""
    return {"_fog": C.phenom_mask(K.FOG_TOKENS, cols), "_low": C.token_mask(K.CLOUD_AMOUNT_FIELDS, K.CEILING_AMOUNTS, cols),
            **{f"_band{i}": C.ceiling_band_exclusive(C.numeric_height(h)) for i, h in enumerate(K.CLOUD_HEIGHT_FIELDS)}}


def _band_aggs() -> dict:
    """Fog count and, per exclusive band, the number of layer heights in it
    on rows where an amount field contains BKN or OVC (either layer's height
    counts, whichever layer was the ceiling)."""
    aggs = {"fog": F.count_if(F.col("_fog"))}
    for j, label in enumerate(K.CEILING_BAND_LABELS):
        n = None
        for i in range(len(K.CLOUD_HEIGHT_FIELDS)):
            term = (F.col("_low") & F.coalesce(F.col(f"_band{i}") == F.lit(label), F.lit(False))).cast("int")
            n = term if n is None else n + term
        aggs[f"band_{j}"] = F.sum(n)
    return aggs


def fog_cloud_grain(cols: set[str], extra_keys: Sequence[str] = ()) -> Grain:
    """Per (by, year, month) fog count and the number of ceiling heights per band."""
    return Grain("cloud", (*extra_keys, "year", "month"), _band_aggs(), _band_columns(cols), tuple(extra_keys))


def fog_cloud_from_cells(ym: DataFrame, by: Sequence[str]) -> DataFrame:
    return _fog_low_cloud_long(_fog_cloud_month(ym, _by(by)), _by(by))


def _fog_cloud_year_month(rows: DataFrame, by: list[str]) -> DataFrame:
    """One pass over observations: the cells of :func:`fog_cloud_grain`."""
    return fog_cloud_grain(set(rows.columns)).cells(rows, by)


def _fog_cloud_month(ym: DataFrame, by: list[str]) -> DataFrame:
    """(by, month): fog total and band totals divided by the number of distinct
    years of the group's input."""
    n_years = F.size(F.collect_set("year").over(Window.partitionBy(*by)))
    ym = ym.withColumn("n_years", n_years)
    aggs = [F.sum("fog").cast("double").alias("fog"), F.max("n_years").alias("n_years")]
    aggs += [F.sum(f"band_{i}").alias(f"band_{i}") for i in range(len(K.CEILING_BAND_LABELS))]
    return ym.groupBy(*by, "month").agg(*aggs)


def _fog_dense(month: DataFrame, by: list[str]) -> DataFrame:
    dense = densify(month.select(*by, "month", "fog"), by, {"month": MONTHS}, {"fog": 0.0})
    return _with_month_label(dense.withColumnRenamed("fog", "fog_obs"))


def _low_cloud_dense(month: DataFrame, by: list[str]) -> DataFrame:
    stacked = month.select(*by, "month", F.explode(F.array(*[
        F.struct(F.lit(label).alias("threshold"),
                 (F.col(f"band_{i}") / F.col("n_years")).alias("avg_obs"))
        for i, label in enumerate(K.CEILING_BAND_LABELS)])).alias("_b"))
    stacked = stacked.select(*by, "month", "_b.threshold", "_b.avg_obs")
    grid = {"month": MONTHS, "threshold": K.CEILING_BAND_LABELS}
    dense = densify(stacked, by, grid, {"avg_obs": 0.0})
    return _with_month_label(dense)


def fog_monthly_count(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """A4: fog observations per calendar month -- the raw total over all
    years, not an average -- completed to 12 months."""
    by = _by(by)
    cols = set(obs.columns)
    month = obs.groupBy(*by, "month").agg(
        F.count_if(C.phenom_mask(K.FOG_TOKENS, cols)).cast("double").alias("fog"))
    return _fog_dense(month, by)


def low_cloud_monthly_by_band(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """A5: ceiling heights per month and exclusive band, divided by the number
    of distinct years in the whole input; 12 x 4 cells per group."""
    by = _by(by)
    return _low_cloud_dense(_fog_cloud_month(_fog_cloud_year_month(obs, by), by), by)


def _fog_low_cloud_long(month: DataFrame, by: list[str]) -> DataFrame:
    """Fog and the four low-cloud bands as five series of one long result,
    built from a single branch (a union of two differently pruned branches
    would run the whole upstream aggregation twice)."""
    series = [F.struct(F.lit("Fog").alias("series"), F.col("fog").cast("double").alias("Count"))]
    series += [F.struct(F.lit(label).alias("series"),
                        (F.col(f"band_{i}") / F.col("n_years")).alias("Count"))
               for i, label in enumerate(K.CEILING_BAND_LABELS)]
    stacked = month.select(*by, "month", F.explode(F.array(*series)).alias("_s"))
    stacked = stacked.select(*by, "month", "_s.series", "_s.Count")
    grid = {"month": MONTHS, "series": ["Fog", *K.CEILING_BAND_LABELS]}
    dense = densify(stacked, by, grid, {"Count": 0.0})
    is_fog = F.col("series") == F.lit("Fog")
    out = dense.select(*by, "month", C.month_label("month").alias("month_name"),
                       F.when(is_fog, F.lit("Fog")).otherwise(F.lit("Low cloud")).alias("Type"),
                       F.when(is_fog, F.lit(None).cast("string")).otherwise(F.col("series")).alias("Threshold"),
                       "Count")
    return out


def fog_low_cloud_frequency(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """A4 and A5 as one long result (Type Fog / Low cloud; Fog has a null
    threshold).  Both come from a single aggregation pass."""
    by = _by(by)
    month = _fog_cloud_month(_fog_cloud_year_month(obs, by), by)
    return _fog_low_cloud_long(month, by)


_WORD_BITS = 64
_YEAR_WORDS = 6             # 384 bits hold the days of a year


def rain_days(obs: DataFrame, airports: DataFrame | None = None, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """The rain days of every group as bitmaps: (by, obs_year, words), bit d of the six 64-bit words for day-of-year d.

    One aggregate of ORs over the observations with rain, combined before it is shuffled, so a group and year crosses the
    network once per task, whatever the number of its days.  The result is saved (:func:`save_small`): a row of
    48 bytes per group and year, which joins as a broadcast where its measured size allows.
    """
    by = _by(by)
    wet = with_obs_day(obs.filter(C.is_rain_obs(set(obs.columns))), airports, by)
    day = F.dayofyear("obs_day")
    bits = wet.select(*by, F.year("obs_day").alias("obs_year"), F.floor(day / _WORD_BITS).cast("int").alias("_word"),
                      F.expr(f"shiftleft(1L, dayofyear(obs_day) % {_WORD_BITS})").alias("_bit"))
    words = [F.coalesce(F.bit_or(F.when(F.col("_word") == k, F.col("_bit"))), F.lit(0).cast("long")) for k in range(_YEAR_WORDS)]
    return save_small(bits.groupBy(*by, "obs_year").agg(F.array(*words).alias("words")), "rain-days")


def with_rain_day(rows: DataFrame, days: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """``rows`` (with ``obs_day``) and ``is_rain_day`` from the bitmaps of :func:`rain_days`."""
    keys = days.select(*[F.col(b).alias(f"_key{i}") for i, b in enumerate(by)], F.col("obs_year").alias("_year"), "words")
    on = F.year(rows["obs_day"]) == keys["_year"]
    for i, b in enumerate(by):
        on = on & rows[b].eqNullSafe(keys[f"_key{i}"])
    bit = F.expr(f"shiftright(words[cast(dayofyear(obs_day) div {_WORD_BITS} as int)], dayofyear(obs_day) % {_WORD_BITS}) & 1L = 1L")
    return rows.join(keys, on, "left").withColumn("is_rain_day", F.coalesce(bit, F.lit(False))).drop("words", *[c for c in keys.columns if c != "words"])


def fog_low_cloud_by_rain_day(obs: DataFrame, airports: DataFrame | None = None,
                              by: Sequence[str] = K.DEFAULT_BY, days: DataFrame | None = None) -> DataFrame:
    """A6 separately for observations on rain days and on other days.

    Whether a day is a rain day is decided over all observations of that
    local 9 am day; each split then counts its own distinct years.  Groups
    with no observations in a split produce no rows for it.

    The days come as bitmaps (:func:`rain_days`, computed now unless given), so the only large aggregate is keyed by
    (by, split, year, month).
    """
    by = _by(by)
    days = rain_days(obs, airports, by) if days is None else days
    split_by = [*by, "is_rain_day"]
    rows = with_rain_day(with_obs_day(obs, airports, by), days, by)
    month = _fog_cloud_month(_fog_cloud_year_month(rows, split_by), split_by)
    return _fog_low_cloud_long(month, split_by)


# ---------------------------------------------------------------------------
# A8 gales
# ---------------------------------------------------------------------------

def gale_grain() -> Grain:
    """Gales per (by, year, month, category); a null category only marks that the group exists."""
    return Grain("gales", ("year", "month", "category"), {"gales": F.count(F.lit(1))}, {"category": F.when(C.is_gale(), C.gale_category())})


def gales_from_cells(ym: DataFrame, by: Sequence[str]) -> DataFrame:
    monthly = ym.groupBy(*by, F.when(F.col("category").isNotNull(), F.col("month")).alias("month"),
                         "category").agg(F.avg("gales").alias("avg_obs"))
    grid = {"month": MONTHS, "category": K.GALE_CATEGORIES}
    return _with_month_label(densify(monthly, by, grid, {"avg_obs": 0.0}))


def gale_by_weather(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Gale observations per month and weather category, averaged over
    the years that had at least one such gale; 12 x 3 cells per group, 0 where
    no gale of that kind occurred."""
    by = _by(by)
    texts = obs.select("*", C.fields_text(K.DSC_FIELDS).alias("_dsc"),
                       C.fields_text(K.PHENOM_FIELDS).alias("_phen"))
    category = F.when(C.is_gale(), C.gale_category(F.col("_dsc"), F.col("_phen")))
    grain = replace(gale_grain(), rows={"category": category})
    return gales_from_cells(grain.cells(texts, by), by)


# ---------------------------------------------------------------------------
# A9 visibility given precipitation
# ---------------------------------------------------------------------------

def visibility_grain(cols: set[str]) -> Grain:
    seen = F.col("WND_DIR").isNotNull() & F.col("VSBY").isNotNull() & C.is_precip(cols)
    return Grain("visibility", ("dir_bin_10",), {"n": F.count(F.lit(1)), **{
        f"below_{i}": F.count_if(F.col("VSBY") < F.lit(t)) for i, t in enumerate(K.VSBY_THRESHOLDS)}},
        {"dir_bin_10": F.when(seen, C.dir_bin_10("WND_DIR"))}, ("dir_bin_10",))


def visibility_from_cells(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    stacked = bins.select(*by, "dir_bin_10", F.explode(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.lit(label).alias("label"),
                 (F.col(f"below_{i}") / F.col("n") * F.lit(100.0)).alias("pct"))
        for i, (t, label) in enumerate(zip(K.VSBY_THRESHOLDS, K.VSBY_LABELS))])).alias("_t"))
    stacked = stacked.select(*by, "dir_bin_10", "_t.threshold", "_t.pct")
    grid = {"dir_bin_10": list(range(0, 360, 10)), "threshold": K.VSBY_THRESHOLDS}
    dense = densify(stacked, by, grid, {"pct": 0.0})
    label = F.element_at(F.create_map(*[x for t, lab in zip(K.VSBY_THRESHOLDS, K.VSBY_LABELS)
                                        for x in (F.lit(t), F.lit(lab))]), F.col("threshold"))
    return dense.withColumn("label", label)


def visibility_given_precip(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Per 10-degree direction bin, the percentage of precipitation
    observations with visibility below 3/5/7/9 km (cumulative); 36 x 4 cells
    for groups with any precipitation observation, empty bins 0."""
    by = _by(by)
    cols = set(obs.columns)
    rows = obs.filter(F.col("WND_DIR").isNotNull() & F.col("VSBY").isNotNull() & C.is_precip(cols))
    grain = replace(visibility_grain(cols), rows={"dir_bin_10": C.dir_bin_10("WND_DIR")})
    return visibility_from_cells(grain.cells(rows, by), by)


# ---------------------------------------------------------------------------
# A10-A13 smoke and dust
# ---------------------------------------------------------------------------

def smoke_observations(obs: DataFrame) -> DataFrame:
    """Observations with FU/DU/SA/VA in a phenomenon field, with their code."""
    text = obs.select("*", C.fields_text(K.PHENOM_FIELDS).alias("_phen"))
    smoke = text.filter(C.text_has_token(F.col("_phen"), K.SMOKE_TOKENS))
    return smoke.select("*", C.phenomenon_code(K.SMOKE_TOKENS, F.col("_phen")).alias("phenomenon")).drop("_phen")


def smoke_rows() -> dict:
    """The code of a smoke / dust observation, null for any other."""
    phen = C.fields_text(K.PHENOM_FIELDS)
    return {"phenomenon": F.when(C.text_has_token(phen, K.SMOKE_TOKENS), C.phenomenon_code(K.SMOKE_TOKENS, phen))}


def smoke_month_grain() -> Grain:
    return Grain("smoke_months", ("year", "month", "phenomenon"), {"n": F.count(F.lit(1))}, smoke_rows(), ("phenomenon",))


def smoke_month_from_cells(ym: DataFrame, by: Sequence[str]) -> DataFrame:
    monthly = ym.groupBy(*by, "month", "phenomenon").agg(F.avg("n").alias("avg_count"))
    return _with_month_label(monthly)


def smoke_hour_grain() -> Grain:
    return Grain("smoke_hours", ("hour", "phenomenon"), {"n_obs": F.count(F.lit(1))}, smoke_rows(), ("phenomenon",))


def smoke_monthly(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """A10: observations per (year, month, code), averaged over the years
    present for that (month, code)."""
    by = _by(by)
    return smoke_month_from_cells(replace(smoke_month_grain(), rows={}).cells(smoke_observations(obs), by), by)


def smoke_hourly(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Total observations per (UTC hour, code)."""
    return replace(smoke_hour_grain(), rows={}).cells(smoke_observations(obs), _by(by))


def smoke_scatter(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """(dew point, wind speed) points of smoke/dust observations."""
    by = _by(by)
    pts = smoke_observations(obs).filter(
        F.col("WND_SPD").isNotNull() & F.col("DWPT").isNotNull()
        & F.col("phenomenon").isin(*K.SMOKE_TOKENS))
    return pts.select(*by, "phenomenon", "DWPT", "WND_SPD")


def smoke_fit_grain() -> Grain:
    x = F.when(F.col("WND_SPD").isNotNull(), F.col("DWPT"))
    return Grain("smoke_fit", ("phenomenon",), {
        "n_points": F.regr_count("WND_SPD", "DWPT"), "slope": F.regr_slope("WND_SPD", "DWPT"),
        "intercept": F.regr_intercept("WND_SPD", "DWPT"), "x_min": F.min(x), "x_max": F.max(x)}, smoke_rows(), ("phenomenon",))


def smoke_fit_from_cells(fit: DataFrame, by: Sequence[str]) -> DataFrame:
    fit = fit.filter((F.col("n_points") >= 2) & F.col("slope").isNotNull())
    return fit.select(*by, "phenomenon", "n_points", "slope", "intercept", "x_min",
                      (F.col("slope") * F.col("x_min") + F.col("intercept")).alias("y_min"),
                      "x_max",
                      (F.col("slope") * F.col("x_max") + F.col("intercept")).alias("y_max"))


def smoke_linear_fit(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Least-squares line of wind speed on dew point per code, only where
    at least two points with more than one distinct dew point exist; with the
    line's end points at the smallest and largest dew point."""
    by = _by(by)
    return smoke_fit_from_cells(replace(smoke_fit_grain(), rows={}).cells(smoke_scatter(obs, by), by), by)


# ---------------------------------------------------------------------------
# A14 summary
# ---------------------------------------------------------------------------

def metrics_grain() -> Grain:
    return Grain("metrics", (), {
        "observations": F.count(F.lit(1)), "mean_speed": F.avg("WND_SPD"), "max_gust": F.max("MAX_WND_GUST_10"), "avg_temp": F.avg("AIR_TEMP")}, {})


def summary_metrics(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Observation count, mean wind speed, max gust, mean temperature."""
    return metrics_grain().cells(obs, _by(by))
