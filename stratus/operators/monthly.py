"""Per-(year, month) flag frequencies (U1-U3) and the legacy-generation
statistics (L1-L10).

The legacy statistics are kept as separately named operators because they
differ from the current ones (raw speed bands, counts instead of percentages,
phenomenon-only thunder test, case-sensitive cloud prefix, HZ as smoke).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.functions import columns as C
from stratus.functions import constants as K
from stratus.plans.joins import densify


def _with_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", C.month_start_date("year", "month"))


def _with_month_label(df: DataFrame) -> DataFrame:
    return df.withColumn("month_name", C.month_label("month"))


# ---------------------------------------------------------------------------
# U1-U3
# ---------------------------------------------------------------------------

def monthly_flag_frequency(obs: DataFrame, tokens: Sequence[str], target_col: str,
                           fields: Sequence[str] | None = None,
                           by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Number of observations per (year, month) whose fields contain any
    token (months with observations and no hit give 0), with the month's
    first day as ``date``."""
    by = list(by)
    flag = C.token_mask(list(fields or K.PHENOM_FIELDS), tokens, set(obs.columns))
    monthly = obs.groupBy(*by, "year", "month").agg(F.sum(flag.cast("long")).alias(target_col))
    return _with_date(monthly)


def paired_monthly_frequency(obs: DataFrame, categories: Mapping[str, Mapping[str, Sequence[str]]],
                             by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """U1 per named category ({"tokens": [...], "fields": [...]}), then the
    mean over years per month; long format (Type, Count).

    All categories come from one aggregation over the observations.
    """
    by = list(by)
    cols = set(obs.columns)
    labels = list(categories)
    aggs = [F.sum(C.token_mask(list(spec["fields"]), spec["tokens"], cols).cast("long")).alias(f"_c{i}")
            for i, spec in enumerate(categories.values())]
    ym = obs.groupBy(*by, "year", "month").agg(*aggs)
    monthly = ym.groupBy(*by, "month").agg(*[F.avg(f"_c{i}").alias(f"_c{i}") for i in range(len(labels))])
    stacked = monthly.select(*by, "month", F.explode(F.array(*[
        F.struct(F.lit(label).alias("Type"), F.col(f"_c{i}").alias("Count"))
        for i, label in enumerate(labels)])).alias("_t"))
    return _with_month_label(stacked.select(*by, "month", "_t.Type", "_t.Count"))


def low_cloud_cumulative_frequency(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Per month the mean (over years, zero months included) number of
    observations with a ceiling below 2000/1500/1000/500 ft -- 12 months per
    threshold -- and the mean monthly fog count (months present only)."""
    by = list(by)
    cols = set(obs.columns)
    aggs = [F.sum(C.cumulative_ceiling_flag(thr).cast("long")).alias(f"_l{i}")
            for i, (_, thr) in enumerate(K.CEILING_CUMULATIVE)]
    aggs.append(F.sum(C.phenom_mask(K.FOG_TOKENS, cols).cast("long")).alias("_fog"))
    ym = C.with_cloud_columns(obs).groupBy(*by, "year", "month").agg(*aggs)
    monthly = ym.groupBy(*by, "month").agg(
        *[F.avg(f"_l{i}").alias(f"_l{i}") for i in range(len(K.CEILING_CUMULATIVE))],
        F.avg("_fog").alias("_fog"))
    # One branch for all five series: the fog series stays sparse (months
    # present only), the cumulative low-cloud series are completed to 12.
    series = [F.struct(F.lit(label).alias("Component"), F.col(f"_l{i}").alias("Count"))
              for i, (label, _) in enumerate(K.CEILING_CUMULATIVE)]
    series.append(F.struct(F.lit(K.FOG_LAYER_LABEL).alias("Component"), F.col("_fog").alias("Count")))
    stacked = monthly.select(*by, "month", F.explode(F.array(*series)).alias("_t"))
    stacked = stacked.select(*by, "month", "_t.Component", "_t.Count", F.lit(True).alias("_present"))
    names = [label for label, _ in K.CEILING_CUMULATIVE] + [K.FOG_LAYER_LABEL]
    grid = {"month": list(range(1, 13)), "Component": names}
    dense = densify(stacked, by, grid, {"Count": 0.0, "_present": False})
    keep = F.col("_present") | (F.col("Component") != F.lit(K.FOG_LAYER_LABEL))
    return _with_month_label(dense.filter(keep).drop("_present"))


# ---------------------------------------------------------------------------
# Legacy generation
# ---------------------------------------------------------------------------

def wind_rose_count(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """L1: observation counts per 16-point sector and speed band, the bands
    applied to the stored value as is."""
    by = list(by)
    rows = obs.filter(F.col("WND_DIR").isNotNull() & F.col("WND_SPD").isNotNull())
    return rows.groupBy(*by, C.dir_bin_16("WND_DIR").alias("dir_bin"),
                        C.speed_band("WND_SPD", 1.0).alias("speed_range")) \
        .agg(F.count(F.lit(1)).alias("n_obs"))


def monthly_temp_extremes(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """L2: max/min temperature and dew point per (year, month)."""
    by = list(by)
    return _with_date(obs.groupBy(*by, "year", "month").agg(
        F.max("AIR_TEMP").alias("max_t"), F.min("AIR_TEMP").alias("min_t"),
        F.max("DWPT").alias("max_td"), F.min("DWPT").alias("min_td")))


def monthly_rain_thunder(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """L3: observations with RA or TS in a phenomenon field per (year, month)."""
    return monthly_flag_frequency(obs, K.LEGACY_RAIN_TS_TOKENS, "rain_ts", K.PHENOM_FIELDS, by)


def monthly_fog_low_cloud(obs: DataFrame, tokens: Sequence[str] = K.LEGACY_FOG_TOKENS,
                          by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """L4: observations with a fog token (FG; FG or BR on the fog page) or a
    layer amount starting with BKN/OVC (case-sensitive, no height test)."""
    by = list(by)
    flag = C.fog_or_ceiling(tokens, upper_amounts=False)
    return _with_date(obs.groupBy(*by, "year", "month").agg(
        F.sum(flag.cast("long")).alias("fog_low_cloud")))


def wind_direction_count(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Observation counts per 16-point sector, ascending."""
    by = list(by)
    rows = obs.filter(F.col("WND_DIR").isNotNull())
    return rows.groupBy(*by, C.dir_bin_16("WND_DIR").alias("dir_bin")) \
        .agg(F.count(F.lit(1)).alias("n_obs")).orderBy(*by, "dir_bin")


def monthly_wind_gust(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Mean wind speed and max gust per (year, month)."""
    by = list(by)
    return _with_date(obs.groupBy(*by, "year", "month").agg(
        F.avg("WND_SPD").alias("mean_speed"), F.max("MAX_WND_GUST_10").alias("max_gust")))


def convective_split(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Per month, observations with RA/SH/DZ and with TS (phenomenon
    fields), long format.  Both counts share the same (year, month) groups,
    so the outer join of the two series is one aggregation."""
    by = list(by)
    cols = set(obs.columns)
    rain = C.token_mask(K.PHENOM_FIELDS, K.LEGACY_RAIN_ONLY_TOKENS, cols)
    ts = C.token_mask(K.PHENOM_FIELDS, K.THUNDER_TOKENS, cols)
    monthly = _with_date(obs.groupBy(*by, "year", "month").agg(
        F.sum(rain.cast("long")).alias("Rain"), F.sum(ts.cast("long")).alias("Thunderstorm")))
    return monthly.unpivot([*by, "date"], ["Rain", "Thunderstorm"], "Type", "Count")


def cloud_amount_distribution(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Counts of every cloud amount value of both layers, descending."""
    by = list(by)
    amounts = obs.select(*by, F.explode(F.array(*[F.col(c) for c in K.CLOUD_AMOUNT_FIELDS])).alias("cloud_amount"))
    counts = amounts.filter(F.col("cloud_amount").isNotNull()).groupBy(*by, "cloud_amount") \
        .agg(F.count(F.lit(1)).alias("n_obs"))
    return counts.orderBy(*by, F.desc("n_obs"), "cloud_amount")


def monthly_smoke(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Observations with FU/DU/SA/HZ/VA per (year, month)."""
    return monthly_flag_frequency(obs, K.LEGACY_SMOKE_TOKENS, "smoke_dust", K.PHENOM_FIELDS, by)


def phenomenon_breakdown(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Per code FU/DU/SA/HZ/VA the number of observations whose
    phenomenon fields contain it (a row may count for several); zero codes
    are kept."""
    by = list(by)
    cols = set(obs.columns)
    agg = obs.groupBy(*by).agg(*[F.count_if(C.token_mask(K.PHENOM_FIELDS, [code], cols)).alias(code)
                                 for code in K.LEGACY_SMOKE_TOKENS])
    return agg.unpivot(by, K.LEGACY_SMOKE_TOKENS, "phenomenon", "n_obs")
