"""Build small observation / airport frames from hand-written rows."""

from __future__ import annotations

from pyspark.sql import types as T

from stratus.sources.observations import normalize_observations

# Raw (pre-normalisation) schema: times and heights as text, so that the
# ingest rules (UTC parsing, numeric coercion, NaN -> null) are exercised.
RAW_SCHEMA = T.StructType([
    T.StructField("TARGET_ICAO", T.StringType()),
    T.StructField("TM_FULL", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("WND_DIR", T.DoubleType()),
    T.StructField("WND_SPD", T.DoubleType()),
    T.StructField("MAX_WND_GUST_10", T.DoubleType()),
    T.StructField("AIR_TEMP", T.DoubleType()),
    T.StructField("DWPT", T.DoubleType()),
    T.StructField("VSBY", T.DoubleType()),
    T.StructField("PRST_WX_DSC_1", T.StringType()),
    T.StructField("PRST_WX_DSC_2", T.StringType()),
    T.StructField("PRST_WX_PHENOM_1", T.StringType()),
    T.StructField("PRST_WX_PHENOM_2", T.StringType()),
    T.StructField("CEIL_CLD_AMT_1", T.StringType()),
    T.StructField("CEIL_CLD_AMT_2", T.StringType()),
    T.StructField("CEIL_CLD_HT_1", T.StringType()),
    T.StructField("CEIL_CLD_HT_2", T.StringType()),
])

DEFAULTS = {"TARGET_ICAO": "YAAA", "TM_FULL": "2020-01-15 03:00:00", "year": 2020, "month": 1, "hour": 3}


def obs_frame(spark, rows: list[dict]):
    names = RAW_SCHEMA.fieldNames()
    data = []
    for r in rows:
        full = dict(DEFAULTS)
        full.update(r)
        if "TM_FULL" in r and r["TM_FULL"] is not None and "year" not in r:
            ts = str(r["TM_FULL"])
            try:
                full["year"], full["month"] = int(ts[0:4]), int(ts[5:7])
                full["hour"] = int(ts[11:13])
            except ValueError:
                pass
        for k in ("CEIL_CLD_HT_1", "CEIL_CLD_HT_2"):
            if full.get(k) is not None:
                full[k] = str(full[k])
        for k in ("WND_DIR", "WND_SPD", "MAX_WND_GUST_10", "AIR_TEMP", "DWPT", "VSBY"):
            if full.get(k) is not None:
                full[k] = float(full[k])
        data.append(tuple(full.get(n) for n in names))
    return normalize_observations(spark.createDataFrame(data, RAW_SCHEMA))


def airports_frame(spark, rows: list[tuple]):
    schema = T.StructType([T.StructField("ICAO", T.StringType()), T.StructField("LAT", T.DoubleType()),
                           T.StructField("LONG", T.DoubleType()), T.StructField("tz", T.StringType())])
    return spark.createDataFrame(rows, schema)


def as_dicts(df, *order):
    rows = [r.asDict() for r in df.collect()]
    if order:
        rows.sort(key=lambda r: tuple(r[o] for o in order))
    return rows
