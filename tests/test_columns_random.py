"""Row-level rules on seeded random rows against a plain-Python evaluation."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stratus.functions import columns as C
from stratus.functions import constants as K
from tests.helpers import obs_frame

CODES = [None, "", "RA", "+RA", "-ra", "SHRA", "TS", "TSRA", "FG", "BR", "FU", "DU", "SA", "sa", "VA", "HZ",
         "DZ", "SN", "GS", "GR", "PL", "FZ", "SH", "BCFG", "VCTS", "DUSA"]
AMOUNTS = [None, "", "FEW", "SCT", "BKN", "OVC", "bkn", "OVC020", "BKN010CB", "NSC"]


def _band(v, edges, labels):
    if v is None:
        return None
    for e, lab in zip(edges, labels):
        if v < e:
            return lab
    return labels[-1]


def _text(*vals):
    return " ".join((v or "").upper() for v in vals)


def _rows(n=400, seed=7):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        rows.append({
            "WND_DIR": rnd.choice([None, round(rnd.uniform(0, 360), 2), float(rnd.randrange(0, 361, 10))]),
            "WND_SPD": rnd.choice([None, round(rnd.uniform(0, 30), 2)]),
            "MAX_WND_GUST_10": rnd.choice([None, round(rnd.uniform(0, 35), 2), 21.09, 17.49]),
            "PRST_WX_DSC_1": rnd.choice(CODES), "PRST_WX_DSC_2": rnd.choice(CODES),
            "PRST_WX_PHENOM_1": rnd.choice(CODES), "PRST_WX_PHENOM_2": rnd.choice(CODES),
            "CEIL_CLD_AMT_1": rnd.choice(AMOUNTS), "CEIL_CLD_AMT_2": rnd.choice(AMOUNTS),
            "CEIL_CLD_HT_1": rnd.choice([None, rnd.randrange(0, 3000, 100), 499.9, 500, 1500, 2000]),
            "CEIL_CLD_HT_2": rnd.choice([None, rnd.randrange(0, 3000, 100), 999.99, 1000]),
        })
    return rows


def _expected(r):
    d, s, g = r["WND_DIR"], r["WND_SPD"], r["MAX_WND_GUST_10"]
    dsc, phen = _text(r["PRST_WX_DSC_1"], r["PRST_WX_DSC_2"]), _text(r["PRST_WX_PHENOM_1"], r["PRST_WX_PHENOM_2"])
    wx = _text(r["PRST_WX_DSC_1"], r["PRST_WX_PHENOM_1"], r["PRST_WX_DSC_2"], r["PRST_WX_PHENOM_2"])
    amts = _text(r["CEIL_CLD_AMT_1"], r["CEIL_CLD_AMT_2"])
    gale = (s is not None and s > 17.49) or (g is not None and g > 21.09)
    cat = "TS" if "TS" in dsc else ("SHRA" if ("SH" in dsc and "RA" in phen) else "No wx")
    code = next((c for c in K.SMOKE_TOKENS if c in phen), "Other")
    ceil1 = (r["CEIL_CLD_AMT_1"] or "").upper().startswith(("BKN", "OVC"))
    ceil2 = (r["CEIL_CLD_AMT_2"] or "").upper().startswith(("BKN", "OVC"))
    h1 = None if r["CEIL_CLD_HT_1"] is None else float(r["CEIL_CLD_HT_1"])
    h2 = None if r["CEIL_CLD_HT_2"] is None else float(r["CEIL_CLD_HT_2"])
    below_1000 = (ceil1 and h1 is not None and h1 < 1000) or (ceil2 and h2 is not None and h2 < 1000)
    return {
        "d16": None if d is None else math.floor(((d + 11.25) % 360) / 22.5) * 22.5,
        "d10": None if d is None else int(math.floor(((d + 5) % 360) / 10) * 10),
        "band": None if s is None else _band(s * K.MPS_TO_KT, K.SPEED_BAND_EDGES, K.SPEED_BAND_LABELS),
        "hband": _band(h1, K.CEILING_BAND_EDGES, K.CEILING_BAND_LABELS),
        "rain": any(t in wx for t in K.RAIN_DAY_TOKENS),
        "ts": "TS" in dsc,
        "precip": any(t in wx for t in K.PRECIP_TOKENS),
        "low_sub": any(t in amts for t in K.CEILING_AMOUNTS),
        "gale": gale, "cat": cat, "code": code, "below_1000": below_1000,
    }


@pytest.fixture(scope="module")
def checked(spark):
    rows = _rows()
    df = C.with_cloud_columns(obs_frame(spark, rows))
    got = df.select(
        C.dir_bin_16("WND_DIR").alias("d16"), C.dir_bin_10("WND_DIR").alias("d10"),
        C.speed_band("WND_SPD").alias("band"), C.ceiling_band_exclusive("_ht1").alias("hband"),
        C.is_rain_obs().alias("rain"), C.is_thunder_obs().alias("ts"), C.is_precip().alias("precip"),
        C.token_mask(K.CLOUD_AMOUNT_FIELDS, K.CEILING_AMOUNTS).alias("low_sub"),
        C.is_gale().alias("gale"), C.gale_category().alias("cat"), C.phenomenon_code().alias("code"),
        C.cumulative_ceiling_flag(1000.0).alias("below_1000"),
    ).collect()
    return rows, got


@pytest.mark.parametrize("field", ["d16", "d10", "band", "hband", "rain", "ts", "precip", "low_sub", "gale", "cat",
                                   "code", "below_1000"])
def test_rule_matches_python(checked, field):
    rows, got = checked
    for r, g in zip(rows, got):
        assert g[field] == _expected(r)[field], (field, r)


def test_round_binary_matches_python_round(spark):
    rnd = random.Random(3)
    vals = [0.1235, 0.0625, 2.675, 0.0005, 0.1245, 1.0005, 0.06, 0.5445, 12.3455, 0.9995]
    vals += [round(rnd.uniform(0, 5), 4) for _ in range(1500)] + [rnd.uniform(0, 5) for _ in range(1500)]
    vals += [k / 2000 for k in range(1, 2000, 2)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select("x", C.round_binary(F.col("x"), 3).alias("r")).collect()
    assert [r.r for r in got] == [round(r.x, 3) for r in got]
