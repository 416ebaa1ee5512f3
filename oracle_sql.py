"""DuckDB SQL oracles for the registered queries.

Each statement derives the observations from ``lineitem`` and the airports
from ``nation`` with the same mapping as ``stratus.sources.fixture`` and then
computes the statistic in plain SQL, written independently of the Spark
operators (for example the rain-day split joins the day flag back onto rows,
and low-cloud heights are unnested into rows).  Doubles are rounded to 6
decimals on both sides.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Shared CTEs
# ---------------------------------------------------------------------------

OBS = """
li AS (
  SELECT l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7 + l_suppkey * 3 AS h,
         l_orderkey * 13 + l_partkey * 5 + l_linenumber AS g,
         l_suppkey, l_shipdate, l_quantity
  FROM lineitem),
obs0 AS (
  SELECT concat('N', lpad(CAST(l_suppkey % 25 AS VARCHAR), 3, '0')) AS TARGET_ICAO,
    l_shipdate + to_hours(CAST(h % 24 AS INTEGER)) + to_minutes(CAST(g % 2 AS INTEGER) * 30) AS TM_FULL,
    CASE WHEN g % 29 = 0 THEN NULL ELSE CAST((g % 36) * 10 AS DOUBLE) END AS WND_DIR,
    CASE WHEN g % 31 = 0 THEN NULL ELSE l_quantity * CAST(0.5 AS DOUBLE) END AS WND_SPD,
    CASE WHEN h % 5 = 0 THEN NULL ELSE l_quantity * CAST(0.625 AS DOUBLE) END AS MAX_WND_GUST_10,
    CASE WHEN h % 37 = 0 THEN NULL ELSE CAST(h % 70 AS DOUBLE) / 2 END AS AIR_TEMP,
    CASE WHEN g % 41 = 0 THEN NULL ELSE CAST(h % 70 AS DOUBLE) / 2 - CAST(g % 12 AS DOUBLE) END AS DWPT,
    CASE WHEN g % 43 = 0 THEN NULL ELSE CAST(h % 101 AS DOUBLE) / 10 END AS VSBY,
    CASE h % 11 WHEN 0 THEN 'SH' WHEN 1 THEN 'TS' WHEN 2 THEN 'FZ' END AS PRST_WX_DSC_1,
    CASE g % 47 WHEN 0 THEN 'SH' WHEN 1 THEN 'TS' END AS PRST_WX_DSC_2,
    CASE h % 23 WHEN 0 THEN 'RA' WHEN 1 THEN 'FG' WHEN 2 THEN 'DZ' WHEN 3 THEN 'FU' WHEN 4 THEN 'DU'
      WHEN 5 THEN 'BR' WHEN 6 THEN 'VA' WHEN 7 THEN 'sa' WHEN 8 THEN 'HZ' WHEN 9 THEN '+RA' END AS PRST_WX_PHENOM_1,
    CASE g % 53 WHEN 0 THEN 'FG' WHEN 1 THEN 'RA' WHEN 2 THEN 'DU' WHEN 3 THEN 'FU' END AS PRST_WX_PHENOM_2,
    CASE h % 7 WHEN 0 THEN 'BKN' WHEN 1 THEN 'OVC' WHEN 2 THEN 'FEW' WHEN 3 THEN 'SCT' END AS CEIL_CLD_AMT_1,
    CASE WHEN h % 7 < 4 THEN CAST((g % 30) * 100 AS DOUBLE) END AS CEIL_CLD_HT_1,
    CASE g % 19 WHEN 0 THEN 'BKN' WHEN 1 THEN 'OVC' WHEN 2 THEN 'FEW' END AS CEIL_CLD_AMT_2,
    CASE WHEN g % 19 < 3 THEN CAST((h % 50) * 100 AS DOUBLE) END AS CEIL_CLD_HT_2
  FROM li),
obs AS (
  SELECT *, CAST(year(TM_FULL) AS INTEGER) AS year, CAST(month(TM_FULL) AS INTEGER) AS month,
         CAST(hour(TM_FULL) AS INTEGER) AS hour
  FROM obs0)"""

AIRPORTS = """
airports AS (
  SELECT concat('N', lpad(CAST(n_nationkey AS VARCHAR), 3, '0')) AS ICAO,
    -(10 + CAST(n_nationkey AS DOUBLE)) AS LAT,
    115 + CAST(1.5 AS DOUBLE) * n_nationkey AS LONG,
    CASE n_nationkey % 5 WHEN 0 THEN 'Australia/Sydney' WHEN 1 THEN 'Australia/Perth'
      WHEN 2 THEN 'Australia/Adelaide' WHEN 3 THEN 'Asia/Kolkata' END AS tz
  FROM nation)"""

# Observations with parsed time, station zone (UTC default) and 9 am day.
OBS_DAY = """
obs_d AS (
  SELECT o.*, coalesce(a.tz, 'UTC') AS tz,
    CAST(timezone(coalesce(a.tz, 'UTC'), timezone('UTC', o.TM_FULL - INTERVAL 9 HOUR)) AS DATE) AS obs_day
  FROM obs o LEFT JOIN airports a ON o.TARGET_ICAO = a.ICAO
  WHERE o.TM_FULL IS NOT NULL)"""

MONTH_NAME = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][{m}]"
MONTHS = "(SELECT CAST(range AS INTEGER) AS month FROM range(1, 13))"

PHENOM = ["PRST_WX_PHENOM_1", "PRST_WX_PHENOM_2"]
DSC = ["PRST_WX_DSC_1", "PRST_WX_DSC_2"]
WX = ["PRST_WX_DSC_1", "PRST_WX_PHENOM_1", "PRST_WX_DSC_2", "PRST_WX_PHENOM_2"]
AMOUNTS = ["CEIL_CLD_AMT_1", "CEIL_CLD_AMT_2"]


def tok(fields: list[str], tokens: list[str]) -> str:
    """Any token is a substring of the upper-cased, space-joined fields."""
    joined = " || ' ' || ".join(f"upper(coalesce({f}, ''))" for f in fields)
    return "(" + " OR ".join(f"contains({joined}, '{t}')" for t in tokens) + ")"


def mname(m: str = "month") -> str:
    return MONTH_NAME.format(m=m)


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def speed_band(expr: str) -> str:
    return (f"CASE WHEN {expr} < 1 THEN '0-1 kt' WHEN {expr} < 5 THEN '1-5 kt' "
            f"WHEN {expr} < 10 THEN '5-10 kt' WHEN {expr} < 15 THEN '10-15 kt' "
            f"WHEN {expr} < 22 THEN '15-22 kt' ELSE '22+ kt' END")


DIR16 = "floor(((WND_DIR + CAST(11.25 AS DOUBLE)) % 360) / CAST(22.5 AS DOUBLE)) * CAST(22.5 AS DOUBLE)"
DIR10 = "CAST(floor(((WND_DIR + 5) % 360) / 10) * 10 AS INTEGER)"
FOG = tok(PHENOM, ["FG"])
LOWCLOUD_SUBSTR = tok(AMOUNTS, ["BKN", "OVC"])
SMOKE = tok(PHENOM, ["FU", "DU", "SA", "VA"])
SMOKE_CODE = ("CASE WHEN " + tok(PHENOM, ["FU"]) + " THEN 'FU' WHEN " + tok(PHENOM, ["DU"]) + " THEN 'DU' WHEN "
              + tok(PHENOM, ["SA"]) + " THEN 'SA' WHEN " + tok(PHENOM, ["VA"]) + " THEN 'VA' ELSE 'Other' END")


def ceil_prefix(amount: str, upper: bool = True) -> str:
    a = f"upper(coalesce({amount}, ''))" if upper else f"coalesce({amount}, '')"
    return f"(starts_with({a}, 'BKN') OR starts_with({a}, 'OVC'))"


def layered(lo: float | None, hi: float) -> str:
    parts = []
    for amt, ht in (("CEIL_CLD_AMT_1", "CEIL_CLD_HT_1"), ("CEIL_CLD_AMT_2", "CEIL_CLD_HT_2")):
        cond = f"{ceil_prefix(amt)} AND {ht} < {hi}"
        if lo is not None:
            cond += f" AND {ht} >= {lo}"
        parts.append(f"coalesce({cond}, false)")
    return "(" + " OR ".join(parts) + ")"


# ---------------------------------------------------------------------------
# Statements
# ---------------------------------------------------------------------------

Q: dict[str, str] = {}

Q["list_airports"] = with_(OBS) + """
SELECT DISTINCT TARGET_ICAO FROM obs"""

Q["range_filter"] = with_(OBS) + """
SELECT TARGET_ICAO, year, month, hour, WND_SPD FROM obs
WHERE year BETWEEN 1996 AND 2000 AND month BETWEEN 3 AND 9 AND hour BETWEEN 6 AND 18"""

Q["range_filter_inverted"] = with_(OBS) + """
SELECT TARGET_ICAO, year, month, hour, WND_SPD FROM obs
WHERE year BETWEEN 1995 AND 2001 AND (month <= 4 OR month >= 9) AND (hour <= 8 OR hour >= 20)"""

Q["obs_day"] = with_(OBS, AIRPORTS, OBS_DAY) + """
SELECT TARGET_ICAO, tz, obs_day, count(*) AS n_obs,
  CAST(year(obs_day) AS INTEGER) AS obs_year, CAST(month(obs_day) AS INTEGER) AS obs_month
FROM obs_d GROUP BY ALL"""

Q["wind_rose_pct"] = with_(OBS, f"""
c AS (
  SELECT TARGET_ICAO, {DIR16} AS dir_bin,
    {speed_band('WND_SPD * CAST(1.943844 AS DOUBLE)')} AS speed_range, count(*) AS n_obs
  FROM obs WHERE WND_DIR IS NOT NULL AND WND_SPD IS NOT NULL GROUP BY ALL)""") + """
SELECT TARGET_ICAO, dir_bin, speed_range, n_obs,
  round(n_obs / sum(n_obs) OVER (PARTITION BY TARGET_ICAO) * CAST(100 AS DOUBLE), 6) AS frequency
FROM c"""

Q["rain_thunder_days"] = with_(OBS, AIRPORTS, OBS_DAY, f"""
daily AS (
  SELECT TARGET_ICAO, obs_day, bool_or({tok(WX, ['RA', 'DZ', 'SH', 'TS'])}) AS rain,
    bool_or({tok(DSC, ['TS'])}) AS thunder
  FROM obs_d GROUP BY ALL),
monthly AS (
  SELECT TARGET_ICAO, year(obs_day) AS y, CAST(month(obs_day) AS INTEGER) AS month,
    sum(CAST(rain AS BIGINT)) AS r, sum(CAST(thunder AS BIGINT)) AS t
  FROM daily GROUP BY ALL),
av AS (SELECT TARGET_ICAO, month, avg(r) AS r, avg(t) AS t FROM monthly GROUP BY ALL)""") + f"""
SELECT TARGET_ICAO, month, {mname()} AS month_name, 'Rain' AS Type, round(r, 6) AS avg_days FROM av
UNION ALL
SELECT TARGET_ICAO, month, {mname()} AS month_name, 'Thunderstorm' AS Type, round(t, 6) AS avg_days FROM av"""

Q["temp_dewpoint_daily_extremes"] = with_(OBS, AIRPORTS, OBS_DAY, """
daily AS (
  SELECT TARGET_ICAO, obs_day, max(AIR_TEMP) AS tx, min(AIR_TEMP) AS tn, max(DWPT) AS dx, min(DWPT) AS dn
  FROM obs_d GROUP BY ALL)""") + f"""
SELECT TARGET_ICAO, CAST(month(obs_day) AS INTEGER) AS month, {mname('CAST(month(obs_day) AS INTEGER)')} AS month_name,
  round(avg(tx), 6) AS avg_daily_max_t, round(avg(tn), 6) AS avg_daily_min_t,
  round(avg(dx), 6) AS avg_daily_max_td, round(avg(dn), 6) AS avg_daily_min_td
FROM daily GROUP BY ALL"""


def _fog_lowcloud_ctes(src: str, keys: list[str]) -> str:
    """CTEs fogm (fog per month), lcm (low cloud per month and band), grid."""
    k = ", ".join(keys)
    return f"""
st AS (SELECT DISTINCT {k} FROM {src}),
fogm AS (SELECT {k}, month, count(*) AS n FROM {src} WHERE {FOG} GROUP BY ALL),
hts AS (
  SELECT {k}, month, ht FROM (
    SELECT {k}, month, unnest([CEIL_CLD_HT_1, CEIL_CLD_HT_2]) AS ht FROM {src} WHERE {LOWCLOUD_SUBSTR})
  WHERE ht IS NOT NULL),
lc AS (
  SELECT {k}, month,
    CASE WHEN ht < 500 THEN 'below 500ft' WHEN ht < 1000 THEN 'below 1000ft'
         WHEN ht < 1500 THEN 'below 1500ft' ELSE 'below 2000ft' END AS threshold,
    count(*) AS n
  FROM hts GROUP BY ALL),
ny AS (SELECT {k}, count(DISTINCT year) AS n_years FROM {src} GROUP BY ALL),
bands AS (SELECT * FROM (VALUES ('below 500ft'), ('below 1000ft'), ('below 1500ft'), ('below 2000ft')) t(threshold)),
fog_dense AS (
  SELECT st.*, m.month, CAST(coalesce(fogm.n, 0) AS DOUBLE) AS fog_obs
  FROM st CROSS JOIN {MONTHS} m LEFT JOIN fogm USING ({k}, month)),
lc_dense AS (
  SELECT st.*, m.month, b.threshold, coalesce(lc.n / ny.n_years, 0) AS avg_obs
  FROM st CROSS JOIN {MONTHS} m CROSS JOIN bands b
  LEFT JOIN lc USING ({k}, month, threshold) LEFT JOIN ny USING ({k}))"""


Q["fog_monthly_count"] = with_(OBS, _fog_lowcloud_ctes("obs", ["TARGET_ICAO"])) + f"""
SELECT TARGET_ICAO, month, {mname()} AS month_name, fog_obs FROM fog_dense"""

Q["low_cloud_monthly_by_band"] = with_(OBS, _fog_lowcloud_ctes("obs", ["TARGET_ICAO"])) + f"""
SELECT TARGET_ICAO, month, {mname()} AS month_name, threshold, round(avg_obs, 6) AS avg_obs FROM lc_dense"""

_FOG_LONG = """
SELECT {k}, month, {mn} AS month_name, 'Fog' AS Type, CAST(NULL AS VARCHAR) AS Threshold, round(fog_obs, 6) AS Count
FROM fog_dense
UNION ALL
SELECT {k}, month, {mn} AS month_name, 'Low cloud' AS Type, threshold AS Threshold, round(avg_obs, 6) AS Count
FROM lc_dense"""

Q["fog_low_cloud_frequency"] = with_(OBS, _fog_lowcloud_ctes("obs", ["TARGET_ICAO"])) + \
    _FOG_LONG.format(k="TARGET_ICAO", mn=mname())

_RAIN_SPLIT = f"""
dayflag AS (
  SELECT TARGET_ICAO, obs_day, bool_or({tok(WX, ['RA', 'DZ', 'SH', 'TS'])}) AS is_rain_day
  FROM obs_d GROUP BY ALL),
split AS (SELECT o.*, d.is_rain_day FROM obs_d o JOIN dayflag d USING (TARGET_ICAO, obs_day))"""

Q["fog_low_cloud_by_rain_day"] = with_(
    OBS, AIRPORTS, OBS_DAY, _RAIN_SPLIT, _fog_lowcloud_ctes("split", ["TARGET_ICAO", "is_rain_day"])) + \
    _FOG_LONG.format(k="TARGET_ICAO, is_rain_day", mn=mname())

Q["gale_by_weather"] = with_(OBS, f"""
g AS (
  SELECT TARGET_ICAO, year, month,
    CASE WHEN {tok(DSC, ['TS'])} THEN 'TS'
         WHEN {tok(DSC, ['SH'])} AND {tok(PHENOM, ['RA'])} THEN 'SHRA' ELSE 'No wx' END AS category,
    count(*) AS n
  FROM obs
  WHERE coalesce(WND_SPD > CAST(17.49 AS DOUBLE), false) OR coalesce(MAX_WND_GUST_10 > CAST(21.09 AS DOUBLE), false)
  GROUP BY ALL),
a AS (SELECT TARGET_ICAO, month, category, avg(n) AS v FROM g GROUP BY ALL),
grid AS (
  SELECT s.TARGET_ICAO, m.month, c.category
  FROM (SELECT DISTINCT TARGET_ICAO FROM obs) s CROSS JOIN {MONTHS} m
  CROSS JOIN (VALUES ('No wx'), ('SHRA'), ('TS')) c(category))""") + f"""
SELECT grid.TARGET_ICAO, grid.month, {mname('grid.month')} AS month_name, grid.category,
  round(coalesce(a.v, 0), 6) AS avg_obs
FROM grid LEFT JOIN a USING (TARGET_ICAO, month, category)"""

Q["visibility_given_precip"] = with_(OBS, f"""
p AS (
  SELECT TARGET_ICAO, {DIR10} AS dir_bin_10, VSBY FROM obs
  WHERE WND_DIR IS NOT NULL AND VSBY IS NOT NULL AND {tok(WX, ['RA', 'DZ', 'SN', 'GS', 'GR', 'PL', 'SH', 'TS'])}),
den AS (SELECT TARGET_ICAO, dir_bin_10, count(*) AS n FROM p GROUP BY ALL),
thr AS (SELECT * FROM (VALUES (CAST(3 AS DOUBLE), '<3 km'), (CAST(5 AS DOUBLE), '<5 km'),
                              (CAST(7 AS DOUBLE), '<7 km'), (CAST(9 AS DOUBLE), '<9 km')) t(threshold, label)),
num AS (
  SELECT p.TARGET_ICAO, p.dir_bin_10, thr.threshold, count(*) AS k
  FROM p JOIN thr ON p.VSBY < thr.threshold GROUP BY ALL),
grid AS (
  SELECT s.TARGET_ICAO, d.dir_bin_10, thr.threshold, thr.label
  FROM (SELECT DISTINCT TARGET_ICAO FROM p) s
  CROSS JOIN (SELECT CAST(range * 10 AS INTEGER) AS dir_bin_10 FROM range(0, 36)) d CROSS JOIN thr)""") + """
SELECT grid.TARGET_ICAO, grid.dir_bin_10, grid.threshold, grid.label,
  round(CASE WHEN den.n > 0 THEN coalesce(num.k, 0) / den.n * CAST(100 AS DOUBLE) ELSE 0 END, 6) AS pct
FROM grid LEFT JOIN den USING (TARGET_ICAO, dir_bin_10) LEFT JOIN num USING (TARGET_ICAO, dir_bin_10, threshold)"""

_SMOKE = f"""
s AS (SELECT *, {SMOKE_CODE} AS phenomenon FROM obs WHERE {SMOKE})"""

Q["smoke_monthly"] = with_(OBS, _SMOKE, """
ym AS (SELECT TARGET_ICAO, year, month, phenomenon, count(*) AS n FROM s GROUP BY ALL)""") + f"""
SELECT TARGET_ICAO, month, {mname()} AS month_name, phenomenon, round(avg(n), 6) AS avg_count
FROM ym GROUP BY ALL"""

Q["smoke_hourly"] = with_(OBS, _SMOKE) + """
SELECT TARGET_ICAO, hour, phenomenon, count(*) AS n_obs FROM s GROUP BY ALL"""

Q["smoke_scatter"] = with_(OBS, _SMOKE) + """
SELECT TARGET_ICAO, phenomenon, DWPT, WND_SPD FROM s
WHERE WND_SPD IS NOT NULL AND DWPT IS NOT NULL AND phenomenon IN ('FU', 'DU', 'SA', 'VA')"""

Q["smoke_linear_fit"] = with_(OBS, _SMOKE, """
f AS (
  SELECT TARGET_ICAO, phenomenon, count(*) AS n_points, regr_slope(WND_SPD, DWPT) AS slope,
    regr_intercept(WND_SPD, DWPT) AS intercept, min(DWPT) AS x_min, max(DWPT) AS x_max
  FROM s WHERE WND_SPD IS NOT NULL AND DWPT IS NOT NULL AND phenomenon IN ('FU', 'DU', 'SA', 'VA')
  GROUP BY ALL
  HAVING count(*) >= 2 AND count(DISTINCT DWPT) > 1)""") + """
SELECT TARGET_ICAO, phenomenon, n_points, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
  round(x_min, 6) AS x_min, round(slope * x_min + intercept, 6) AS y_min,
  round(x_max, 6) AS x_max, round(slope * x_max + intercept, 6) AS y_max
FROM f"""

Q["summary_metrics"] = with_(OBS) + """
SELECT TARGET_ICAO, count(*) AS observations, round(avg(WND_SPD), 6) AS mean_speed,
  round(max(MAX_WND_GUST_10), 6) AS max_gust, round(avg(AIR_TEMP), 6) AS avg_temp
FROM obs GROUP BY ALL"""


# --- contours ---------------------------------------------------------------

def _contour_ctes(keys: list[str], figure_keys: list[str]) -> str:
    """C2-C5 on a CTE ``hist(keys..., n, sbin, dbin, cnt)``; final CTE ``out``."""
    k = ", ".join(keys)
    fk = ", ".join(figure_keys)
    # Three passes of (1, 2, 1), each first around the circle, then along the speed axis, where an end is its own neighbour.
    passes, src = [], "hist"
    for p in range(3):
        passes.append(f"""
turn{p} AS (
  SELECT {k}, n, sbin, (dbin + w.o + 36) % 36 AS dbin, sum(cnt * w.x) AS cnt
  FROM {src} CROSS JOIN (VALUES (-1, 1), (0, 2), (1, 1)) w(o, x) GROUP BY {k}, n, sbin, (dbin + w.o + 36) % 36),
pass{p} AS (
  SELECT {k}, n, least(greatest(sbin + w.o, 0), n - 1) AS sbin, dbin, sum(cnt * w.x) AS cnt
  FROM turn{p} CROSS JOIN (VALUES (-1, 1), (0, 2), (1, 1)) w(o, x) GROUP BY {k}, n, least(greatest(sbin + w.o, 0), n - 1), dbin)""")
        src = f"pass{p}"
    return f"""{','.join(passes)},
tot AS (SELECT {k}, sum(cnt) AS total FROM hist GROUP BY ALL),
val AS (
  SELECT {src}.* EXCLUDE (cnt), CAST(cnt AS DOUBLE) * CAST(100 AS DOUBLE) / (CAST(4096 AS DOUBLE) * CAST(tot.total AS DOUBLE)) AS value
  FROM {src} JOIN tot USING ({k})),
pk AS (SELECT {k}, max(value) AS peak FROM val GROUP BY ALL HAVING max(value) >= CAST(0.06 AS DOUBLE)),
lv0 AS (
  SELECT {k}, greatest(CAST(0.06 AS DOUBLE), peak * CAST(0.08 AS DOUBLE)) AS lo, peak FROM pk),
lv1 AS (SELECT {k}, lo, greatest(lo, peak * CAST(0.92 AS DOUBLE)) AS hi FROM lv0),
lv2 AS (
  SELECT {k}, CASE WHEN i = 0 THEN lo WHEN i = 5 THEN hi
    ELSE lo * pow(hi / lo, CAST(i AS DOUBLE) / CAST(5 AS DOUBLE)) END AS raw
  FROM lv1 CROSS JOIN (SELECT range AS i FROM range(0, 6))),
lv AS (SELECT DISTINCT {k}, CAST(printf('%.3f', raw) AS DOUBLE) AS level FROM lv2),
lvi AS (SELECT *, CAST(row_number() OVER (PARTITION BY {k} ORDER BY level) - 1 AS INTEGER) AS level_idx FROM lv),
edge AS (
  SELECT val.{keys[0]}{''.join(', val.' + c for c in keys[1:])}, lvi.level_idx, lvi.level, val.dbin,
    max(val.sbin) + 1 AS e
  FROM val JOIN lvi USING ({k}) WHERE val.value >= lvi.level GROUP BY ALL),
kept AS (SELECT DISTINCT {k}, level_idx, level FROM edge),
bnd AS (
  SELECT kept.*, d.dbin, coalesce(edge.e, 0) AS e
  FROM kept CROSS JOIN (SELECT CAST(range AS INTEGER) AS dbin FROM range(0, 36)) d
  LEFT JOIN edge USING ({k}, level_idx, level, dbin)),
rad AS (
  SELECT b0.*, CAST(bm.e + 2 * b0.e + bp.e AS DOUBLE) / 4 AS radius
  FROM bnd b0
  JOIN bnd bm ON {' AND '.join(f'bm.{c} = b0.{c}' for c in keys)} AND bm.level_idx = b0.level_idx
    AND bm.dbin = (b0.dbin + 35) % 36
  JOIN bnd bp ON {' AND '.join(f'bp.{c} = b0.{c}' for c in keys)} AND bp.level_idx = b0.level_idx
    AND bp.dbin = (b0.dbin + 1) % 36),
out AS (
  SELECT {k}, level_idx, round(level, 6) AS level, CAST(dbin * 10 + 5 AS DOUBLE) AS dir_center,
    round(radius, 6) AS radius,
    greatest(CAST(10 AS DOUBLE), CAST(ceil(max(radius) OVER (PARTITION BY {fk}) * CAST(1.1 AS DOUBLE)
      / CAST(5 AS DOUBLE)) * 5 AS DOUBLE)) AS display_max_speed
  FROM rad)"""


def _hist_fixed(src: str, keys: list[str], n: int) -> str:
    k = ", ".join(keys)
    return f"""
hist AS (
  SELECT {k}, CAST({n} AS BIGINT) AS n,
    least(CAST(floor(greatest(WND_SPD, CAST(0 AS DOUBLE))) AS BIGINT), {n} - 1) AS sbin,
    CAST(least(floor((WND_DIR % 360 + 360) % 360 / 10), 35) AS INTEGER) AS dbin,
    count(*) AS cnt
  FROM {src} WHERE isfinite(WND_DIR) AND isfinite(WND_SPD) GROUP BY ALL)"""


Q["wind_contours"] = with_(OBS, _hist_fixed("obs", ["TARGET_ICAO"], 40),
                           _contour_ctes(["TARGET_ICAO"], ["TARGET_ICAO"])) + """
SELECT * FROM out"""

Q["smoke_wind_contours"] = with_(
    OBS, _SMOKE, _hist_fixed("(SELECT * FROM s WHERE phenomenon IN ('DU', 'FU', 'SA', 'VA'))",
                             ["TARGET_ICAO", "phenomenon"], 40),
    _contour_ctes(["TARGET_ICAO", "phenomenon"], ["TARGET_ICAO"])) + """
SELECT * FROM out"""

_SMOKE_HIST = _hist_fixed("(SELECT * FROM s WHERE phenomenon IN ('DU', 'FU', 'SA', 'VA'))",
                          ["TARGET_ICAO", "phenomenon"], 40)
_SMOKE_CONTOUR = _contour_ctes(["TARGET_ICAO", "phenomenon"], ["TARGET_ICAO"])

Q["polar_histogram"] = with_(OBS, _SMOKE, _SMOKE_HIST) + """
SELECT TARGET_ICAO, phenomenon, n, sbin, dbin, cnt FROM hist"""

Q["smooth_polar"] = with_(OBS, _SMOKE, _SMOKE_HIST, _SMOKE_CONTOUR) + """
SELECT TARGET_ICAO, phenomenon, sbin, dbin, round(value, 6) AS value FROM val"""

Q["contour_levels"] = with_(OBS, _SMOKE, _SMOKE_HIST, _SMOKE_CONTOUR) + """
SELECT TARGET_ICAO, phenomenon, level_idx, round(level, 6) AS level FROM lvi"""

Q["display_radius"] = with_(OBS, _SMOKE, _SMOKE_HIST, _SMOKE_CONTOUR) + """
SELECT DISTINCT TARGET_ICAO, display_max_speed FROM out"""

_FOG_CATS = " UNION ALL ".join(
    f"SELECT TARGET_ICAO, is_rain_day, '{label}' AS category, WND_DIR, WND_SPD FROM split WHERE {cond}"
    for label, cond in [
        ("Low cloud 2000-1500ft", layered(1500, 2000)),
        ("Low cloud 1500-1000ft", layered(1000, 1500)),
        ("Low cloud 1000-500ft", layered(500, 1000)),
        ("Low cloud <500ft", layered(None, 500)),
        ("Fog", FOG),
    ])

Q["fog_low_cloud_wind_contours"] = with_(
    OBS, AIRPORTS, OBS_DAY, _RAIN_SPLIT, f"""
cat AS (SELECT * FROM ({_FOG_CATS}) WHERE WND_DIR IS NOT NULL AND WND_SPD IS NOT NULL),
mx AS (
  SELECT TARGET_ICAO, is_rain_day,
    CAST(greatest(CAST(10 AS DOUBLE), ceil(max(WND_SPD) * CAST(1.1 AS DOUBLE) / CAST(5 AS DOUBLE)) * 5) AS BIGINT) AS n
  FROM cat GROUP BY ALL),
hist AS (
  SELECT cat.TARGET_ICAO, cat.is_rain_day, cat.category, mx.n,
    least(CAST(floor(greatest(WND_SPD, CAST(0 AS DOUBLE))) AS BIGINT), mx.n - 1) AS sbin,
    CAST(least(floor((WND_DIR % 360 + 360) % 360 / 10), 35) AS INTEGER) AS dbin,
    count(*) AS cnt
  FROM cat JOIN mx USING (TARGET_ICAO, is_rain_day) GROUP BY ALL)""",
    _contour_ctes(["TARGET_ICAO", "is_rain_day", "category"], ["TARGET_ICAO", "is_rain_day"])) + """
SELECT * FROM out"""

# --- U1-U3 ------------------------------------------------------------------

Q["monthly_flag_frequency"] = with_(OBS) + f"""
SELECT TARGET_ICAO, year, month, CAST(sum(CAST({FOG} AS BIGINT)) AS BIGINT) AS Fog,
  make_date(year, month, 1) AS date
FROM obs GROUP BY TARGET_ICAO, year, month"""

Q["paired_monthly_frequency"] = with_(OBS, f"""
ym AS (
  SELECT TARGET_ICAO, year, month,
    sum(CAST({tok(WX, ['RA', 'DZ', 'SH', 'TS'])} AS BIGINT)) AS r,
    sum(CAST({tok(DSC, ['TS'])} AS BIGINT)) AS t
  FROM obs GROUP BY ALL),
av AS (SELECT TARGET_ICAO, month, avg(r) AS r, avg(t) AS t FROM ym GROUP BY ALL)""") + f"""
SELECT TARGET_ICAO, month, 'Rain' AS Type, round(r, 6) AS Count, {mname()} AS month_name FROM av
UNION ALL
SELECT TARGET_ICAO, month, 'Thunderstorm' AS Type, round(t, 6) AS Count, {mname()} AS month_name FROM av"""

_CUM = [("below 2000ft", 2000), ("below 1500ft", 1500), ("below 1000ft", 1000), ("below 500ft", 500)]

Q["low_cloud_cumulative_frequency"] = with_(OBS, "ym AS (SELECT TARGET_ICAO, year, month, " + ", ".join(
    f"sum(CAST({layered(None, thr)} AS BIGINT)) AS c{i}" for i, (_, thr) in enumerate(_CUM)) + f""",
    sum(CAST({FOG} AS BIGINT)) AS fog FROM obs GROUP BY ALL),
av AS (SELECT TARGET_ICAO, month, """ + ", ".join(f"avg(c{i}) AS c{i}" for i in range(4)) + """, avg(fog) AS fog
  FROM ym GROUP BY ALL),
lc AS (""" + " UNION ALL ".join(
    f"SELECT TARGET_ICAO, month, '{label}' AS Component, c{i} AS Count FROM av" for i, (label, _) in enumerate(_CUM)) + f"""),
grid AS (
  SELECT s.TARGET_ICAO, m.month, c.Component
  FROM (SELECT DISTINCT TARGET_ICAO FROM obs) s CROSS JOIN {MONTHS} m
  CROSS JOIN (VALUES ('below 2000ft'), ('below 1500ft'), ('below 1000ft'), ('below 500ft')) c(Component))""") + f"""
SELECT grid.TARGET_ICAO, grid.month, grid.Component, round(coalesce(lc.Count, 0), 6) AS Count,
  {mname('grid.month')} AS month_name
FROM grid LEFT JOIN lc USING (TARGET_ICAO, month, Component)
UNION ALL
SELECT TARGET_ICAO, month, 'Fog' AS Component, round(fog, 6) AS Count, {mname()} AS month_name FROM av"""

# --- legacy ------------------------------------------------------------------

Q["wind_rose_count"] = with_(OBS) + f"""
SELECT TARGET_ICAO, {DIR16} AS dir_bin, {speed_band('WND_SPD')} AS speed_range, count(*) AS n_obs
FROM obs WHERE WND_DIR IS NOT NULL AND WND_SPD IS NOT NULL GROUP BY ALL"""

Q["monthly_temp_extremes"] = with_(OBS) + """
SELECT TARGET_ICAO, year, month, max(AIR_TEMP) AS max_t, min(AIR_TEMP) AS min_t, max(DWPT) AS max_td,
  min(DWPT) AS min_td, make_date(year, month, 1) AS date
FROM obs GROUP BY TARGET_ICAO, year, month"""


def _u1(tokens: list[str], name: str) -> str:
    return with_(OBS) + f"""
SELECT TARGET_ICAO, year, month, CAST(sum(CAST({tok(PHENOM, tokens)} AS BIGINT)) AS BIGINT) AS {name},
  make_date(year, month, 1) AS date
FROM obs GROUP BY TARGET_ICAO, year, month"""


Q["monthly_rain_thunder"] = _u1(["RA", "TS"], "rain_ts")


def _legacy_fog(tokens: list[str]) -> str:
    cond = f"({tok(PHENOM, tokens)} OR {ceil_prefix('CEIL_CLD_AMT_1', False)} OR {ceil_prefix('CEIL_CLD_AMT_2', False)})"
    return with_(OBS) + f"""
SELECT TARGET_ICAO, year, month, CAST(sum(CAST({cond} AS BIGINT)) AS BIGINT) AS fog_low_cloud,
  make_date(year, month, 1) AS date
FROM obs GROUP BY TARGET_ICAO, year, month"""


Q["monthly_fog_low_cloud"] = _legacy_fog(["FG"])
Q["monthly_fog_low_cloud_br"] = _legacy_fog(["FG", "BR"])

Q["wind_direction_count"] = with_(OBS) + f"""
SELECT TARGET_ICAO, {DIR16} AS dir_bin, count(*) AS n_obs FROM obs WHERE WND_DIR IS NOT NULL GROUP BY ALL"""

Q["monthly_wind_gust"] = with_(OBS) + """
SELECT TARGET_ICAO, year, month, round(avg(WND_SPD), 6) AS mean_speed, max(MAX_WND_GUST_10) AS max_gust,
  make_date(year, month, 1) AS date
FROM obs GROUP BY TARGET_ICAO, year, month"""

Q["convective_split"] = with_(OBS, f"""
r AS (
  SELECT TARGET_ICAO, make_date(year, month, 1) AS date,
    CAST(sum(CAST({tok(PHENOM, ['RA', 'SH', 'DZ'])} AS BIGINT)) AS BIGINT) AS Rain
  FROM obs GROUP BY TARGET_ICAO, year, month),
t AS (
  SELECT TARGET_ICAO, make_date(year, month, 1) AS date,
    CAST(sum(CAST({tok(PHENOM, ['TS'])} AS BIGINT)) AS BIGINT) AS Thunderstorm
  FROM obs GROUP BY TARGET_ICAO, year, month),
m AS (
  SELECT coalesce(r.TARGET_ICAO, t.TARGET_ICAO) AS TARGET_ICAO, coalesce(r.date, t.date) AS date,
    coalesce(Rain, 0) AS Rain, coalesce(Thunderstorm, 0) AS Thunderstorm
  FROM r FULL OUTER JOIN t ON r.TARGET_ICAO = t.TARGET_ICAO AND r.date = t.date)""") + """
SELECT TARGET_ICAO, date, 'Rain' AS Type, Rain AS Count FROM m
UNION ALL
SELECT TARGET_ICAO, date, 'Thunderstorm' AS Type, Thunderstorm AS Count FROM m"""

Q["cloud_amount_distribution"] = with_(OBS) + """
SELECT TARGET_ICAO, cloud_amount, count(*) AS n_obs FROM (
  SELECT TARGET_ICAO, CEIL_CLD_AMT_1 AS cloud_amount FROM obs
  UNION ALL SELECT TARGET_ICAO, CEIL_CLD_AMT_2 FROM obs)
WHERE cloud_amount IS NOT NULL GROUP BY ALL"""

Q["monthly_smoke"] = _u1(["FU", "DU", "SA", "HZ", "VA"], "smoke_dust")

Q["phenomenon_breakdown"] = with_(OBS) + " UNION ALL ".join(
    f"""
SELECT TARGET_ICAO, '{code}' AS phenomenon, CAST(count_if({tok(PHENOM, [code])}) AS BIGINT) AS n_obs
FROM obs GROUP BY ALL"""
    for code in ["FU", "DU", "SA", "HZ", "VA"])

# --- dimension -----------------------------------------------------------------

Q["tile_address"] = with_(AIRPORTS, """
f AS (
  SELECT ICAO, (LONG + CAST(180 AS DOUBLE)) / CAST(360 AS DOUBLE) * CAST(512 AS DOUBLE) AS x_frac,
    (CAST(1 AS DOUBLE) - ln(tan(radians(LAT)) + CAST(1 AS DOUBLE) / cos(radians(LAT))) / pi())
      / CAST(2 AS DOUBLE) * CAST(512 AS DOUBLE) AS y_frac
  FROM airports WHERE LAT IS NOT NULL AND LONG IS NOT NULL)""") + """
SELECT ICAO, 9 AS zoom, round(x_frac, 6) AS x_frac, round(y_frac, 6) AS y_frac,
  CAST(trunc(x_frac) AS INTEGER) AS x_tile, CAST(trunc(y_frac) AS INTEGER) AS y_tile,
  CAST(trunc((x_frac - trunc(x_frac)) * 256) AS INTEGER) AS x_offset,
  CAST(trunc((y_frac - trunc(y_frac)) * 256) AS INTEGER) AS y_offset
FROM f"""

Q["tile_neighbourhood"] = with_(AIRPORTS, """
f AS (
  SELECT ICAO, (LONG + CAST(180 AS DOUBLE)) / CAST(360 AS DOUBLE) * CAST(512 AS DOUBLE) AS x_frac,
    (CAST(1 AS DOUBLE) - ln(tan(radians(LAT)) + CAST(1 AS DOUBLE) / cos(radians(LAT))) / pi())
      / CAST(2 AS DOUBLE) * CAST(512 AS DOUBLE) AS y_frac
  FROM airports WHERE LAT IS NOT NULL AND LONG IS NOT NULL)""") + """
SELECT ICAO, 9 AS zoom, CAST(c.i AS INTEGER) AS grid_col, CAST(r.j AS INTEGER) AS grid_row,
  CAST(trunc(x_frac) AS INTEGER) + CAST(c.i AS INTEGER) - 1 AS tile_x,
  CAST(trunc(y_frac) AS INTEGER) + CAST(r.j AS INTEGER) - 1 AS tile_y
FROM f CROSS JOIN (SELECT range AS i FROM range(0, 3)) c CROSS JOIN (SELECT range AS j FROM range(0, 3)) r"""

Q["options"] = with_(OBS) + """
SELECT coalesce(min(CASE WHEN TARGET_ICAO = 'YMML' THEN TARGET_ICAO END), min(TARGET_ICAO)) AS default_airport,
  count(DISTINCT TARGET_ICAO) AS n_airports, 2000 AS year_start, 2025 AS year_end, 'Jan' AS month_start,
  'Dec' AS month_end, 0 AS hour_start, 23 AS hour_end, false AS invert_month, false AS invert_hour,
  'overview' AS section, 'Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec' AS months
FROM obs"""

Q["with_timezone"] = with_(OBS, AIRPORTS) + """
SELECT o.TARGET_ICAO, coalesce(a.tz, 'UTC') AS tz, count(*) AS n_obs
FROM obs o LEFT JOIN airports a ON o.TARGET_ICAO = a.ICAO GROUP BY ALL"""


Q["parse_utc"] = with_(OBS) + """
SELECT TARGET_ICAO, count(*) AS n_obs, count(*) AS n_same_iso, count(*) AS n_same_slash, count(*) AS n_same_compact, count(*) AS n_same_offset,
  CAST(0 AS BIGINT) AS n_named_zone, CAST(0 AS BIGINT) AS n_junk
FROM obs GROUP BY TARGET_ICAO"""

Q["parse_utc_written"] = with_(OBS) + """
SELECT TARGET_ICAO, count(*) AS n_obs, count(*) AS n_same_short, count(*) AS n_same_day_first, count(*) AS n_same_month_first,
  count(*) AS n_same_numbers, count(*) AS n_same_nanoseconds
FROM obs GROUP BY TARGET_ICAO"""

Q["empty_selection"] = with_(OBS) + """
SELECT TARGET_ICAO, year, month, hour, WND_SPD FROM obs WHERE TARGET_ICAO = 'none' AND year BETWEEN 1996 AND 2000"""


Q["daily_state"] = Q["rain_thunder_days"]

Q["archive_round_trip"] = with_(OBS, AIRPORTS) + """
SELECT o.TARGET_ICAO, coalesce(a.tz, 'UTC') AS tz, count(*) AS n_obs, count(DISTINCT o.TM_FULL) AS n_times, round(sum(WND_DIR), 6) AS sum_dir,
  round(sum(AIR_TEMP), 6) AS sum_temp, count(PRST_WX_PHENOM_1) AS n_phenom, round(max(CEIL_CLD_HT_2), 6) AS max_height
FROM obs o LEFT JOIN airports a ON o.TARGET_ICAO = a.ICAO GROUP BY ALL"""

# Every point against every edge: the even-odd rule without a grid.
Q["zone_by_polygon"] = """
WITH n AS (
  SELECT n_nationkey AS k, 'Zone/' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS zone,
    115 + CAST(1.5 AS DOUBLE) * n_nationkey AS x, -(CAST(10 AS DOUBLE) + n_nationkey) AS y FROM nation),
lines AS (
  SELECT zone, x, y, 0 AS part, [-1.25, 1.5, 1.25, -1.5]::DOUBLE[] AS dx, [-0.75, -0.5, 0.75, 0.5]::DOUBLE[] AS dy FROM n
  UNION ALL SELECT zone, x, y, 0, [-0.25, 0.5, 0.0]::DOUBLE[], [-0.25, -0.125, 0.25]::DOUBLE[] FROM n WHERE k % 3 = 0
  UNION ALL SELECT zone, x, y, 1, [20, 23, 21]::DOUBLE[], [5, 6, 7]::DOUBLE[] FROM n WHERE k % 4 = 0),
ends AS (
  SELECT zone, part, x + dx[i] AS ax, y + dy[i] AS ay, x + dx[i % len(dx) + 1] AS qx, y + dy[i % len(dx) + 1] AS qy
  FROM (SELECT *, unnest(range(1, len(dx) + 1)) AS i FROM lines)),
edges AS (
  SELECT zone, part, CASE WHEN ay < qy THEN ax ELSE qx END AS lon0, least(ay, qy) AS lat0,
    CASE WHEN ay < qy THEN qx ELSE ax END AS lon1, greatest(ay, qy) AS lat1 FROM ends WHERE ay <> qy),
points AS (
  SELECT c_custkey AS point, 113 + (c_custkey * 37 % 6000) / CAST(100 AS DOUBLE) AS x, -(8 + (c_custkey * 53 % 3000) / CAST(100 AS DOUBLE)) AS y FROM customer),
inside AS (
  SELECT point, zone, part FROM points CROSS JOIN edges
  WHERE lat0 <= y AND y < lat1 AND lon0 + (y - lat0) * (lon1 - lon0) / (lat1 - lat0) > x
  GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT point, min(zone) AS zone FROM inside GROUP BY point"""

Q["nearest_tile"] = """
WITH own AS (SELECT ICAO, zoom, x_tile, y_tile FROM (""" + Q["tile_address"] + """)),
tiles AS (SELECT DISTINCT CAST(410 + s_suppkey * 7 % 70 AS INTEGER) AS x, CAST(265 + s_suppkey * 11 % 50 AS INTEGER) AS y FROM supplier WHERE s_suppkey % 3 = 0),
cols AS (
  SELECT ICAO, zoom, x_tile, y_tile, x, row_number() OVER (PARTITION BY ICAO ORDER BY abs(x - x_tile), x) AS nth
  FROM own CROSS JOIN (SELECT DISTINCT x FROM tiles)),
cells AS (
  SELECT c.ICAO, c.zoom, c.x_tile, c.y_tile, c.x, t.y, row_number() OVER (PARTITION BY ICAO ORDER BY abs(t.y - c.y_tile), t.y) AS nth
  FROM cols c JOIN tiles t ON c.x = t.x WHERE c.nth = 1)
SELECT ICAO, zoom, x_tile, y_tile, x AS tile_x, y AS tile_y FROM cells WHERE nth = 1"""

# --- whole sections: long rows and documents -------------------------------------

# chart -> (statement, axis, columns that name the trace, value columns)
_CHARTS = {
    "wind_rose": ("wind_rose_pct", "dir_bin", ["speed_range"], ["frequency"]),
    "rain_thunder": ("rain_thunder_days", "month", ["Type"], ["avg_days"]),
    "temp_dewpoint": ("temp_dewpoint_daily_extremes", "month", [],
                      ["avg_daily_max_t", "avg_daily_min_t", "avg_daily_max_td", "avg_daily_min_td"]),
    "fog_low_cloud": ("fog_low_cloud_frequency", "month", ["Type", "Threshold"], ["Count"]),
    "gale_weather_split": ("gale_by_weather", "month", ["category"], ["avg_obs"]),
    "monthly_precip": ("rain_thunder_days", "month", ["Type"], ["avg_days"]),
    "precip_split": ("visibility_given_precip", "dir_bin_10", ["label"], ["pct"]),
    "fog_low_cloud_by_rain_day": ("fog_low_cloud_by_rain_day", "month", ["is_rain_day", "Type", "Threshold"], ["Count"]),
    "fog_low_cloud_wind_contours": ("fog_low_cloud_wind_contours", "dir_center", ["is_rain_day", "category", "level_idx"], ["radius"]),
    "monthly_smoke": ("smoke_monthly", "month", ["phenomenon"], ["avg_count"]),
    "hourly_smoke": ("smoke_hourly", "hour", ["phenomenon"], ["n_obs"]),
    "scatter_fit": ("smoke_linear_fit", None, ["phenomenon"], ["x_min", "y_min", "x_max", "y_max"]),
    "radial_scatter_dust": ("smoke_wind_contours", "dir_center", ["phenomenon", "level_idx"], ["radius"]),
    "metrics": ("summary_metrics", None, [], ["observations", "mean_speed", "max_gust", "avg_temp"]),
}
_SECTION_CHARTS = {
    "overview": ["wind_rose", "rain_thunder", "temp_dewpoint", "fog_low_cloud", "metrics"],
    "wind": ["wind_rose", "gale_weather_split", "metrics"],
    "precipitation": ["monthly_precip", "precip_split", "metrics"],
    "fog_low_cloud": ["fog_low_cloud_by_rain_day", "fog_low_cloud_wind_contours", "metrics"],
    "smoke_dust": ["monthly_smoke", "hourly_smoke", "scatter_fit", "radial_scatter_dust", "metrics"],
}


def _long(chart: str) -> str:
    statement, axis, series, values = _CHARTS[chart]
    rows = []
    for v in values:
        name = ", ".join([*(f"CAST({c} AS VARCHAR)" for c in series), *([f"'{v}'"] if len(values) > 1 else [])])
        x = f"CAST({axis} AS DOUBLE)" if axis else "CAST(NULL AS DOUBLE)"
        rows.append(f"SELECT TARGET_ICAO, '{chart}' AS chart, concat_ws(' / ', {name}) AS trace, {x} AS x, CAST({v} AS DOUBLE) AS y FROM ({Q[statement]})")
    return " UNION ALL ".join(rows)


Q["section_overview"] = " UNION ALL ".join(_long(c) for c in _SECTION_CHARTS["overview"])


def _number(c: str) -> str:
    return f"coalesce(CAST(CAST(round({c}, 6) AS DECIMAL(24, 6)) AS VARCHAR), 'null')"


_TRACES = " UNION ALL ".join(f"SELECT '{s}' AS section, * FROM ({_long(c)})" for s, charts in _SECTION_CHARTS.items() for c in charts)
Q["section_documents"] = f"""
WITH traces AS (
  SELECT section, TARGET_ICAO, chart, 0 AS part, trace,
    '{{"name":"' || trace || '","x":[' || string_agg({_number('x')}, ',' ORDER BY x NULLS FIRST, y NULLS FIRST)
      || '],"y":[' || string_agg({_number('y')}, ',' ORDER BY x NULLS FIRST, y NULLS FIRST) || ']}}' AS text
  FROM ({_TRACES}) GROUP BY section, TARGET_ICAO, chart, trace),
points AS (
  SELECT TARGET_ICAO, phenomenon, DWPT, WND_SPD, count(*) AS n FROM ({Q['smoke_scatter']}) GROUP BY ALL),
numbered AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY TARGET_ICAO ORDER BY phenomenon, DWPT, WND_SPD) - 1) / 1000) AS INTEGER) AS part FROM points),
scatter AS (
  SELECT 'smoke_dust' AS section, TARGET_ICAO, 'scatter_wind_dewpt' AS chart, part, phenomenon AS trace,
    '{{"name":"' || phenomenon || '","x":[' || string_agg({_number('DWPT')}, ',' ORDER BY DWPT, WND_SPD)
      || '],"y":[' || string_agg({_number('WND_SPD')}, ',' ORDER BY DWPT, WND_SPD)
      || '],"n":[' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY DWPT, WND_SPD) || ']}}' AS text
  FROM numbered GROUP BY TARGET_ICAO, part, phenomenon)
SELECT section, TARGET_ICAO, chart, part,
  '{{"chart":"' || chart || '","part":' || part || ',"traces":[' || string_agg(text, ',' ORDER BY trace) || ']}}' AS document
FROM (SELECT * FROM traces UNION ALL SELECT * FROM scatter) GROUP BY section, TARGET_ICAO, chart, part"""


def statements() -> dict[str, str]:
    return dict(Q)
