"""Row-level Column expressions: predicates (tokens, ceilings, gales) and
derived values (direction bins, speed bands, local 9 am day, labels, bands).

All of them are plain ``pyspark.sql.Column`` trees, so they stay inside
whole-stage codegen; none needs a Python UDF.  Every boolean returned here is
never null (a missing value compares as False), which makes them safe to
negate, sum or use as grouping keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratus.functions import constants as K


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def false_if_null(cond: Column) -> Column:
    """Comparisons with a missing value count as False."""
    return F.coalesce(cond, F.lit(False))


# ---------------------------------------------------------------------------
# Token predicates
# ---------------------------------------------------------------------------

def upper_text(c: str | Column) -> Column:
    """Field as upper-case text, null as the empty string."""
    return F.upper(F.coalesce(_col(c).cast("string"), F.lit("")))


def fields_text(fields: Sequence[str], available: Iterable[str] | None = None) -> Column | None:
    """The present fields, upper-cased (null -> ""), joined by one space.

    None when no field is present.
    """
    avail = None if available is None else set(available)
    present = [f for f in fields if avail is None or f in avail]
    if not present:
        return None
    return F.concat_ws(" ", *[upper_text(f) for f in present])


def token_pattern(tokens: Iterable[str]) -> str:
    """Java regex matching any of the tokens literally (alternation of quoted tokens)."""
    return "|".join("\\Q" + t + "\\E" for t in tokens)


def text_has_token(text: Column, tokens: Iterable[str]) -> Column:
    tokens = list(tokens)
    if not tokens:
        return F.lit(False)
    return text.rlike(token_pattern(tokens))


def token_mask(fields: Sequence[str], tokens: Iterable[str],
               available: Iterable[str] | None = None) -> Column:
    """True when any token occurs as a substring of the upper-cased fields
    joined by a space (no token contains a space, so none can straddle two
    fields).  Fields absent from ``available`` (the frame's columns) are
    ignored; with no field left the mask is constant False.

    Each field is referenced once (one regex search per row), which keeps
    generated code small even when the fields are themselves expressions.
    """
    text = fields_text(fields, available)
    if text is None:
        return F.lit(False)
    return text_has_token(text, tokens)


def phenom_mask(tokens: Iterable[str], available: Iterable[str] | None = None) -> Column:
    """Token mask over the two present-weather phenomenon fields."""
    return token_mask(K.PHENOM_FIELDS, tokens, available)


def is_rain_obs(available: Iterable[str] | None = None) -> Column:
    return token_mask(K.WX_FIELDS, K.RAIN_DAY_TOKENS, available)


def is_thunder_obs(available: Iterable[str] | None = None) -> Column:
    return token_mask(K.DSC_FIELDS, K.THUNDER_TOKENS, available)


def is_precip(available: Iterable[str] | None = None) -> Column:
    return token_mask(K.WX_FIELDS, K.PRECIP_TOKENS, available)


def layer_is_ceiling(amount: str | Column, upper: bool = True) -> Column:
    """Cloud layer amount starts with BKN or OVC (optionally case-folded)."""
    text = F.coalesce(_col(amount).cast("string"), F.lit(""))
    if upper:
        text = F.upper(text)
    cond = None
    for prefix in K.CEILING_AMOUNTS:
        term = text.startswith(prefix)
        cond = term if cond is None else (cond | term)
    return cond


def fog_or_ceiling(fog_tokens: Iterable[str] = K.FOG_TOKENS, upper_amounts: bool = False) -> Column:
    """Fog token on the phenomenon fields, or either layer is a ceiling (no height test)."""
    return (phenom_mask(fog_tokens)
            | layer_is_ceiling("CEIL_CLD_AMT_1", upper_amounts)
            | layer_is_ceiling("CEIL_CLD_AMT_2", upper_amounts))


def is_gale(speed: str = "WND_SPD", gust: str = "MAX_WND_GUST_10") -> Column:
    return (false_if_null(_col(speed) > F.lit(K.GALE_SPEED_MPS))
            | false_if_null(_col(gust) > F.lit(K.GALE_GUST_MPS)))


# ---------------------------------------------------------------------------
# Derived values
# ---------------------------------------------------------------------------

def dir_bin_16(direction: str | Column = "WND_DIR") -> Column:
    """16-point sector start: ((dir + 11.25) mod 360) // 22.5 * 22.5 (DOUBLE)."""
    shifted = F.pmod(_col(direction) + F.lit(11.25), F.lit(360.0))
    return (F.floor(shifted / F.lit(22.5)) * F.lit(22.5)).cast("double")


def dir_bin_10(direction: str | Column = "WND_DIR") -> Column:
    """10-degree bin centred on the bearing: ((dir + 5) mod 360) // 10 * 10 (INT)."""
    shifted = F.pmod(_col(direction) + F.lit(5.0), F.lit(360.0))
    return (F.floor(shifted / F.lit(10.0)) * F.lit(10)).cast("int")


def speed_band(speed: str | Column = "WND_SPD", unit_factor: float = K.MPS_TO_KT) -> Column:
    """Speed band label; ``unit_factor`` converts the stored unit to knots."""
    value = _col(speed) * F.lit(float(unit_factor)) if unit_factor != 1 else _col(speed)
    expr = None
    for edge, label in zip(K.SPEED_BAND_EDGES, K.SPEED_BAND_LABELS):
        cond = value < F.lit(edge)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(
        expr.otherwise(F.lit(K.SPEED_BAND_LABELS[-1])))


_FAR_DAYS = 800_000


def obs_day(ts: str | Column = "TM_FULL", tz: str | Column = "tz") -> Column:
    """Local climatological day: local date of (instant - 9 h) in the station zone.

    ``ts`` is a TIMESTAMP_NTZ holding UTC wall-clock time.  The 9 hours are
    elapsed time, so they are taken off before the zone conversion (doing it
    after the conversion is wrong on daylight-saving change days).  Instants and local times are
    counted in microseconds, so the result does not depend on the session time zone.
    """
    day = F.lit(24 * 3600 * 1000000).cast("long")
    since = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), _col(ts))
    # One zone lookup a row; converting between two named zones takes two.
    local = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(since - F.lit(K.OBS_DAY_SHIFT_HOURS * 3600 * 1000000).cast("long")), _col(tz)))
    # Whole days, counted from long before the first year so that the division always rounds down.
    return F.date_from_unix_date((F.call_function("div", local + day * F.lit(_FAR_DAYS).cast("long"), day) - F.lit(_FAR_DAYS)).cast("int"))


def month_label(month: str | Column = "month") -> Column:
    """1..12 -> Jan..Dec."""
    return F.try_element_at(F.array(*[F.lit(m) for m in K.MONTH_NAMES]), _col(month).cast("int"))


def month_start_date(year: str | Column = "year", month: str | Column = "month") -> Column:
    return F.make_date(_col(year), _col(month), F.lit(1))


def ceiling_band_exclusive(height: str | Column) -> Column:
    """Exclusive height band label; the last band has no upper limit."""
    h = _col(height)
    expr = None
    for edge, label in zip(K.CEILING_BAND_EDGES, K.CEILING_BAND_LABELS):
        cond = h < F.lit(edge)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when(h.isNull(), F.lit(None).cast("string")).otherwise(
        expr.otherwise(F.lit(K.CEILING_BAND_LABELS[-1])))


def numeric_height(c: str) -> Column:
    """Cloud height coerced to a number; text that is not a number -> null."""
    return F.expr(f"try_cast({c} AS DOUBLE)")


# Per-row cloud helper columns added by :func:`with_cloud_columns`.
CEIL_FLAG_COLS = ("_ceil1", "_ceil2")
HEIGHT_COLS = ("_ht1", "_ht2")


def with_cloud_columns(df):
    """Add per-layer ceiling flags (upper-cased BKN/OVC prefix) and numeric
    heights once, so that several band/threshold flags can reuse them."""
    return df.select("*",
                     layer_is_ceiling("CEIL_CLD_AMT_1", upper=True).alias("_ceil1"),
                     layer_is_ceiling("CEIL_CLD_AMT_2", upper=True).alias("_ceil2"),
                     numeric_height("CEIL_CLD_HT_1").alias("_ht1"),
                     numeric_height("CEIL_CLD_HT_2").alias("_ht2"))


def layered_ceiling_flag(lower: float | None, upper: float) -> Column:
    """Either layer is a ceiling with lower <= height < upper (never null).

    Needs the columns of :func:`with_cloud_columns`.
    """
    out = None
    for ceil, ht in zip(CEIL_FLAG_COLS, HEIGHT_COLS):
        h = F.col(ht)
        cond = F.col(ceil) & (h < F.lit(upper))
        if lower is not None:
            cond = cond & (h >= F.lit(lower))
        term = false_if_null(cond)
        out = term if out is None else (out | term)
    return out


def cumulative_ceiling_flag(threshold: float) -> Column:
    """Either layer is a ceiling below ``threshold`` feet (never null).

    Needs the columns of :func:`with_cloud_columns`.
    """
    return layered_ceiling_flag(None, threshold)


def gale_category(dsc_text: Column | None = None, phen_text: Column | None = None) -> Column:
    """TS if a descriptor holds TS; else SHRA if a descriptor holds SH and a
    phenomenon holds RA; else 'No wx'."""
    dsc = dsc_text if dsc_text is not None else fields_text(K.DSC_FIELDS)
    phen = phen_text if phen_text is not None else fields_text(K.PHENOM_FIELDS)
    return (F.when(text_has_token(dsc, ["TS"]), F.lit("TS"))
            .when(text_has_token(dsc, ["SH"]) & text_has_token(phen, ["RA"]), F.lit("SHRA"))
            .otherwise(F.lit("No wx")))


def phenomenon_code(codes: Sequence[str] = K.SMOKE_TOKENS, phen_text: Column | None = None) -> Column:
    """First code (in the given order) found in either phenomenon field, else 'Other'."""
    phen = phen_text if phen_text is not None else fields_text(K.PHENOM_FIELDS)
    expr = None
    for code in codes:
        cond = phen.contains(code)
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return expr.otherwise(F.lit("Other"))


# ---------------------------------------------------------------------------
# Rounding
# ---------------------------------------------------------------------------

_SPLITTER = 134217729.0   # 2**27 + 1 (Veltkamp splitting constant for doubles)


def round_binary(x: Column, digits: int = 3) -> Column:
    """Round a non-negative double to ``digits`` decimals the way a binary
    float is rounded exactly: to the nearest ``digits``-decimal number of its
    *exact binary value*, ties (only possible for exactly representable
    midpoints) to even.

    Spark's ``bround`` decides on the shortest decimal form of the double,
    which differs for values like 0.1235 (stored just below the midpoint).
    Near a midpoint M / 10**(digits+1) (M ending in 5) the sign of
    x * 10**(digits+1) - M is computed exactly: x is split into two halves
    with at most 27 significant bits each, both products with 10**(digits+1)
    are exact, and so is the difference to M (Sterbenz).  Elsewhere the
    nearest value is unambiguous and ``bround`` gives it.
    """
    scale = float(10 ** (digits + 1))
    t = x * F.lit(scale)
    m = F.round(t, 0)
    near_mid = (F.pmod(m, F.lit(10.0)) == F.lit(5.0)) & (F.abs(t - m) < F.lit(0.5))
    c = x * F.lit(_SPLITTER)
    hi = c - (c - x)
    lo = x - hi
    sign = (hi * F.lit(scale) - m) + lo * F.lit(scale)
    up = (m + F.lit(5.0)) / F.lit(scale)
    down = (m - F.lit(5.0)) / F.lit(scale)
    return (F.when(near_mid & (sign > F.lit(0.0)), up)
            .when(near_mid & (sign < F.lit(0.0)), down)
            .otherwise(F.bround(x, digits)))


# ---------------------------------------------------------------------------
# Web-Mercator tile address
# ---------------------------------------------------------------------------

def tile_fraction_x(lon: str | Column, zoom: int = K.TILE_ZOOM) -> Column:
    n = float(2 ** zoom)
    return (_col(lon) + F.lit(180.0)) / F.lit(360.0) * F.lit(n)


def tile_fraction_y(lat: str | Column, zoom: int = K.TILE_ZOOM) -> Column:
    n = float(2 ** zoom)
    phi = F.radians(_col(lat))
    merc = F.log(F.tan(phi) + F.lit(1.0) / F.cos(phi))
    return (F.lit(1.0) - merc / F.lit(3.141592653589793)) / F.lit(2.0) * F.lit(n)
