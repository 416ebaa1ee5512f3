"""Selection of observations: inclusive / inverted ranges and the conjunctive
station-year-month-hour filter (F1-F6).

All predicates are simple comparisons on stored columns, so Catalyst pushes
them into the Parquet scan (``PushedFilters``), the inverted range included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.functions import constants as K


def range_mask(col: str, start: int, end: int, invert: bool = False) -> Column:
    """``start <= c <= end``; inverted: ``c <= start OR c >= end``
    (both ends included in both forms)."""
    c = F.col(col)
    if invert:
        return (c <= F.lit(start)) | (c >= F.lit(end))
    return c.between(F.lit(start), F.lit(end))


def range_filter(df: DataFrame, col: str, start: int, end: int, invert: bool = False) -> DataFrame:
    return df.filter(range_mask(col, start, end, invert))


def month_number(month: int | str) -> int:
    """month given as 1..12 or as a name Jan..Dec."""
    if isinstance(month, int):
        if 1 <= month <= 12:
            return month
        raise ValueError("Invalid month range.")
    if month not in K.MONTH_TO_NUM:
        raise ValueError("Invalid month range.")
    return K.MONTH_TO_NUM[month]


def clamp_ranges(changed: str, years: tuple[int, int], months: tuple[int | str, int | str], hours: tuple[int, int]) -> dict[str, tuple[int, int]]:
    """reversed ranges put right the way the selection sliders do.

    ``changed`` names the bound that was moved last (``year-start``, ``year-end``, ``month-start``, ...).  In a reversed range the
    other bound follows it; a reversed range in which nothing was moved gives way at its start.  Returns the arguments
    ``years``, ``months`` (as numbers) and ``hours`` of :func:`select_observations`.
    """
    out = {}
    for name, (start, end) in {"year": years, "month": (month_number(months[0]), month_number(months[1])), "hour": hours}.items():
        if start > end:
            start, end = (start, start) if changed == f"{name}-start" else (end, end)
        out[f"{name}s"] = (start, end)
    return out


def select_observations(obs: DataFrame, icao: str | None = None,
                        years: tuple[int, int] | None = None,
                        months: tuple[int | str, int | str] = K.DEFAULT_MONTH_RANGE,
                        hours: tuple[int, int] = K.DEFAULT_HOUR_RANGE,
                        invert_month: bool = False, invert_hour: bool = False,
                        strict: bool = False) -> DataFrame:
    """station (default: all), year range (default: all years), month range
    and hour range, the last two optionally inverted.

    ``strict=True`` applies the client-side order checks (F5): a year or hour
    range with start > end is rejected.  Without it a reversed plain range
    simply selects nothing, as the server does.  An empty selection is an
    empty DataFrame with the full schema (F6).
    """
    m0, m1 = month_number(months[0]), month_number(months[1])
    if strict:
        if years is not None and years[0] > years[1]:
            raise ValueError("Year start must not be after year end.")
        if hours[0] > hours[1]:
            raise ValueError("Hour start must not be after hour end.")
    cond = range_mask("month", m0, m1, invert_month) & range_mask("hour", hours[0], hours[1], invert_hour)
    if years is not None:
        cond = range_mask("year", years[0], years[1]) & cond
    if icao is not None:
        cond = (F.col("TARGET_ICAO") == F.lit(icao)) & cond
    return obs.filter(cond)


def drop_null_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """drop rows with a null in any of the named columns."""
    return df.dropna(subset=cols)
