"""Observation times written as text.

Texts in the usual fixed layouts are told by their length and a few separators and go straight to Spark's own
timestamp reader, without a regular expression.  Every other text is matched once: one replacement turns it into its parts,
which are then put together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MON = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_MARK = "\u0001"

# Groups: 1 year, 2 separator, 3 month, 4 day (2023-09-30, 2023/9/3, 2023-Sep-30); 5 month, 6 day (20230930); 7 day, 8 month, 9 year (30 Sep 2023);
# 10 month, 11 day, 12 year (September 30, 2023); 13 month, 14 day, 15 year (9/30/2023); 16 hour; 17 minute, 18 second, 19 fraction
# (with colons); 20 minute, 21 second, 22 fraction (without); 23 am or pm; 24 UTC; 25 sign, 26 hours, 27 minutes of an offset.
# Nothing that has matched is given back, so a text of another form fails at once.
_TEXT = (r"(?i)^(?:(\d{4})(?:([-/])(\d{1,2}+|" + _MON + r"[a-z]*+)\2(\d{1,2}+)|(\d{2})(\d{2}))"
         r"|(\d{1,2}+)[- ](" + _MON + r"[a-z]*+)[- ,]++(\d{4})"
         r"|(" + _MON + r"[a-z]*+)[- ](\d{1,2}+),?+[- ]++(\d{4})"
         r"|(\d{1,2}+)/(\d{1,2}+)/(\d{4}))"
         r"(?:[ T]++(\d{1,2}+)(?::(\d{1,2}+)(?::(\d{1,2}+)(?:\.(\d{1,9}+)\d*+)?+)?+|(\d{2})(?:(\d{2})(?:\.(\d{1,9}+)\d*+)?+)?+)\s*+(am|pm)?+)?+"
         r"\s*+(?:(z|utc|gmt)|([+-])(\d{2})(?::?+(\d{2}))?+)?+$")
# Parts of a text: year, month, day; the two numbers of a date with the month first; hour, minute, second, fraction, am or pm; offset.
# Only one of a part's groups can have matched, so they are joined.
_PARTS = ["$1$9$12$15", "$3$5$8$10", "$4$6$7$11", "$13", "$14", "$16", "$17$20", "$18$21", "$19$22", "$23", "$25", "$26", "$27"]
_DAY_MINUTES = 24 * 60


def _at(s: str, place: int, length: int = 1) -> str:
    return f"substring({s}, {place}, {length})"


def _behind(wall: str, sign: str, hours: str, minutes: str) -> str:
    """SQL: a wall-clock time less an offset of less than a day."""
    total = f"(try_cast({hours} as int) * 60 + try_cast({minutes} as int))"
    return f"if({total} < {_DAY_MINUTES}, {wall} + make_dt_interval(0, 0, if({sign} = '-', {total}, -{total}), 0), null)"


def _parts_to_time() -> str:
    """SQL: time from the array of parts ``p`` (a mark, then ``_PARTS``; an absent one is empty), put in order for Spark's reader."""
    name = f"cast((instr('{MONTHS}', lower(left(p[2], 3))) + 2) div 3 as string)"
    swapped = "cast(p[4] as int) > 12 and cast(p[5] as int) <= 12"
    month = f"if(p[4] = '', if(p[2] < 'A', p[2], {name}), if({swapped}, p[5], p[4]))"
    day = f"if(p[4] = '', p[3], if({swapped}, p[4], p[5]))"
    half = "if(cast(p[6] as int) between 1 and 12, cast(cast(p[6] as int) % 12 + if(lower(p[10]) = 'pm', 12, 0) as string), null)"
    hour = f"if(p[10] = '', if(p[6] = '', '0', p[6]), {half})"
    second = "if(p[8] = '', '0', if(p[9] = '', p[8], concat(p[8], '.', left(p[9], 6))))"
    wall = f"try_cast(concat(p[1], '-', {month}, '-', {day}, ' ', {hour}, ':', if(p[7] = '', '0', p[7]), ':', {second}) as timestamp_ntz)"
    shifted = _behind("w", "p[11]", "p[12]", "if(p[13] = '', '00', p[13])")
    return f"if(p[11] = '', {wall}, transform(array({wall}), w -> {shifted})[0])"


def _any_text(s: str) -> str:
    """SQL: a text in any of the forms of ``_TEXT``, matched once, its parts bound once."""
    pattern = _TEXT.replace("\\", "\\\\")
    matched = f"regexp_replace({s}, '{pattern}', '{_MARK}|{'|'.join(_PARTS)}')"
    parts = f"transform(array(split(m, '[|]', -1)), p -> {_parts_to_time()})[0]"
    return f"if({_at(s, 1)} <> '{_MARK}', transform(array({matched}), m -> if({_at('m', 1)} = '{_MARK}', {parts}, null))[0], null)"


def parse_utc(name: str) -> Column:
    """Parse a column of observation times as UTC; text that is no time -> null.

    A date is 2023-09-30, 2023/9/3, 20230930, 2023-Sep-30, 30 Sep 2023, September 30, 2023 or 9/30/2023 (month first unless it
    cannot be one), a time of day 22:30, 7:05, 22:30:05.123456789 (digits beyond the sixth are cut off), 2230, 223005 or 10:30 pm, and a zone UTC, GMT, Z
    or a numeric offset, which is taken off.  Text without a zone is read as UTC; named zones are null.
    The session time zone plays no part.
    """
    s = "trim(cast(`" + name.replace("`", "``") + "` as string))"
    n, to_second = f"length({s})", f"{_at(s, 17)} = ':'"
    ntz = "try_cast({} as timestamp_ntz)".format
    whole = f"({n} = 16 or {n} = 19 and {to_second})"
    # Day and time of day apart by a blank or T, hours and minutes by a colon: what is left to Spark's reader is digits.
    dashes = f"""case when {whole} then {ntz(s)}
        when {n} = 20 and {to_second} and {_at(s, 20)} = 'Z' then {ntz(_at(s, 1, 19))}
        when {n} = 25 and {to_second} and {_at(s, 20)} in ('+', '-') and {_at(s, 23)} = ':'
            then {_behind(ntz(_at(s, 1, 19)), _at(s, 20), _at(s, 21, 2), _at(s, 24, 2))}
        when {n} = 23 and {_at(s, 17)} = ' ' and {_at(s, 18)} in ('+', '-') and {_at(s, 21)} = ':'
            then {_behind(ntz(_at(s, 1, 16)), _at(s, 18), _at(s, 19, 2), _at(s, 22, 2))} end"""
    day = f"{_at(s, 1, 4)}, '-', {_at(s, 5, 2)}, '-', {_at(s, 7, 2)}"
    usual = f"""case when {_at(s, 14)} = ':' and {_at(s, 11)} in (' ', 'T') and {_at(s, 5)} = '-' then {dashes}
        when {_at(s, 14)} = ':' and {_at(s, 11)} in (' ', 'T') and {_at(s, 5)} = '/' and {whole} then {ntz(f"replace({s}, '/', '-')")}
        when {n} = 13 and {_at(s, 9)} = ' ' and {_at(s, 5)} not in ('-', '/') then {ntz(f"concat({day}, ' ', {_at(s, 10, 2)}, ':', {_at(s, 12, 2)})")} end"""
    return F.expr(f"coalesce({usual}, {_any_text(s)})")
