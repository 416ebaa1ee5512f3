"""Times written as text, read by Spark and by pandas, value by value."""

from __future__ import annotations

import warnings

import pandas as pd
import pytest

from stratus.sources.timetext import parse_utc

# Forms that both read.
BOTH = [
    "2023-09-30 22:30", "2023-09-30 22:30:05", "2023-09-30T22:30:05", "2023-09-30T22:30", "2023-09-30", "20230930", "2023/09/30", "2023/09/30 22:30:59",
    "2023-09-30T22:30:05Z", "2023-09-30 22:30:05Z", "2023-09-30 22:30Z", "2023-09-30 22:30 UTC", "2023-09-30 22:30 GMT",
    "2023-09-30 22:30+10:00", "2023-09-30 22:30 +10:00", "2023-09-30 22:30:05+10:00", "2023-09-30 22:30:05-03:30", "2023-09-30T22:30:05.5+1000",
    "2023-09-30 22:30:05.123456", "2023-09-30 22:30:05.123456789", "2023-09-30T22:30:05.1", "2023-09-30 22:30:05.000000001Z",
    "2023-9-3 7:05", "2023-9-3", "2023/9/3 7:05", "2023-09-03 7:05:09", "2023-9-30 22:30:05", "20230930 2230", "20230930T223005",
    "2023-Sep-30", "2023-Sep-30 22:30", "30 Sep 2023", "30 Sep 2023 22:30", "30-Sep-2023 22:30:05", "3 September 2023 7:05", "Sep 30, 2023", "Sep 30 2023 22:30",
    "September 30, 2023 10:30 PM", "Feb 29 2024", "29 feb 2024 12:00 AM", "1 JAN 2020 12:15 pm", "9/30/2023", "9/30/2023 22:30", "30/9/2023", "1/2/2023 03:04",
    " 2023-09-30 22:30 ", "2024-02-29 00:00", "1969-12-31 23:59:59", "1700-01-01 00:00:00",
]
# Texts that are no time for either.
NEITHER = ["", "junk", "2023-13-01 00:00", "2023-02-30", "2023-09-30 25:00", "2023-09-30 22:61", "2023-09-30 22:30:61", "x2023-09-30", "2023-09-30 22:30 x",
           "30 Foo 2023", "Feb 30 2023", "\u0001|2023", "2023-0a-30 22:30", "2023-09-30 2a:30:00"]


def in_pandas(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        t = pd.to_datetime(text, utc=True, errors="coerce")
    return None if pd.isna(t) else t.tz_localize(None).floor("us").to_pydatetime()


def in_spark(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3).select("i", parse_utc("t").alias("u")).collect()
    found = {r.i: r.u for r in rows}
    return [found[i] for i in range(len(texts))]


def test_read_like_pandas(spark):
    for text, got in zip(BOTH, in_spark(spark, BOTH)):
        assert got is not None and got == in_pandas(text), (text, got, in_pandas(text))


def test_no_times(spark):
    for text, got in zip(NEITHER, in_spark(spark, NEITHER)):
        assert got is None and in_pandas(text) is None, (text, got, in_pandas(text))


def test_named_zones_and_null(spark):
    assert in_spark(spark, ["2023-09-30 22:30 Australia/Sydney", None, "2023-09-30 22:30+24:00"]) == [None, None, None]


@pytest.mark.parametrize("zone", ["UTC", "Australia/Sydney"])
def test_session_zone_plays_no_part(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2023-10-01 02:30", "1 Oct 2023 02:30", "2023-10-01T02:30:00+00:00"]
        assert len(set(in_spark(spark, texts))) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
