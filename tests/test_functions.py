"""Column expressions on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tsrisk import names as N
from tsrisk.functions import cleaning as C, dates as D, scoring as S


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_tolerant_numbers(spark):
    rows = ["012", "12.0", "12.5", "-2.5", " 7 ", "1e2", "abc", "", "  ", None, "99999999999", "NaN", "Infinity", "1d", "+5", ".5"]
    got = values(spark, [(r,) for r in rows], "t string", C.clean_int(F.col("t")))
    assert [g[0] for g in got] == [12, 12, 13, -3, 7, 100, None, None, None, None, None, None, None, None, 5, 1]


def test_long_keeps_all_digits(spark):
    rows = [("9007199254740993",), ("12.0",), ("9223372036854775808",)]
    assert values(spark, rows, "t string", C.clean_long(F.col("t"))) == [(9007199254740993,), (12,), (None,)]


def test_booleans_are_three_valued(spark):
    rows = [(" TRUE ",), ("false",), ("yes",), ("",), (None,)]
    assert values(spark, rows, "t string", C.clean_bool(F.col("t"))) == [(True,), (False,), (None,), (None,), (None,)]


def test_timestamps(spark):
    rows = ["01/02/2003 04:05:06 PM", "1/2/2003 4:05:06 pm", "  01/02/2003 04:05:06 PM ", "13/02/2003 04:05:06 PM",
            "2003-01-02 04:05:06", "", None, "01/02/2003 12:00:00 AM",
            "01/02/2003 04:05:06 PM\r\n", "2003-01-02 04:05:06 PM", "2003-01-02 04:05:06 Europe/Amsterdam", "01/02/2003 0:05:06 PM",
            "01/02/2003 13:05:06 AM", "01/02/2003 04:60:06 AM", "01/02/2003 04:05:60 AM", "2/30/2003 04:05:06 AM", "01/02/2003 12:00:00 PM"]
    afternoon = dt.datetime(2003, 1, 2, 16, 5, 6)
    got = values(spark, [(r,) for r in rows], "t string", C.parse_ts(F.col("t")))
    assert [g[0] for g in got] == [afternoon] * 3 + [None] * 4 + [dt.datetime(2003, 1, 2), afternoon] + [None] * 7 + [dt.datetime(2003, 1, 2, 12)]


def test_date_parts(spark):
    days = [(dt.date(2024, 12, 29),), (dt.date(2024, 12, 30),)]  # a Sunday; week 1 beside year 2024
    df = D.with_date_parts(spark.createDataFrame(days, "date date"), "date")
    got = [tuple(r)[1:] for r in df.select("date", "day_of_week", "week_of_year", "year", "is_weekend").collect()]
    assert got == [(0, 52, 2024, True), (1, 1, 2024, False)]


def test_labels(spark):
    rows = [(0, 0), (6, 23)]
    got = values(spark, rows, "d int, h int", D.day_name(F.col("d")), D.hour_label(F.col("h")))
    assert got == [("Sunday", "00:00"), ("Saturday", "23:00")]


@pytest.mark.parametrize("value,slot,area", [
    (75.0, "Very High", "Very High"), (74.99, "High", "Very High"), (40.0, "High", "Very High"),
    (15.0, "Moderate", "High"), (14.99, "Normal", "High"), (9.99, "Normal", "Moderate"), (0.0, "Normal", "Moderate"),
    (-0.01, "Normal", "Low"), (None, "Normal", "Low"),
])
def test_bands(spark, value, slot, area):
    got = values(spark, [(value,)], "v double", S.slot_band(F.col("v")), S.band(F.col("v")))
    assert got == [(slot, area)]


def test_direction_and_confidence(spark):
    rows = [(0.0, 99), (0.01, 100), (None, None)]
    got = values(spark, rows, "v double, n int", S.direction(F.col("v")), S.confidence(F.col("n")))
    assert got == [(N.BELOW, "Low Volume"), (N.ABOVE, "Stable"), (N.BELOW, "Stable")]


def test_percentages_without_base_are_null(spark):
    rows = [(5.0, 0.0), (5.0, None), (0.0, 0.0), (125.0, 100.0)]
    got = values(spark, rows, "a double, b double", S.percent_deviation(F.col("a"), F.col("b")),
                 S.share_percent(F.col("a"), F.col("b")))
    assert got == [(None, None), (None, None), (None, None), (25.0, 125.0)]


def test_two_rounding_rules(spark):
    rows = [(100.125, 100.0), (100.375, 100.0)]
    up = values(spark, rows, "a double, b double", S.percent_deviation(F.col("a"), F.col("b")))
    even = values(spark, rows, "a double, b double", S.percent_deviation(F.col("a"), F.col("b"), half_even=True))
    assert up == [(0.13,), (0.38,)] and even == [(0.12,), (0.38,)]


def test_text_helpers(spark):
    rows = [("", None, "x"), ("a", "b", "c")]
    assert values(spark, rows, "a string, b string, c string", S.first_nonempty(*map(F.col, "abc"))) == [("x",), ("a",)]
    rows = [("MOTOR VEHICLE THEFT",), ("motor vehicle theft",), ("THEFT",)]
    got = values(spark, rows, "t string", S.match_label(F.col("t"), "motor-vehicle-theft"))
    assert got == [(True,), (True,), (False,)]


def test_not_finite_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (-float("inf"), 3), (1.5, 4)], "v double, i int")
    assert [tuple(r) for r in S.finite_or_null(df).collect()] == [(None, 1), (None, 2), (None, 3), (1.5, 4)]
