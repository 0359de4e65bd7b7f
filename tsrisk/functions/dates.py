"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tsrisk.names import DAY_NAMES

_PARTS = {
    "hour": F.hour,
    "day": F.day,
    "month": F.month,
    "year": F.year,
    "day_of_week": lambda c: F.dayofweek(c) - 1,
    "week_of_year": F.weekofyear,
    # A missing date counts as a weekday.
    "is_weekend": lambda c: F.coalesce(F.dayofweek(c).isin(1, 7), F.lit(False)),
}
DATE_PARTS = ("day", "month", "year", "day_of_week", "week_of_year", "is_weekend")


def date_part(part: str, col: Column) -> Column:
    return _PARTS[part](col)


def with_date_parts(df: DataFrame, col: str, parts=DATE_PARTS) -> DataFrame:
    """Add calendar parts of `col`; Sunday is day 0 and weeks are ISO weeks."""
    return df.withColumns({p: date_part(p, F.col(col)) for p in parts})


def day_name(dow: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAY_NAMES)), dow + 1)


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00", hour.cast("int"))


def iso_date(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")
