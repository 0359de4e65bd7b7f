"""Tolerant casts: a bad value becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spark would also read Java forms such as "1d" or "0x1p3" as numbers.
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"
_DIGITS = r"^\s*[+-]?\d+\s*$"


def clean_double(col: Column) -> Column:
    """Number from text. The pattern comes first: a failing cast is far dearer than a match."""
    text = F.trim(col)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def clean_int(col: Column) -> Column:
    """Whole number from text; decimals round half away from zero, overflow is NULL."""
    return F.round(clean_double(col)).try_cast("int")


def clean_long(col: Column) -> Column:
    """As `clean_int`, with all 64 bits of plain digits."""
    text, rounded = F.trim(col), F.round(clean_double(col))
    fitting = F.when(F.abs(rounded) < 2.0**63, rounded.try_cast("bigint"))
    return F.when(text.rlike(_DIGITS), text.try_cast("bigint")).otherwise(fitting)


def clean_bool(col: Column) -> Column:
    """true / false in any case and padding; everything else is NULL."""
    word = F.lower(F.trim(col))
    return F.when(word == "true", True).when(word == "false", False)


# Month, day, year, hour, minute, second and half of the day, as RAW_TIME_FORMAT has them.
_TIME = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (0?[1-9]|1[0-2]):(\d{1,2}):(\d{1,2}) (?i:am|pm)$"


def parse_ts(col: Column) -> Column:
    """12-hour clock text to a zone-free timestamp, NULL when it does not parse; no session zone is involved."""
    text = F.rtrim(F.trim(col), F.lit("\r\n"))
    # One match turns the text round for the cast; text that does not match still ends in its half of the day, which no cast takes.
    turned = F.regexp_replace(text, _TIME, r"$3-$1-$2 $4:$5:$6").try_cast("timestamp_ntz")
    half, noon, none = F.lower(F.right(text, F.lit(3))), F.make_dt_interval(hours=F.lit(12)), F.make_dt_interval()
    shifted = turned - F.when(F.hour(turned) == 12, noon).otherwise(none)
    return F.when(half == " am", shifted).when(half == " pm", shifted + noon)
