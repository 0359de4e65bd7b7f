"""Raw text to the typed incident table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tsrisk.functions import cleaning as C
from tsrisk.functions.dates import date_part
from tsrisk.names import DAY, TIME

_DAY_PARTS = ("hour", "day_of_week", "week_of_year", "month", "year", "is_weekend")

# --- fixed values: clean column, raw column, conversion, in output order ---
_LEADING = (("id", "ID", C.clean_long), ("case_number", "Case Number", None))
_TRAILING = (
    ("block", "Block", None),
    ("iucr", "IUCR", None),
    ("primary_type", "Primary Type", None),
    ("description", "Description", None),
    ("location_description", "Location Description", None),
    ("arrest", "Arrest", C.clean_bool),
    ("domestic", "Domestic", C.clean_bool),
    ("beat", "Beat", C.clean_int),
    ("district", "District", C.clean_int),
    ("ward", "Ward", C.clean_int),
    ("community_area", "Community Area", C.clean_int),
    ("fbi_code", "FBI Code", None),
    ("x_coordinate", "X Coordinate", C.clean_double),
    ("y_coordinate", "Y Coordinate", C.clean_double),
    ("latitude", "Latitude", C.clean_double),
    ("longitude", "Longitude", C.clean_double),
    ("location", "Location", None),
    ("updated_on", "Updated On", C.parse_ts),
)


def clean_incidents(raw: DataFrame) -> DataFrame:
    """Typed table of 28 columns; rows without a readable time are left out."""
    # The raw columns are called by quoted name because some hold blanks.
    timed = raw.withColumn(TIME, C.parse_ts(F.col("Date"))).where(F.col(TIME).isNotNull())

    def converted(spec):
        return [(F.col(f"`{src}`") if fn is None else fn(F.col(f"`{src}`"))).alias(out) for out, src, fn in spec]

    return timed.select(
        *converted(_LEADING),
        TIME,
        F.col(TIME).cast("date").alias(DAY),
        *[date_part(p, F.col(TIME)).alias(p) for p in _DAY_PARTS],
        *converted(_TRAILING),
    )
