"""Column names, schemas and fixed values shared by every module."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

TIME = "crime_datetime"
DAY = "crime_date"
DATE = "date"
AREA = "district"
TYPE = "primary_type"
HOUR = "hour"
DOW = "day_of_week"
COUNT = "crime_count"
PREDICTED = "predicted_crime_count"
STEP = "forecast_day"

# --- fixed values: areas that take part in panels and risk tables ---------
VALID_AREAS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 16, 17, 18, 19, 20, 22, 24, 25)

# --- fixed value: first day of the calendar; earlier dates are mistyped ----
FIRST_DAY = dt.date(2001, 1, 1)

# --- fixed values: sizes and thresholds, each also a function argument ----
TOP_TYPES = 15
TEST_DAYS = 90
FORECAST_DAYS = 30
MIN_GROUP = 1000
MIN_SLOT = 20
LOW_VOLUME = 100
PERIOD_ROWS = 500

# --- fixed values: lower cuts and labels of the risk bands ----------------
SLOT_BANDS = ((75, "Very High"), (40, "High"), (15, "Moderate"))
SLOT_REST = "Normal"
AREA_BANDS = ((25, "Very High"), (10, "High"), (0, "Moderate"))
AREA_REST = "Low"
ABOVE, BELOW = "Above Recent Baseline", "Below Recent Baseline"
LOW_CONFIDENCE, HIGH_CONFIDENCE = "Low Volume", "Stable"

# --- fixed values: bounding box of valid coordinates ----------------------
LATITUDE_BOX = (41.5, 42.1)
LONGITUDE_BOX = (-88.0, -87.4)

# --- fixed values: day names, Sunday is day 0 -----------------------------
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# --- fixed values: 12-hour time text in the raw file ----------------------
RAW_TIME_FORMAT = "M/d/yyyy h:mm:ss a"

# --- fixed values: the columns the cleaning step needs from the raw file ---
RAW_COLUMNS = (
    "ID",
    "Case Number",
    "Date",
    "Block",
    "IUCR",
    "Primary Type",
    "Description",
    "Location Description",
    "Arrest",
    "Domestic",
    "Beat",
    "District",
    "Ward",
    "Community Area",
    "FBI Code",
    "X Coordinate",
    "Y Coordinate",
    "Updated On",
    "Latitude",
    "Longitude",
    "Location",
)

CORRUPT = "_corrupt_record"


def raw_schema(columns=RAW_COLUMNS) -> T.StructType:
    """Every raw column as text, plus the slot where the reader puts a bad line."""
    fields = [T.StructField(c, T.StringType()) for c in columns]
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_s, _i, _l, _d, _day = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType()

# Declared schemas of the published outputs, so no read infers types.
OUTPUT_SCHEMAS = {
    "citywide_forecast": _struct(
        date=_day, forecast_day=_i, predicted_crime_count=_l, model=_s, selected_model=_s, model_group=_s,
        lower_bound=_l,
        upper_bound=_l,
    ),
    "citywide_7day_forecast": _struct(
        date=_day, forecast_day=_i, predicted_crime_count=_l, model=_s, selected_model=_s, model_group=_s,
        lower_bound=_l,
        upper_bound=_l,
    ),
    "district_risk_map": _struct(
        district=_i, predicted_30_day_crime_count=_l, expected_30_day_count=_d, display_risk_percent=_d,
        risk_direction=_s, risk_level=_s, latitude=_d, longitude=_d,
    ),
    "crime_type_risk": _struct(
        primary_type=_s, predicted_30_day_crime_count=_l, expected_30_day_count=_d, display_risk_percent=_d,
        risk_direction=_s, risk_level=_s, risk_confidence=_s,
    ),
    "high_risk_time_periods": _struct(
        district=_i, primary_type=_s, day_name=_s, hour_label=_s, crime_count=_l,
        share_of_group_percent=_d, risk_percent_vs_group_avg=_d, risk_level=_s,
    ),
    "model_comparison": _struct(
        model=_s, mae=_d, rmse=_d, mape=_d, r2=_d, model_group=_s, order=_s, aic=_d, seasonal_order=_s
    ),
    "citywide_history": _struct(date=_day, crime_count=_l),
    "district_history": _struct(date=_day, district=_i, crime_count=_l),
    "crime_type_history": _struct(date=_day, primary_type=_s, crime_count=_l),
}

SUMMARY_SCHEMA = T.StructType([
    T.StructField("raw_data_start_date", _s),
    T.StructField("raw_data_end_date", _s),
    T.StructField("model_training_start_date", _s),
    T.StructField("model_training_end_date", _s),
    T.StructField("total_clean_records", _l),
    T.StructField("total_training_days", _l),
    T.StructField("best_citywide_model", _s),
    T.StructField("best_citywide_model_group", _s),
    T.StructField("forecast_7_day_total", _l),
    T.StructField("forecast_30_day_total", _l),
    T.StructField("top_district_by_risk", _struct(
        district=_i, predicted_30_day_crime_count=_l, risk_percent=_d, risk_level=_s)),
    T.StructField("top_crime_type_by_risk", _struct(
        primary_type=_s, predicted_30_day_crime_count=_l, risk_percent=_d, risk_level=_s, risk_confidence=_s)),
])
