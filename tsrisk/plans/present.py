"""Labelled presentation tables and the summary document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tsrisk.functions.dates import day_name, hour_label, iso_date
from tsrisk.functions.scoring import confidence, direction, slot_band
from tsrisk.names import AREA, COUNT, DATE, DOW, HOUR, PERIOD_ROWS, PREDICTED, STEP, TYPE
from tsrisk.operators.risk import AREA_RISK, EXPECTED, SLOT_RISK, TOTAL_30

SHOWN_RISK = "display_risk_percent"


def period_order():
    """Riskiest slot first, ties by key."""
    return [F.desc(SLOT_RISK), AREA, TYPE, "day_name", "hour_label"]


def _labelled(risk: DataFrame) -> DataFrame:
    shown = risk.withColumn(SHOWN_RISK, F.bround(AREA_RISK, 2))
    return shown.withColumn("risk_direction", direction(F.col(AREA_RISK)))


def present_area_map(points: DataFrame) -> DataFrame:
    columns = [AREA, TOTAL_30, EXPECTED, SHOWN_RISK, "risk_direction", "risk_level", "latitude", "longitude"]
    return _labelled(points).select(*columns).orderBy(F.desc(SHOWN_RISK), AREA)


def present_type_risk(risk: DataFrame) -> DataFrame:
    labelled = _labelled(risk).withColumn("risk_confidence", confidence(F.col(TOTAL_30)))
    columns = [TYPE, TOTAL_30, EXPECTED, SHOWN_RISK, "risk_direction", "risk_level", "risk_confidence"]
    return labelled.select(*columns).orderBy(F.desc(SHOWN_RISK), TYPE)


def present_periods(periods: DataFrame, rows: int | None = PERIOD_ROWS) -> DataFrame:
    """The `rows` riskiest slots with readable day and hour; all of them, unordered, for None."""
    top = periods if rows is None else periods.orderBy(F.desc(SLOT_RISK), AREA, TYPE, DOW, HOUR).limit(rows)
    shown = top.select(
        AREA,
        TYPE,
        day_name(F.col(DOW)).alias("day_name"),
        hour_label(F.col(HOUR)).alias("hour_label"),
        COUNT,
        "share_of_group_percent",
        SLOT_RISK,
        slot_band(F.col(SLOT_RISK)).alias("risk_level"),
    )
    return shown if rows is None else shown.orderBy(*period_order())


def present_history(panel: DataFrame, keys=()) -> DataFrame:
    """Counts per day as chart data, the date as ISO text."""
    return panel.select(iso_date(F.col(DATE)).alias(DATE), *keys, COUNT).orderBy(DATE, *keys)


def present_forecast(selected: DataFrame, days: int | None = None) -> DataFrame:
    """The chosen forecast, of all or the first `days` days; bounds are NULL where its group has none."""
    columns = [STEP, PREDICTED, "model", "selected_model", "model_group"]
    bounds = [
        (F.col(c) if c in selected.columns else F.lit(None)).cast("bigint").alias(c) for c in ("lower_bound", "upper_bound")
    ]
    rows = selected if days is None else selected.where(F.col(STEP) <= days)
    return rows.select(iso_date(F.col(DATE)).alias(DATE), *columns, *bounds).orderBy(STEP)


def summary(
    cube: DataFrame, city_panel: DataFrame, forecast: DataFrame, area_map: DataFrame, type_risk: DataFrame
) -> DataFrame:
    """One row: date ranges, totals, best model and the leading area and type as nested records.

    Every figure is a scalar subquery over a count or presentation table.
    """
    def text(column):
        return column.cast("string")

    def leader(table: DataFrame, key: str, *more: str):
        record = F.struct(key, TOTAL_30, F.col(SHOWN_RISK).alias("risk_percent"), "risk_level", *more)
        return table.orderBy(F.desc_nulls_last(SHOWN_RISK), key).limit(1).select(record).scalar()

    raw = cube.agg(F.struct(F.min(DATE).alias("first"), F.max(DATE).alias("last"), F.sum(COUNT).alias("n"))).scalar()
    safe = city_panel.agg(
        F.struct(F.min(DATE).alias("first"), F.max(DATE).alias("last"), F.count(F.lit(1)).alias("n"))
    ).scalar()
    ahead = forecast.agg(
        F.struct(
            F.first("selected_model").alias("model"),
            F.first("model_group").alias("group"),
            F.sum(F.when(F.col(STEP) <= 7, F.col(PREDICTED))).alias("week"),
            F.sum(PREDICTED).alias("month"),
        )
    ).scalar()
    facts = cube.sparkSession.range(1).select(
        raw.alias("raw"),
        safe.alias("safe"),
        ahead.alias("ahead"),
        leader(area_map, AREA).alias("top_district_by_risk"),
        leader(type_risk, TYPE, "risk_confidence").alias("top_crime_type_by_risk"),
    )
    return facts.select(
        text(F.col("raw.first")).alias("raw_data_start_date"),
        text(F.col("raw.last")).alias("raw_data_end_date"),
        text(F.col("safe.first")).alias("model_training_start_date"),
        text(F.col("safe.last")).alias("model_training_end_date"),
        F.col("raw.n").alias("total_clean_records"),
        F.col("safe.n").alias("total_training_days"),
        F.col("ahead.model").alias("best_citywide_model"),
        F.col("ahead.group").alias("best_citywide_model_group"),
        F.col("ahead.week").alias("forecast_7_day_total"),
        F.col("ahead.month").alias("forecast_30_day_total"),
        "top_district_by_risk",
        "top_crime_type_by_risk",
    )
