"""Parameterised reads over the presentation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tsrisk.functions.scoring import finite_or_null, match_label
from tsrisk.names import AREA, DATE, STEP, TYPE
from tsrisk.operators.features import best_per_key, tail_rows
from tsrisk.operators.risk import SLOT_RISK
from tsrisk.plans.present import SHOWN_RISK, period_order
from tsrisk.sources.tables import read_summary

ALL = "ALL"


def _check(name: str, value: int | None, low: int, high: int | None = None) -> None:
    if value is not None and (value < low or (high is not None and value > high)):
        raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high else ""))


def _some(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise LookupError(f"no history found for {what}")
    return df


def _latest(history: DataFrame, limit: int | None) -> DataFrame:
    rows = history if limit is None else tail_rows(history, (), limit)
    return rows.orderBy(DATE)


def summary_view(spark: SparkSession, path: str) -> DataFrame:
    """The stored summary document."""
    return read_summary(spark, path)


def leaderboard_view(board: DataFrame) -> DataFrame:
    return finite_or_null(board).orderBy("mae", "model_group")


def city_forecast(forecast: DataFrame, days: int = 30) -> DataFrame:
    _check("days", days, 1, 30)
    return forecast.where(F.col(STEP) <= days).orderBy(STEP)


def city_history(history: DataFrame, limit: int | None = None) -> DataFrame:
    _check("limit", limit, 30)
    return _latest(history, limit)


def area_risk_view(area_map: DataFrame) -> DataFrame:
    return finite_or_null(area_map).orderBy(F.desc(SHOWN_RISK), AREA)


def area_history(history: DataFrame, area: int, limit: int | None = 365) -> DataFrame:
    _check("limit", limit, 30)
    return _latest(_some(history.where(F.col(AREA) == area), f"district {area}"), limit)


def type_risk_view(type_risk: DataFrame) -> DataFrame:
    return finite_or_null(type_risk).orderBy(F.desc(SHOWN_RISK), TYPE)


def type_history(history: DataFrame, name: str, limit: int | None = 365) -> DataFrame:
    _check("limit", limit, 30)
    return _latest(_some(history.where(match_label(F.col(TYPE), name)), name), limit)


def risk_period_view(
    periods: DataFrame, area: int | None = None, kind: str | None = None, limit: int = 100
) -> DataFrame:
    """Riskiest slots, optionally of one area and one type."""
    _check("limit", limit, 10, 500)
    if area is not None:
        periods = periods.where(F.col(AREA) == area)
    if kind is not None:
        periods = periods.where(match_label(F.col(TYPE), kind))
    return finite_or_null(periods).orderBy(*period_order()).limit(limit)


def filter_selection(df: DataFrame, area=ALL, kind: str = ALL) -> DataFrame:
    """Keep the selected area and type, as far as the table has them; "ALL" keeps everything."""
    if area != ALL and AREA in df.columns:
        df = df.where(F.col(AREA) == int(area))
    if kind != ALL and TYPE in df.columns:
        df = df.where(F.col(TYPE) == kind)
    return df


def worst_slot_per_area(periods: DataFrame, kind: str) -> DataFrame:
    """The riskiest slot of each area for one type."""
    of_type = filter_selection(periods, kind=kind)
    return best_per_key(of_type, [AREA], SLOT_RISK, ["day_name", "hour_label"]).orderBy(AREA)


def mappable(area_map: DataFrame) -> DataFrame:
    """Areas with usable coordinates."""
    return area_map.where(
        F.col("latitude").isNotNull() & (F.col("latitude") != 0)
        & F.col("longitude").isNotNull() & (F.col("longitude") != 0)
    )


def _detail(row: DataFrame, periods: DataFrame, key: str, columns, limit: int) -> DataFrame:
    """A risk row beside its riskiest slots; the row stays when there are none."""
    top = periods.orderBy(*period_order()).limit(limit)
    slots = top.select(key, *columns, F.col("risk_level").alias("period_level"))
    return row.limit(1).join(slots, key, "left").orderBy(F.desc(SLOT_RISK), *columns)


def area_detail(area_map: DataFrame, periods: DataFrame, area: int, kind: str = ALL) -> DataFrame:
    """Risk of one area and its 12 riskiest slots, of the chosen type where the area has any."""
    own = filter_selection(periods, area)
    if kind != ALL:
        chosen = filter_selection(own, kind=kind)
        own = own if chosen.isEmpty() else chosen
    columns = [TYPE, "day_name", "hour_label", "crime_count", SLOT_RISK]
    return _detail(filter_selection(area_map, area), own, AREA, columns, 12)


def type_detail(type_risk: DataFrame, periods: DataFrame, kind: str) -> DataFrame:
    """Risk of one type and its 15 riskiest slots."""
    columns = [AREA, "day_name", "hour_label", "crime_count", SLOT_RISK]
    return _detail(filter_selection(type_risk, kind=kind), filter_selection(periods, kind=kind), TYPE, columns, 15)
