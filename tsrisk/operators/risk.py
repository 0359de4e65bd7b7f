"""Historical and forecast-based risk tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tsrisk import names as N
from tsrisk.functions.scoring import band, not_null, percent_deviation, raw_deviation, share_percent, slot_band
from tsrisk.names import AREA, COUNT, DATE, DOW, HOUR, TYPE
from tsrisk.operators.counts import roll_up_days
from tsrisk.operators.panel import key_list

SLOT_RISK = "risk_percent_vs_group_avg"
AREA_RISK = "risk_percent_vs_recent_baseline"
HISTORY_RISK = "risk_percent_vs_historical_avg"
EXPECTED = "expected_30_day_count"
RECENT = "recent_30_day_count"
TOTAL_30 = "predicted_30_day_crime_count"


# ---------------------------------------------------------------- slots
def group_stats(slots: DataFrame, keys=(AREA, TYPE)) -> DataFrame:
    """Total and mean slot count per group; a group has at most 168 slots."""
    return slots.groupBy(*keys).agg(F.sum(COUNT).alias("group_total"), F.avg(COUNT).alias("avg_slot_count"))


def _with_group_stats(slots: DataFrame, keys) -> DataFrame:
    """The same two figures beside each slot: one window in place of a self join."""
    group = Window.partitionBy(*keys)
    return slots.withColumns(
        {"group_total": F.sum(COUNT).over(group), "avg_slot_count": F.avg(COUNT).over(group)}
    )


def _slot_percents() -> list[Column]:
    return [
        share_percent(F.col(COUNT), F.col("group_total")).alias("share_of_group_percent"),
        percent_deviation(F.col(COUNT), F.col("avg_slot_count")).alias(SLOT_RISK),
    ]


def risk_periods(slots: DataFrame, keys=(AREA, TYPE)) -> DataFrame:
    """Every slot of every group against the mean slot of its group."""
    scored = _with_group_stats(slots, keys).select(*keys, DOW, HOUR, COUNT, *_slot_percents())
    return scored.orderBy(F.desc(SLOT_RISK), *keys, DOW, HOUR)


def risk_periods_supported(
    slots: DataFrame,
    types: DataFrame,
    areas=N.VALID_AREAS,
    min_group: int = N.MIN_GROUP,
    min_slot: int = N.MIN_SLOT,
) -> DataFrame:
    """Slot risk of valid areas and top types, only with enough incidents behind it."""
    wanted = slots.where(F.col(AREA).isin(*areas)).join(types.select(TYPE), TYPE, "left_semi")
    scored = (
        _with_group_stats(wanted, [AREA, TYPE])
        .where((F.col("group_total") >= min_group) & (F.col(COUNT) >= min_slot))
        .select(AREA, TYPE, DOW, HOUR, COUNT, "group_total", *_slot_percents())
    )
    return scored.withColumn("risk_level", slot_band(F.col(SLOT_RISK))).orderBy(F.desc(SLOT_RISK), AREA, TYPE, DOW, HOUR)


# ---------------------------------------------------------------- areas
def area_risk_history(daily: DataFrame, latest: dt.date, keys=(AREA,)) -> DataFrame:
    """Last 30 days against 30 mean days of the whole history.

    The mean runs over the days that have incidents, and `latest` is the last
    day of the data even when it is incomplete. One aggregation gives both.
    """
    counts = roll_up_days(daily, keys)
    recent = F.col(DATE) > F.lit(latest - dt.timedelta(days=30))
    both = counts.groupBy(*keys).agg(
        F.sum(F.when(recent, F.col(COUNT))).alias(RECENT), (F.avg(COUNT) * 30).alias("expected")
    )
    return (
        both.where(F.col(RECENT).isNotNull())
        .select(
            *keys,
            RECENT,
            F.round("expected", 2).alias(EXPECTED),
            percent_deviation(F.col(RECENT), F.col("expected")).alias(HISTORY_RISK),
        )
        .orderBy(F.desc(HISTORY_RISK), *keys)
    )


def calendar_length(after: dt.date, upto: dt.date, start: dt.date) -> int:
    """Days in (after, upto] that a calendar beginning at `start` has."""
    return max(0, (upto - max(after, start - dt.timedelta(days=1))).days)


def _between(after: dt.date, upto: dt.date) -> Column:
    return (F.col(DATE) > F.lit(after)) & (F.col(DATE) <= F.lit(upto))


def _mean_month(total: Column, days: int) -> Column:
    """Thirty zero-filled mean days: empty days count in the divisor, so no dense panel is needed."""
    return F.coalesce(total, F.lit(0)) / F.lit(days) * 30


def area_risk_recent(daily: DataFrame, end: dt.date, start: dt.date, areas=N.VALID_AREAS) -> DataFrame:
    """Last 30 days against the 365 days before them, zero-filled, per valid area.

    The level is taken from the unrounded percentage.
    """
    recent_from, base_from = end - dt.timedelta(days=30), end - dt.timedelta(days=395)
    days = calendar_length(base_from, recent_from, start)
    sums = (
        daily.where(_between(base_from, end))
        .groupBy(AREA)
        .agg(
            F.sum(F.when(F.col(DATE) > F.lit(recent_from), F.col(COUNT))).alias(RECENT),
            F.sum(F.when(F.col(DATE) <= F.lit(recent_from), F.col(COUNT))).alias("base"),
        )
    )
    both = (
        key_list(daily.sparkSession, areas)
        .where(F.lit(days > 0))
        .join(sums, AREA, "left")
        .select(
            AREA,
            F.coalesce(RECENT, F.lit(0).cast("bigint")).alias(RECENT),
            _mean_month(F.col("base"), max(days, 1)).alias("expected"),
        )
    )
    raw = raw_deviation(F.col(RECENT), F.col("expected"))
    return both.select(
        AREA,
        RECENT,
        F.round("expected", 2).alias(EXPECTED),
        F.round(raw, 2).alias(AREA_RISK),
        band(raw).alias("risk_level"),
    ).orderBy(F.desc(AREA_RISK), AREA)


# ---------------------------------------------------------------- forecasts
def baseline_30(
    daily: DataFrame, keys, end: dt.date, start: dt.date, among: DataFrame | None = None, days: int = 365
) -> DataFrame:
    """Thirty zero-filled mean days of the `days` up to `end`, per key.

    Keys of `among` without any incident get a baseline of zero.
    """
    after = end - dt.timedelta(days=days)
    length = max(calendar_length(after, end, start), 1)
    sums = not_null(daily.where(_between(after, end)), keys).groupBy(*keys).agg(F.sum(COUNT).alias("total"))
    if among is not None:
        sums = among.select(*keys).join(sums, list(keys), "left")
    return sums.select(*keys, F.round(_mean_month(F.col("total"), length), 2).alias(EXPECTED))


def forecast_risk(totals: DataFrame, baseline: DataFrame, keys) -> DataFrame:
    """Predicted 30-day totals against their baseline; the level follows the rounded percentage."""
    percent = percent_deviation(F.col(TOTAL_30), F.col(EXPECTED), half_even=True)
    return (
        totals.join(baseline, list(keys), "left")
        .select(*keys, TOTAL_30, EXPECTED, percent.alias(AREA_RISK))
        .withColumn("risk_level", band(F.col(AREA_RISK)))
        .orderBy(F.desc(AREA_RISK), *keys)
    )


def map_points(risk: DataFrame, centers: DataFrame) -> DataFrame:
    """Area risk with the centre of each area, where one is known."""
    return risk.join(centers, AREA, "left")
