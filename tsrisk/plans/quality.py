"""Data-quality report over the incident table and its count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tsrisk.names import AREA, COUNT, DATE, DAY, TYPE
from tsrisk.operators.counts import date_range, null_profile, roll_up_days, table_counts, top_keys, yearly_totals
from tsrisk.operators.features import tail_rows
from tsrisk.operators.risk import SLOT_RISK

CHECKED = (DAY, AREA, TYPE, "latitude", "longitude")


def quality_report(
    incidents: DataFrame,
    cube: DataFrame,
    periods: DataFrame,
    area_history: DataFrame,
    tables: dict[str, DataFrame | None],
) -> dict[str, DataFrame]:
    """The sections of the report by name.

    Only the missing-value counts read the incidents; the rest comes from the count cube.
    """
    first_columns = [AREA, TYPE, "day_of_week", "hour", COUNT, "share_of_group_percent", SLOT_RISK]
    return {
        "row_counts": table_counts(tables),
        "date_range": date_range(cube),
        "missing_values": null_profile(incidents, CHECKED),
        "top_types": top_keys(cube, TYPE, 15),
        "top_areas": top_keys(cube, AREA, 25),
        "latest_days": latest_days(roll_up_days(cube)),
        "yearly_totals": yearly_totals(cube),
        "top_periods": periods.select(*first_columns).orderBy(F.desc(SLOT_RISK), *first_columns[:4]).limit(20),
        "area_risk": area_history,
    }


def latest_days(city_daily: DataFrame, n: int = 15) -> DataFrame:
    return tail_rows(city_daily.select(DATE, COUNT), (), n)
