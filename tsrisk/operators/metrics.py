"""Forecast errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tsrisk.names import AREA, DATE, PREDICTED, TYPE

ACTUAL = "actual_crime_count"


def error_metrics(
    df: DataFrame, actual: str, predicted: str, by=(), digits=(2, 2, 2, 4), exact: str | None = None
) -> DataFrame:
    """MAE, RMSE, MAPE (zero actuals left out) and R² in one aggregation, rounded half to even.

    `exact` names a further column with the MAE as it is, for ranking.
    """
    y = F.col(actual).cast("double")
    miss = y - F.col(predicted)
    total = F.var_pop(y) * F.count(y)
    scores = {
        "mae": F.avg(F.abs(miss)),
        "rmse": F.sqrt(F.avg(miss * miss)),
        "mape": F.avg(F.when(y != 0, F.abs(miss / F.nullif(y, F.lit(0.0))))) * 100,
        "r2": 1 - F.try_divide(F.sum(miss * miss), total),
    }
    shown = [F.bround(c, d).alias(name) for (name, c), d in zip(scores.items(), digits)]
    return df.groupBy(*by).agg(*shown, *([scores["mae"].alias(exact)] if exact else []))


def evaluate_levels(predictions: DataFrame, label: str) -> DataFrame:
    """Errors per row, per area and day, and per type and day, from rows of actual and predicted counts.

    The two daily levels add up predictions that are already rounded to two digits.
    """
    clipped = predictions.withColumn(PREDICTED, F.greatest(F.lit(0.0), F.col(PREDICTED)))
    shown = clipped.withColumn(PREDICTED, F.bround(PREDICTED, 2))
    four = (4, 4, 4, 4)

    def level(rows: DataFrame, model: str, name: str) -> DataFrame:
        scored = error_metrics(rows, ACTUAL, PREDICTED, digits=four)
        return scored.select(F.lit(model).alias("model"), F.lit(name).alias("prediction_level"), "*")

    def per_day(key: str) -> DataFrame:
        return shown.groupBy(DATE, key).agg(F.sum(ACTUAL).alias(ACTUAL), F.sum(PREDICTED).alias(PREDICTED))

    parts = [
        level(clipped, f"{label} District + Crime Type", "district_crime_type_daily"),
        level(per_day(AREA), f"{label} District Forecast", "district_daily"),
        level(per_day(TYPE), f"{label} Crime Type Forecast", "crime_type_daily"),
    ]
    return reduce(DataFrame.unionByName, parts)
