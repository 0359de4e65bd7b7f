"""Simple predictors, the iterative mean forecast, leaderboards and roll-ups."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tsrisk.names import AREA, COUNT, DATE, FORECAST_DAYS, PREDICTED, STEP, TEST_DAYS, TYPE
from tsrisk.operators.features import best_per_key, chrono_split, latest_date, rolling, series_arrays, with_lags
from tsrisk.operators.metrics import ACTUAL, error_metrics
from tsrisk.operators.risk import TOTAL_30

# --- fixed values: model names, by the column that holds their prediction --
BASELINES = {
    "pred_lag_1": "Naive Previous Day",
    "pred_lag_7": "Seasonal Naive Previous Week",
    "pred_rolling_7": "Rolling Mean 7 Days",
    "pred_rolling_30": "Rolling Mean 30 Days",
}
SHOWN_AS = {
    "pred_lag_1": "naive_previous_day_prediction",
    "pred_lag_7": "seasonal_previous_week_prediction",
    "pred_rolling_7": "rolling_mean_7_prediction",
    "pred_rolling_30": "rolling_mean_30_prediction",
}
ITERATIVE_MEAN = "Baseline Rolling 7-Day Iterative Forecast"


def baseline_predictions(df: DataFrame, keys=(), y: str = COUNT) -> DataFrame:
    """The four simple predictions beside each day; the first 30 days of a series fall away."""
    value = df.select(DATE, *keys, F.col(y).cast("double").alias(y))
    predicted = (
        with_lags(value, keys, y, (1, 7))
        .withColumnsRenamed({"lag_1": "pred_lag_1", "lag_7": "pred_lag_7"})
        .withColumns({f"pred_rolling_{n}": rolling(keys, y, n, full=True) for n in (7, 30)})
    )
    return predicted.dropna("any")


def _test_days(predictions: DataFrame, keys, days: int) -> DataFrame:
    return chrono_split(predictions, keys, days).where("is_test").drop("is_test")


def baseline_leaderboard(df: DataFrame, keys=(), y: str = COUNT, days: int = TEST_DAYS) -> DataFrame:
    """Errors of the four predictors over the last `days` days of each series, best first."""
    tested = _test_days(baseline_predictions(df, keys, y), keys, days)
    long = tested.withColumnRenamed(y, ACTUAL).unpivot([*keys, ACTUAL], list(BASELINES), "column", "value")
    names = F.create_map(*[F.lit(x) for pair in BASELINES.items() for x in pair])
    named = long.withColumn("model", F.element_at(names, F.col("column")))
    return error_metrics(named, ACTUAL, "value", by=[*keys, "model"]).orderBy(*keys, "mae", "model")


def best_model(leaderboard: DataFrame, keys=()) -> DataFrame:
    """The row with the smallest MAE, per key; ties go to the smaller name."""
    if not keys:
        return leaderboard.orderBy("mae", "model").limit(1)
    ranked = leaderboard.withColumn("_gain", -F.col("mae"))
    return best_per_key(ranked, keys, "_gain", ["model"]).drop("_gain")


def baseline_test_predictions(
    df: DataFrame, keys=(), y: str = COUNT, days: int = TEST_DAYS, leaderboard: DataFrame | None = None
) -> DataFrame:
    """Actual and predicted counts of the test days, with the best predictor's value."""
    best = best_model(leaderboard or baseline_leaderboard(df, keys, y, days), keys)
    best = best.select(*keys, F.col("model").alias("best_baseline_model"))
    tested = _test_days(baseline_predictions(df, keys, y), keys, days)
    if keys:
        joined = tested.join(best, list(keys))
    else:
        joined = tested.withColumn("best_baseline_model", best.scalar())
    chosen = reduce(
        lambda so_far, item: so_far.when(F.col("best_baseline_model") == item[1], F.col(item[0])), BASELINES.items(), F
    )
    return joined.select(
        DATE,
        *keys,
        F.col(y).alias(ACTUAL),
        *[F.col(c).alias(shown) for c, shown in SHOWN_AS.items()],
        "best_baseline_model",
        chosen.alias("best_baseline_prediction"),
    )


# ---------------------------------------------------------------- recursion
def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def last_n(values: Column, n: int) -> Column:
    """The last `n` items, or all when there are fewer."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def extend(history: Column, steps: int, next_value) -> Column:
    """Append `steps` values to an array, each computed from the array so far."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), history, lambda so_far, i: F.concat(
        so_far, F.array(next_value(so_far, i))
    ))


def mean_forecast_arrays(history: Column, window: int, steps: int) -> Column:
    """`history` followed by its iterative mean forecast."""

    def mean_of_last(so_far: Column, _step: Column) -> Column:
        recent = last_n(so_far, window)
        return F.greatest(F.lit(0.0), F.bround(array_sum(recent) / F.size(recent), 0))

    return extend(history, steps, mean_of_last)


def unroll(df: DataFrame, keys, values: Column, end: dt.date) -> DataFrame:
    """One row per key and forecast day from an array of forecasts."""
    return df.select(*keys, F.posexplode(values).alias("_pos", "_value")).select(
        F.date_add(F.lit(end), F.col("_pos") + 1).alias(DATE),
        (F.col("_pos") + 1).alias(STEP),
        *keys,
        F.col("_value").cast("bigint").alias(PREDICTED),
    )


def iterative_mean_forecast(
    df: DataFrame,
    keys=(),
    y: str = COUNT,
    window: int = 7,
    steps: int = FORECAST_DAYS,
    end: dt.date | None = None,
    model: str | None = ITERATIVE_MEAN,
) -> DataFrame:
    """Each day is the rounded mean of the last `window` known or predicted days.

    A series is one row with a short array; the recursion is an `aggregate`
    inside the JVM, the same plan for one series and for millions.
    """
    end = end or latest_date(df)
    tails = series_arrays(df, keys, y, last=window, end=end)
    ahead = F.slice(mean_forecast_arrays(F.col("history"), window, steps), F.size("history") + 1, steps)
    forecast = unroll(tails, keys, ahead, end)
    return forecast if model is None else forecast.withColumn("model", F.lit(model))


# ---------------------------------------------------------------- roll-ups
def forecast_rollup(detail: DataFrame, keys=()) -> DataFrame:
    """Forecast per day at a coarser level."""
    return detail.groupBy(DATE, STEP, *keys).agg(F.sum(PREDICTED).alias(PREDICTED))


def forecast_totals(detail: DataFrame, keys) -> DataFrame:
    return detail.groupBy(*keys).agg(F.sum(PREDICTED).alias(TOTAL_30))


def forecast_rollups(detail: DataFrame, model: str) -> dict[str, DataFrame]:
    """The area, type and city forecasts and the 30-day totals of one detail forecast."""
    city = forecast_rollup(detail).withColumn("model", F.lit(model))
    return {
        "district_30day": forecast_rollup(detail, [AREA]),
        "crime_type_30day": forecast_rollup(detail, [TYPE]),
        "citywide_30day": city,
        "citywide_7day": first_days(city, 7),
        "district_total": forecast_totals(detail, [AREA]),
        "crime_type_total": forecast_totals(detail, [TYPE]),
    }


def first_days(forecast: DataFrame, days: int) -> DataFrame:
    return forecast.where(F.col(STEP) <= days)


# ---------------------------------------------------------------- selection
def leaderboard(groups: dict[str, DataFrame], keys=()) -> DataFrame:
    """The best model of every group, best first; columns a group lacks are NULL."""
    best = [best_model(models, keys).withColumn("model_group", F.lit(name)) for name, models in groups.items()]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), best)
    return together.orderBy(*keys, "mae", "model_group")


def select_forecast(board: DataFrame, forecasts: dict[str, DataFrame]) -> DataFrame:
    """The forecast of the group that leads the board, with the board's model name."""
    every = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [f.withColumn("model_group", F.lit(name)) for name, f in forecasts.items()],
    )
    winner = board.orderBy("mae", "model_group").limit(1)
    named = winner.select("model_group", F.col("model").alias("selected_model"))
    return every.join(named, "model_group").orderBy(STEP)
