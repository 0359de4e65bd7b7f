"""Lags, rolling statistics, splits and category codes over dense series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tsrisk.names import AREA, COUNT, DATE, TEST_DAYS, TYPE
from tsrisk.session import stage

LAGS = (1, 7, 14, 30)
FEATURES = (
    "district",
    "primary_type_code",
    "day",
    "month",
    "year",
    "day_of_week",
    "week_of_year",
    "is_weekend",
    "lag_1",
    "lag_7",
    "lag_14",
    "lag_30",
    "rolling_mean_7",
    "rolling_mean_30",
    "rolling_std_7",
)


def _series(keys):
    return Window.partitionBy(*keys).orderBy(DATE)


def with_lags(df: DataFrame, keys, y: str = COUNT, lags=LAGS) -> DataFrame:
    series = _series(keys)
    return df.withColumns({f"lag_{n}": F.lag(y, n).over(series) for n in lags})


def rolling(keys, y: str, n: int, fn=F.avg, full: bool = False) -> Column:
    """`fn` over the `n` rows before the current one; with `full`, NULL until all `n` exist."""
    before = _series(keys).rowsBetween(-n, -1)
    value = fn(y).over(before)
    return F.when(F.count(y).over(before) == n, value) if full else value


def lag_features(panel: DataFrame, keys=(AREA, TYPE), y: str = COUNT) -> DataFrame:
    """Model features per series and day, without each series' first 30 days.

    All window expressions share one partitioning and order: one shuffle, one sort.
    """
    featured = with_lags(panel, keys, y).withColumns(
        {
            "rolling_mean_7": rolling(keys, y, 7),
            "rolling_mean_30": rolling(keys, y, 30),
            "rolling_std_7": rolling(keys, y, 7, F.stddev_samp),
        }
    )
    return featured.dropna(subset=["lag_30", "rolling_mean_30"])


def latest_date(df: DataFrame) -> dt.date:
    return df.agg(F.max(DATE)).first()[0]


def chrono_split(df: DataFrame, keys=(), days: int = TEST_DAYS, end: dt.date | None = None) -> DataFrame:
    """Add `is_test`: the last `days` days up to `end`, or of each series when `end` is not given.

    Without keys the last day is one scalar, never a window over the whole table.
    """
    if end is not None:
        last = F.lit(end)
    elif keys:
        last = F.max(DATE).over(Window.partitionBy(*keys))
    else:
        last = df.agg(F.max(DATE)).scalar()
    return df.withColumn("is_test", F.col(DATE) > F.date_sub(last, days))


def tail_rows(df: DataFrame, keys, n: int) -> DataFrame:
    """The last `n` rows of each series by date."""
    if not keys:
        return df.orderBy(F.desc(DATE)).limit(n)
    newest = Window.partitionBy(*keys).orderBy(F.desc(DATE))
    return df.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= n).drop("_age")


def best_per_key(df: DataFrame, keys, metric: str, ties=()) -> DataFrame:
    """The row with the highest `metric` per key; a NULL metric comes last."""
    best = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(metric), *ties)
    return df.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") == 1).drop("_rank")


def category_codes(df: DataFrame, col: str = TYPE) -> DataFrame:
    """Alphabetical codes 0..k-1 of the distinct labels (one row per label).

    Labels are dealt into ranges and numbered inside each; the driver gets one count for each range and
    hands back where each begins.
    """
    labels = df.select(col).dropna().distinct().repartitionByRange(col)
    labels = stage(labels.select(col, F.spark_partition_id().alias("_range")), "labels")
    sizes = dict(labels.groupBy("_range").count().collect())
    begins, total = [], 0
    for part in range(max(sizes, default=0) + 1):
        begins.append(F.lit(total))
        total += sizes.get(part, 0)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(col))
    begin = F.element_at(F.array(*begins), F.col("_range") + 1)
    return labels.select(col, (begin + inside - 1).cast("int").alias(f"{col}_code"))


def encode_category(df: DataFrame, col: str = TYPE) -> DataFrame:
    return df.join(category_codes(df, col), col)


def series_arrays(df: DataFrame, keys, y: str = COUNT, last: int | None = None, end: dt.date | None = None) -> DataFrame:
    """One row per dense series: `history`, its values in date order.

    With `last` only the newest days are read, by a date filter that reaches the
    scan; an array is never longer than the calendar.
    """
    if last is not None:
        end = end or latest_date(df)
        df = df.where(F.col(DATE) > F.lit(end - dt.timedelta(days=last)))
    pairs = F.array_sort(F.collect_list(F.struct(DATE, F.col(y).cast("double").alias("y"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["y"]).alias("history"))
