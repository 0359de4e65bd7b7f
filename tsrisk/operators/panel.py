"""Gap-free calendars and panels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tsrisk.functions.dates import DATE_PARTS, with_date_parts
from tsrisk.names import AREA, COUNT, DATE, STEP


def _days(start: dt.date, end: dt.date):
    return F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))


def calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """Every day from `start` to `end`, both included."""
    return spark.range(1).select(F.explode(_days(start, end)).alias(DATE))


def future_calendar(spark: SparkSession, last: dt.date, n: int) -> DataFrame:
    """The `n` days after `last` with their step number 1..n."""
    return spark.range(1, n + 1).select(
        F.date_add(F.lit(last), F.col("id").cast("int")).alias(DATE), F.col("id").cast("int").alias(STEP)
    )


def key_list(spark: SparkSession, values, name: str = AREA) -> DataFrame:
    """A short literal key list as a one-column table."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))


def rolling_median(daily: DataFrame, rows: int = 30) -> DataFrame:
    """City-level counts with `typical`, the median of the `rows` days before.

    There is one row per day, so the unpartitioned window stays as small as the
    calendar.
    """
    before = Window.orderBy(DATE).rowsBetween(-rows, -1)
    return daily.select(DATE, COUNT, F.percentile(COUNT, F.lit(0.5)).over(before).alias("typical"))


def _trusted_days(daily: DataFrame, fraction: float, rows: int) -> DataFrame:
    """Flag the days whose count reaches `fraction` of the median before them."""
    return rolling_median(daily, rows).select(DATE, (F.col(COUNT) >= F.col("typical") * fraction).alias("trusted"))


def _last_trusted():
    return F.max(F.when(F.col("trusted"), F.col(DATE))).alias("training_end_date")


def safe_end_date(daily: DataFrame, fraction: float = 0.5, rows: int = 30) -> DataFrame:
    """The last day that does not look incomplete, as one row."""
    return _trusted_days(daily, fraction, rows).agg(_last_trusted())


def calendar_bounds(daily: DataFrame, fraction: float = 0.5, rows: int = 30) -> tuple[dt.date, dt.date]:
    """First day and safe end day of a (staged) city count table, as two scalars.

    They are fetched once so that later date filters are literals that reach the scan.
    """
    row = _trusted_days(daily, fraction, rows).agg(F.min(DATE), _last_trusted()).first()
    return row[0], row[1]


def panel(daily: DataFrame, end: dt.date, start: dt.date, keys: DataFrame | None = None, extra=None) -> DataFrame:
    """One row per key and day from `start` to `end`, zero where nothing was counted.

    `keys` holds the key columns; `extra` maps one more key column to a short
    literal list. The grid comes from exploding the calendar beside the keys,
    spread by key first, so it is neither a join nor a single task.
    """
    spark = daily.sparkSession
    grid = spark.range(1).select() if keys is None else keys
    for name, values in (extra or {}).items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    columns = grid.columns
    if columns:
        grid = grid.repartition(*columns)
    grid = grid.select("*", F.explode(_days(start, end)).alias(DATE))
    counts = daily.where(F.col(DATE).between(F.lit(start), F.lit(end)))
    dense = grid.join(counts, [DATE, *columns], "left").select(
        DATE, *columns, F.coalesce(COUNT, F.lit(0).cast("bigint")).alias(COUNT)
    )
    return with_date_parts(dense, DATE, DATE_PARTS)


def series_rows(daily: DataFrame, end: dt.date, start: dt.date, keys: DataFrame, extra=None) -> DataFrame:
    """The days of each key that have counts, and its first day, in one exchange; see `panel` for the arguments."""
    wanted = keys
    for name, values in (extra or {}).items():
        wanted = wanted.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    names = wanted.columns
    counted = daily.where(F.col(DATE).between(F.lit(start), F.lit(end))).join(wanted, names, "left_semi")
    first = wanted.select(F.lit(start).alias(DATE), *names, F.lit(0).cast("bigint").alias(COUNT))
    rows = counted.select(DATE, *names, COUNT).unionByName(first).repartition(*names).groupBy(*names, DATE)
    return rows.agg(F.sum(COUNT).alias(COUNT))


def fill_days(rows: DataFrame, end: dt.date, names) -> DataFrame:
    """The days up to each row's next one, or up to `end`, with a count of zero.

    They are made where the row stands, so a table stored in buckets of the key needs no exchange.
    """
    following = F.lead(DATE).over(Window.partitionBy(*names).orderBy(DATE))
    until = F.coalesce(F.date_sub(following, 1), F.lit(end))
    gaps = rows.withColumn("_last", until).withColumnRenamed(DATE, "_counted")
    days = gaps.select("*", F.explode(F.sequence("_counted", "_last")).alias(DATE))
    value = F.when(F.col(DATE) == F.col("_counted"), F.col(COUNT)).otherwise(F.lit(0).cast("bigint"))
    return with_date_parts(days.select(DATE, *names, value.alias(COUNT)), DATE, DATE_PARTS)


def sparse_panel(daily: DataFrame, end: dt.date, start: dt.date, keys: DataFrame, extra=None) -> DataFrame:
    """The rows of `panel`, with only the days that have counts shuffled.

    Each key gets its own rows and one for the first day in one exchange; the days up to its next row are made
    there, so windows over the series find them in place. A key has at most one row a day, which bounds its task.
    """
    return fill_days(series_rows(daily, end, start, keys, extra), end, [*keys.columns, *(extra or {})])


def stored_panel(spark: SparkSession, table: str, end: dt.date, names) -> DataFrame:
    """The rows of `panel` from `series_rows` that `tables.save_buckets` keeps under a name.

    Windows, groups and joins over all of `names`, in this order, find each series in one task as it is read.
    """
    return fill_days(spark.table(table).where(F.col(DATE) <= F.lit(end)), end, names)
