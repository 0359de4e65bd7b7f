"""Counting incidents. Every count is partially aggregated before its shuffle,
so one hot key costs one row per task and group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tsrisk.functions.dates import date_part
from tsrisk.functions.scoring import not_null
from tsrisk.names import AREA, COUNT, DATE, DAY, DOW, HOUR, TYPE


def _tally(weight: str | None) -> Column:
    """Rows, or the sum of a count column when the input is already a count table."""
    return (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias(COUNT)


def incident_cube(df: DataFrame, dims=(AREA, TYPE, HOUR)) -> DataFrame:
    """Counts per day and `dims`, NULL keys kept.

    One pass over the fact table from which every coarser count follows by
    `roll_up`; stage it when more than one result is needed.
    """
    return df.groupBy(F.col(DAY).alias(DATE), *dims).agg(_tally(None))


def roll_up(counts: DataFrame, keys) -> DataFrame:
    """Sum a finer count table to `keys`, leaving out rows with a missing key."""
    return not_null(counts, keys).groupBy(*keys).agg(_tally(COUNT))


def daily_counts(df: DataFrame, keys=()) -> DataFrame:
    """Incidents per day and `keys`; rows without a key are left out."""
    return roll_up_days(not_null(df, [DAY, *keys]).withColumnRenamed(DAY, DATE), keys, None)


def roll_up_days(counts: DataFrame, keys=(), weight: str | None = COUNT) -> DataFrame:
    return not_null(counts, [DATE, *keys]).groupBy(DATE, *keys).agg(_tally(weight))


def slot_counts(df: DataFrame, keys=(AREA, TYPE)) -> DataFrame:
    """Incidents per key group, weekday and hour, from incidents or from a cube."""
    weight = COUNT if COUNT in df.columns else None
    if DOW not in df.columns:
        df = df.withColumn(DOW, date_part(DOW, F.col(DATE)))
    slots = [*keys, DOW, HOUR]
    return not_null(df, slots).groupBy(*slots).agg(_tally(weight))


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The `n` most frequent keys; ties go to the smaller key."""
    weight = COUNT if COUNT in df.columns else None
    totals = not_null(df, [key]).groupBy(key).agg(_tally(weight))
    return totals.orderBy(F.desc(COUNT), key).limit(n)


def yearly_totals(df: DataFrame) -> DataFrame:
    """Incidents per year, from incidents or from a count table."""
    if COUNT in df.columns:
        per_year = df.groupBy(date_part("year", F.col(DATE)).alias("year")).agg(_tally(COUNT))
    else:
        per_year = df.groupBy("year").agg(_tally(None))
    return not_null(per_year, ["year"]).orderBy("year")


def date_range(df: DataFrame) -> DataFrame:
    """First day, last day, distinct days and incidents, from incidents or from a count table."""
    day, weight = (DATE, COUNT) if COUNT in df.columns else (DAY, None)
    per_day = df.groupBy(day).agg(_tally(weight))
    return per_day.agg(
        F.min(day).alias("min_date"),
        F.max(day).alias("max_date"),
        F.count(day).alias("unique_days"),
        F.coalesce(F.sum(COUNT), F.lit(0)).alias("total_records"),
    )


def key_combinations(df: DataFrame, keys=(AREA, TYPE)) -> DataFrame:
    """The key combinations that occur."""
    return not_null(df, keys).select(*keys).distinct()


def key_cardinality(df: DataFrame, keys=(AREA, TYPE)) -> DataFrame:
    """Distinct values of each key, as one row; the keys are reduced to their combinations first."""
    seen = df.select(*keys).distinct()
    return seen.agg(*[F.count_distinct(F.col(k)).alias(f"distinct_{k}") for k in keys])


def null_profile(df: DataFrame, columns) -> DataFrame:
    """Row count and missing values per column, as one row."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns]
    return df.agg(F.count(F.lit(1)).alias("total_rows"), *missing)


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Rows per named table; a table given as None is reported with a NULL count."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    parts = []
    for name, table in tables.items():
        if table is None:
            counted = spark.range(1).select(F.lit(None).cast("bigint").alias("row_count"))
        else:
            counted = table.agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(counted.select(F.lit(name).alias("table_name"), "row_count"))
    return reduce(DataFrame.unionByName, parts)
