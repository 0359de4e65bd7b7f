"""Median centre per area, exact and without gathering an area in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tsrisk import names as N
from tsrisk.functions.scoring import not_null
from tsrisk.names import AREA
from tsrisk.session import stage

# Powers of two, so that fine buckets nest in coarse ones without rounding.
_COARSE = 1024
_FINE = 4096


def _holding(histogram: DataFrame, group, bucket: str, before: Column) -> DataFrame:
    """The buckets in which the middle ranks fall, with the number of values before each."""
    running = F.sum("w").over(Window.partitionBy(*group).orderBy(bucket))
    first = before + running - F.col("w")
    ranks = histogram.withColumn("first", first)
    return ranks.where((F.col("first") + F.col("w") >= F.col("lower")) & (F.col("first") < F.col("upper")))


def exact_medians(df: DataFrame, keys, value: str, position: Column | None = None) -> DataFrame:
    """Exact median of `value` per key group, of any size and skew.

    `position` maps the value, without ever decreasing, to 0..1. By default the
    buckets lie between two approximate quantiles on either side of the middle,
    and all that is below or above has a bucket of its own, so outliers move
    nothing.

    1. A histogram per group, counted before its shuffle, tells which of 1024
       coarse buckets hold the two middle ranks.
    2. Only rows of those buckets go on, as one count per distinct value.
    3. Their fine histogram picks one of 4096 parts, and only the values of
       that part are put in order.

    No task sees a group as a whole; the built-in exact `median` would hold
    every distinct value of a group in one task's memory.
    """
    keys = list(keys)
    rows = not_null(df, [*keys, value])
    if position is None:
        # One row per group; staged, so that the join broadcasts it only by its true size.
        near = F.percentile_approx(value, [0.49, 0.51], 10_000)
        ends = rows.groupBy(*keys).agg(near.alias("_near")).select(
            *keys, F.col("_near")[0].alias("_low"), F.col("_near")[1].alias("_high")
        )
        rows = rows.join(stage(ends, "median-ends"), keys)
        between = F.coalesce(F.try_divide(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.5))
        position = (
            F.when(F.col(value) < F.col("_low"), 0.0)
            .when(F.col(value) > F.col("_high"), 1.0)
            .otherwise((1 + between * (_COARSE - 2)) / _COARSE)
        )
    last = float(_COARSE * _FINE - 1)
    fine = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(last), position * (_COARSE * _FINE)))).cast("int")
    rows = rows.select(*keys, F.col(value).alias("v"), fine.alias("fine"))
    rows = rows.withColumn("coarse", F.shiftright("fine", 12))

    histogram = rows.groupBy(*keys, "coarse").agg(F.count(F.lit(1)).alias("w"))
    n = F.sum("w").over(Window.partitionBy(*keys))
    histogram = histogram.withColumns({"lower": F.floor((n + 1) / 2), "upper": F.floor((n + 2) / 2)})
    holding = _holding(histogram, keys, "coarse", F.lit(0))
    holding = stage(holding.select(*keys, "coarse", "lower", "upper", F.col("first").alias("before")), "median-buckets")

    part = [*keys, "coarse", "lower", "upper", "before"]
    band = rows.join(holding, [*keys, "coarse"]).groupBy(*part, "fine", "v").agg(F.count(F.lit(1)).alias("w"))
    band = stage(band, "median-band")
    parts = band.groupBy(*part, "fine").agg(F.sum("w").alias("w"))
    chosen = _holding(parts, [*keys, "coarse"], "fine", F.col("before")).select(*keys, "coarse", "fine", "first")
    in_order = Window.partitionBy(*keys, "coarse", "fine").orderBy("v")
    ranked = band.join(chosen, [*keys, "coarse", "fine"]).withColumn("upto", F.col("first") + F.sum("w").over(in_order))
    low = F.min(F.when(F.col("upto") >= F.col("lower"), F.col("v")))
    high = F.min(F.when(F.col("upto") >= F.col("upper"), F.col("v")))
    return ranked.groupBy(*keys).agg(((low + high) / 2).alias(value))


def centroids(
    df: DataFrame,
    key: str = AREA,
    latitude: str = "latitude",
    longitude: str = "longitude",
    latitude_box=N.LATITUDE_BOX,
    longitude_box=N.LONGITUDE_BOX,
) -> DataFrame:
    """Median latitude and longitude per area over the incidents inside the box."""
    boxed = df.where(F.col(latitude).between(*latitude_box) & F.col(longitude).between(*longitude_box))
    both = not_null(boxed, [key]).unpivot(key, [latitude, longitude], "axis", "value")

    def place(box):
        return (F.col("value") - box[0]) / float(box[1] - box[0])

    position = F.when(F.col("axis") == latitude, place(latitude_box)).otherwise(place(longitude_box))
    centre = exact_medians(both, [key, "axis"], "value", position)
    return centre.groupBy(key).agg(
        F.max(F.when(F.col("axis") == latitude, F.col("value"))).alias(latitude),
        F.max(F.when(F.col("axis") == longitude, F.col("value"))).alias(longitude),
    )
