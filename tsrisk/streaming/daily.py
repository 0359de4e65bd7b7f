"""Daily counts kept up to date from a stream of incidents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tsrisk.functions.scoring import not_null
from tsrisk.names import COUNT, DATE, TIME
from tsrisk.session import new_path


def daily_counts_stream(incidents: DataFrame, keys=(), late: str = "2 days") -> DataFrame:
    """`daily_counts` over a stream; a day is final once the watermark has passed it."""
    # The watermark needs a zoned time; days are grouped by the zone-free date, read as one at midnight UTC.
    day = F.to_timestamp(F.concat(F.date_format(F.col(TIME).cast("date"), "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    timed = not_null(incidents, [TIME, *keys]).withColumn("at", day)
    counted = timed.withWatermark("at", late).groupBy("at", *keys).agg(F.count(F.lit(1)).alias(COUNT))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_timestamp("at") / 86_400).cast("int"))
    return counted.select(date.alias(DATE), *keys, COUNT)


def write_daily_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append final days as Parquet until the input is used up."""
    writer = counts.writeStream.outputMode("append").trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).queryName(f"daily-{uuid.uuid4().hex}").start(
        path, format="parquet"
    )


def upsert_daily_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep every day at its count so far, open days and days with late rows included, until the input is used up.

    A batch brings the new totals of the groups it changed. The months they touch are written anew with the groups
    that it left alone, and only those months; a batch that is tried again writes the same totals. `path` is
    a table partitioned by `month`, as days hold too few rows for files of their own.
    """
    keys = [c for c in counts.columns if c != COUNT]
    columns = ", ".join(f"{name} {kind}" for name, kind in [*counts.dtypes, ("month", "string")])

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        merged = new_path(spark, "days")
        batch.withColumn("month", F.date_format(DATE, "yyyy-MM")).write.parquet(f"{merged}/fresh")
        fresh = spark.read.schema(columns).parquet(f"{merged}/fresh")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(spark._jsc.hadoopConfiguration())
        rows = fresh
        if system.exists(target):
            held = spark.read.schema(columns).parquet(path).join(fresh.select("month").distinct(), "month", "left_semi")
            rows = fresh.unionByName(held.join(fresh, keys, "left_anti"))
        # The old months are read before they are replaced.
        rows.write.parquet(f"{merged}/whole")
        whole = spark.read.schema(columns).parquet(f"{merged}/whole").repartition("month")
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(merged)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    writer = counts.writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(merge)
    return writer.option("checkpointLocation", checkpoint).queryName(f"days-{uuid.uuid4().hex}").start()
