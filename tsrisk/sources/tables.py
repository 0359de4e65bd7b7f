"""Stored tables, published outputs and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tsrisk.names import OUTPUT_SCHEMAS, SUMMARY_SCHEMA


# ---------------------------------------------------------------- reads
def table_or(spark: SparkSession, *names: str) -> DataFrame:
    """The first of the named tables that exists."""
    for name in names:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    raise LookupError(f"none of the tables exists: {', '.join(names)}")


def register(df: DataFrame, name: str) -> DataFrame:
    """Make `df` readable by name in SQL."""
    df.createOrReplaceTempView(name)
    return df


def read_output(spark: SparkSession, folder: str, name: str, fmt: str = "csv") -> DataFrame:
    """A published output with its declared schema."""
    path = f"{folder}/{name}"
    reader = spark.read.schema(OUTPUT_SCHEMAS[name])
    return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).json(path, multiLine=True)


# ---------------------------------------------------------------- sinks
def save_table(df: DataFrame, name: str) -> DataFrame:
    """Replace the named table and return the stored one."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def save_buckets(df: DataFrame, name: str, keys, order=(), buckets: int | None = None) -> DataFrame:
    """Replace the named table by one in buckets of `keys`, one sorted file each, and return the stored one.

    Steps that group, join or open windows by the keys read a bucket a task and shuffle nothing. The number of
    buckets is that of the session's shuffle partitions unless it is given; a key has one bucket, so this is for
    rows whose keys are bounded, such as a series with a row a day.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
    rows.bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(name)
    return spark.table(name)


def sort_for_storage(df: DataFrame, keys) -> DataFrame:
    """Files that hold disjoint, sorted key ranges, for skipping at read."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def export_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write and read back, so later steps start from the files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for presentation tables, whose size is bounded."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str) -> None:
    """A one-row table as one nested JSON document."""
    document = F.to_json(F.struct("*"), {"pretty": "true"})
    df.select(document.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_model(model, meta: dict, folder: str, spark: SparkSession) -> None:
    """A fitted Spark ML model beside its metadata document."""
    model.write().overwrite().save(f"{folder}/model")
    document = spark.range(1).select(F.lit(json.dumps(meta, indent=4)).alias("value"))
    document.coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def read_model_metadata(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/metadata", wholetext=True).first()[0])
