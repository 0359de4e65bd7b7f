"""Incident views over the sample star schema.

An incident has a time, an area, a type and two coordinates. The dimension side
is left to Catalyst: it is broadcast only when its files are below the
broadcast threshold; otherwise it is a sort-merge join whose hot keys adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tsrisk.functions.dates import with_date_parts
from tsrisk.names import AREA, DAY, TIME, TYPE


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _incidents(df: DataFrame, time: str, area: Column, kind: str, latitude: str, longitude: str) -> DataFrame:
    named = df.select(
        F.col(time).alias(TIME),
        F.col(time).cast("date").alias(DAY),
        area.cast("int").alias(AREA),
        F.col(kind).alias(TYPE),
        F.col(latitude).alias("latitude"),
        F.col(longitude).alias("longitude"),
    )
    return with_date_parts(named, TIME, ("hour", "day_of_week", "year"))


def incidents_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = read_table(spark, folder, "orders"), read_table(spark, folder, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return _incidents(
        joined, "o_orderdate", F.col("c_nationkey") + 1, "o_orderpriority", "o_totalprice", "c_acctbal"
    )


def incidents_events(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    return _incidents(events, "ts", F.col("user_id") % 25 + 1, "event_type", "value", "value")


def incidents_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    lines, supplier = read_table(spark, folder, "lineitem"), read_table(spark, folder, "supplier")
    joined = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)
    return _incidents(joined, "l_shipdate", F.col("s_nationkey") + 1, "l_returnflag", "l_extendedprice", "s_acctbal")
