"""The driver's tables read as the records that the operators work on.

Leaves: an order is a leave of its customer, from the order date for one to fifteen days, of the priority's kind.
Versions: a customer's orders are dated versions of a setting (the last order of a day counts).
Day facts: events by day. The same readings in SQL are LEAVES and VERSIONS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAVES = "leaves AS (SELECT o_orderkey AS id, o_custkey AS person, o_orderpriority AS kind, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 AS INTEGER) AS e FROM orders)"
VERSIONS = "versions AS (SELECT o_custkey AS person, CAST(o_orderdate AS DATE) AS since, arg_max(o_orderpriority, o_orderkey) AS setting FROM orders GROUP BY 1, 2)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("kind"), day.alias("s"), F.date_add(day, (F.col("o_orderkey") % 15).cast("int")).alias("e")
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person"), F.col("o_orderdate").cast("date").alias("since")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("setting"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", "ts", F.col("ts").cast("date").alias("day"), F.col("user_id").alias("person"), F.col("event_type").alias("kind"), "value")
