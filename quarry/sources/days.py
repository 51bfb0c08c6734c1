"""Tables partitioned by day: scoped reads, changed-partition writes, an index of days."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALL_DAYS = object()


def read_days(spark: SparkSession, path: str, days: object) -> DataFrame:
    """The table at path, of the given days only: a list of dates, a function of the day column, or ALL_DAYS.

    The condition is on the partition column, so other days' files are not listed for reading.
    """
    df = spark.read.parquet(path)
    if days is ALL_DAYS:
        return df
    if callable(days):
        return df.where(days(F.col("day")))
    if days is None or isinstance(days, str):
        raise TypeError("days must be a list of dates, a function or ALL_DAYS")
    return df.where(F.col("day").isin(list(days)))


def write_changed(new: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Replaces the partitions of those days whose rows differ from what is stored; returns how many there were.

    Days that new does not name stay. Only the changed days' rows are written again.
    """
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        new.repartition("day").write.partitionBy("day").parquet(path)
        return new.select("day").distinct().count()
    rest = [c for c in new.columns if c != "day"]
    digest = lambda df, n: df.groupBy("day").agg(F.sum(F.xxhash64(*rest).cast("decimal(38,0)")).alias(f"h{n}"), F.count("*").alias(f"n{n}"))
    named = digest(new, 1).join(digest(old.select(*new.columns), 0), "day", "left")
    changed = named.where("n0 IS NULL OR n0 <> n1 OR NOT h0 <=> h1").select("day")
    days = [r["day"] for r in changed.collect()]  # one row for each changed day
    if days:
        rows = new.where(F.col("day").isin(days)).repartition("day").sortWithinPartitions("day", *keys)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return len(days)


def day_index(df: DataFrame, section: str, people: str) -> DataFrame:
    """(day, sections, people): what each day holds, for choosing days before reading them."""
    return df.groupBy("day").agg(F.sort_array(F.collect_set(section)).alias("sections"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(people)))).alias("people"))


def split_document(rows: DataFrame, day: str, core: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(core rows, rows by day): what a function of the day column tells apart; merge_document() is the inverse."""
    is_core = core(F.col(day))
    return rows.where(is_core), rows.where(~is_core)


def merge_document(core: DataFrame, days: DataFrame) -> DataFrame:
    return core.unionByName(days)
