"""Logs: append-only JSON lines, rotated audit files, multi-line text records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AUDIT = "ts string, event string, user_id string, username string, role string, detail string, status string"
#: Levels in rising order.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def read_audit(spark: SparkSession, *paths: str) -> DataFrame:
    """Audit events of all files, malformed lines left out, with a stable id and defaults."""
    lines = spark.read.text(list(paths)).where("length(trim(value)) > 0")
    parsed = lines.select("value", F.from_json("value", AUDIT, {"mode": "PERMISSIVE"}).alias("e")).where("e.ts IS NOT NULL")
    text = lambda c, d: F.coalesce(F.col(f"e.{c}"), F.lit(d)).alias(c)
    return parsed.select(F.substring(F.sha2("value", 256), 1, 16).alias("id"), "e.ts", text("event", ""), text("user_id", ""), text("username", ""), text("role", ""), text("detail", ""), text("status", "ok"))


def tail(log: DataFrame, position: str, n: int) -> DataFrame:
    """The last n entries of a log."""
    return log.orderBy(F.desc(position)).limit(n)


def recent(log: DataFrame, position: str = "pos", limit: int = 200, **filters: object) -> DataFrame:
    """Newest entries first; filters by equality, and from_day/to_day by range; those that are None do not count."""
    for name, value in filters.items():
        if value is None:
            continue
        if name == "from_day":
            log = log.where(F.col("day") >= F.lit(value))
        elif name == "to_day":
            log = log.where(F.col("day") <= F.lit(value))
        else:
            log = log.where(F.col(name) == F.lit(value))
    return log.orderBy(F.desc(position)).limit(limit)


def append_once(rows: DataFrame, path: str, batch_id: str) -> bool:
    """Appends rows as one batch; a batch that is there already is not written again."""
    spark = rows.sparkSession
    target = f"{path}/batch={batch_id}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return False
    rows.write.mode("overwrite").json(target)  # what a failed attempt has left is replaced
    return True


def assemble(lines: DataFrame, source: str, position: str, value: str, starts: Column) -> DataFrame:
    """(source, position, text): records of a log in which a record is a line that starts one and those that follow."""
    w = Window.partitionBy(source).orderBy(position)
    record = F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.withColumn("_record", record)
    joined = numbered.groupBy(source, "_record").agg(F.min(position).alias(position), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(position, value))), lambda x: x[value]), "\n").alias("text"))
    return joined.where("_record > 0").drop("_record")


def at_least(records: DataFrame, level: Column, floor: str) -> DataFrame:
    """Records whose level is at or above a floor; unknown levels count as the lowest."""
    order = F.array(*map(F.lit, LEVELS))
    return records.where(F.greatest(F.array_position(order, level), F.lit(1)) >= LEVELS.index(floor) + 1)
