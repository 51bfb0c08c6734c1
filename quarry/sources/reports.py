"""Sinks of reports: a title, columns and rows as files that other programs read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: Sequence[tuple[str, str]]) -> None:
    """Writes columns (name, heading) with headings, as many files as df has partitions."""
    df.select(*[F.col(name).alias(heading) for name, heading in columns]).write.mode("overwrite").option("header", "true").csv(path)


def write_by_day(df: DataFrame, path: str) -> None:
    """One folder for each day; days that df does not name keep theirs."""
    df.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").option("header", "true").csv(path)
