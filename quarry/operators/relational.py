"""Joins and groupings that reports are made of."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import written


def on_domain(domain: DataFrame, rows: DataFrame, keys: Sequence[str], defaults: dict) -> DataFrame:
    """Every row of the domain, with what rows have for it or else the defaults."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    return domain.join(rows, list(keys), "left").withColumns(filled)


def after_prefix(rows: DataFrame, targets: DataFrame, text: str, name: str, prefix: str) -> DataFrame:
    """rows whose text begins with prefix, joined to the targets by the rest: an equi-join, not a cross product."""
    rest = F.substring(F.col(text), len(prefix) + 1, 1 << 30)
    return rows.where(F.col(text).startswith(prefix)).withColumn("_rest", rest).join(targets, F.col("_rest") == F.col(name)).drop("_rest")


def with_children(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Parents with an array of their children in order, empty where there are none."""
    rest = [c for c in children.columns if c not in (key, *order)]
    nested = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))
    joined = parents.join(nested, key, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.expr("array()").cast(nested.schema[name].dataType)))


def resolve_ids(rows: DataFrame, dimension: DataFrame, key: str, ids: str, id_name: str, value: str, missing: str) -> DataFrame:
    """(key, value): the array of ids as an array of the dimension's values, in order, missing ones replaced."""
    flat = rows.select(key, F.posexplode_outer(ids).alias("_pos", "_id"))
    told = flat.join(dimension.select(F.col(id_name).alias("_id"), value), "_id", "left").withColumn(value, F.coalesce(value, F.lit(missing)))
    listed = F.sort_array(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", value))))
    return told.groupBy(key).agg(F.transform(listed, lambda x: x[value]).alias(value))


def dangling(references: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(target, id, uses) of references (name, uses of ids, known ids) to ids that are not known; pre-aggregated."""
    parts = [uses.groupBy("id").agg(F.count("*").alias("uses")).join(known, "id", "left_anti").select(F.lit(name).alias("target"), "id", "uses") for name, uses, known in references]
    return reduce(DataFrame.unionByName, parts)


def overlapping_sets(rows: DataFrame, by: Sequence[str], key: str, members: str) -> DataFrame:
    """(by, a_key, b_key), a_key < b_key, of rows equal in `by` that share a member: joined on the shared member."""
    flat = rows.select(*by, F.col(key).alias("a_key"), F.explode(members).alias("_m"))
    other = flat.withColumnRenamed("a_key", "b_key")
    return flat.join(other, [*by, "_m"]).where("a_key < b_key").select(*by, "a_key", "b_key").distinct()


def links_of_sets(rows: DataFrame, by: Sequence[str], key: str, members: str) -> DataFrame:
    """(a, b), a < b: for rows equal in `by` the least row of each member with every other one of it.

    They connect the same rows as all pairs that share a member do, and are no more than the members.
    """
    flat = rows.select(*by, F.col(key).alias("b"), F.explode(members).alias("_m"))
    first = flat.groupBy(*by, "_m").agg(F.min("b").alias("a"))
    return flat.join(first, [*by, "_m"]).where("a < b").select("a", "b").distinct()


def first_by(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each `by`: the first in order, which should break all ties."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def numbered_in_groups(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, size: str | None = None) -> DataFrame:
    """rows with their place in their group, from 1, and the group's size, if asked for; order should break all ties.

    For groups that may hold a large share of all rows: rows are sorted in ranges over group and order, and counted by
    group and range, so a group is spread over as many tasks as it fills.
    """
    ranges = written(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_part").alias("_of"), before.alias("_before"), F.sum("_n").over(own).alias("_size"))
    within = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    here = F.col("_part") == F.col("_of")
    for c in group:
        here = here & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # a row for each group of a range: as many as there are ranges, and one more for each group
    told = ranges.withColumn("_in", within).join(starts, here).withColumn(name, (F.col("_before") + F.col("_in")).cast("bigint"))
    return told.select(*rows.columns, name, *([F.col("_size").alias(size)] if size else []))


def allocate_ids(rows: DataFrame, known: DataFrame, natural: Sequence[str], id_name: str, order: Sequence[str]) -> DataFrame:
    """rows with the id of their natural key: the known one, or the next free numbers in order.

    New keys are numbered by range: counts by partition give each partition its first number, so no task sees all.
    The dealt rows are written first, so that counts and numbers are of the same partitions even if a task runs again.
    """
    told = rows.join(known, list(natural), "left")
    fresh = told.where(F.col(id_name).isNull()).select(*natural, *[c for c in order if c not in natural]).distinct()
    ordered = written(fresh.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "new-keys")
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = known.agg(F.coalesce(F.max(id_name), F.lit(0)).alias("_top"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = ordered.withColumn("_in", within).join(F.broadcast(before), "_part").crossJoin(F.broadcast(top))
    ids = numbered.select(*natural, (F.col("_top") + F.col("_before") + F.col("_in")).alias("_new"))
    return told.join(ids, list(natural), "left").withColumn(id_name, F.coalesce(id_name, "_new")).drop("_new")
