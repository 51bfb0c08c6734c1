"""Differences between snapshots, three-way merges, multiset differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sided(df: DataFrame, keys: Sequence[str], fields: Sequence[str], side: str) -> DataFrame:
    return df.select(*keys, *[F.col(f).alias(f"{f}_{side}") for f in fields], F.lit(True).alias(f"_{side}"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, action, changed): created, deleted and updated rows, with the fields that differ."""
    both = _sided(old, keys, fields, "old").join(_sided(new, keys, fields, "new"), list(keys), "full")
    differs = [F.when(~F.col(f"{f}_old").eqNullSafe(F.col(f"{f}_new")), f) for f in fields]
    action = F.when(F.col("_old").isNull(), "create").when(F.col("_new").isNull(), "delete").otherwise("update")
    changed = F.when(action == "update", F.concat_ws(",", *differs)).otherwise("")
    return both.select(*keys, action.alias("action"), changed.alias("changed")).where("action <> 'update' OR changed <> ''")


def three_way(original: DataFrame, archive: DataFrame, stored: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, field, decision, value) for each field in which the archive differs from what was imported.

    A stored value that nobody has touched since the import is corrected; one that a user has changed is protected.
    """
    both = _sided(archive, keys, fields, "a").join(_sided(original, keys, fields, "o"), list(keys), "left").join(_sided(stored, keys, fields, "s"), list(keys), "left")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_o").cast("string").alias("o"), F.col(f"{f}_a").cast("string").alias("a"), F.col(f"{f}_s").cast("string").alias("s")) for f in fields])
    flat = both.select(*keys, F.col("_s").isNull().alias("_gone"), F.explode(cells).alias("c")).select(*keys, "_gone", "c.*")
    decision = F.when(F.col("_gone"), "deleted").when(F.col("s").eqNullSafe(F.col("a")), "same").when(F.col("s").eqNullSafe(F.col("o")), "correct").otherwise("protected")
    value = F.when(decision == "correct", F.col("a")).otherwise(F.col("s"))
    return flat.where(~F.col("a").eqNullSafe(F.col("o"))).select(*keys, "field", decision.alias("decision"), value.alias("value"))


def multiset_diff(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, change): how many more or fewer equal rows there are."""
    signed = before.select(*columns, F.lit(-1).alias("_n")).unionByName(after.select(*columns, F.lit(1).alias("_n")))
    return signed.groupBy(*columns).agg(F.sum("_n").alias("change")).where("change <> 0")


def field_agreement(reference: DataFrame, candidate: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(field, compared, matched, missing, extra): how well a candidate reproduces a reference, field by field."""
    both = _sided(reference, keys, fields, "r").join(_sided(candidate, keys, fields, "c"), list(keys), "full")
    compared = F.col("_r").isNotNull() & F.col("_c").isNotNull()
    sums = both.agg(
        F.count_if(compared).alias("compared"), F.count_if(F.col("_c").isNull()).alias("missing"), F.count_if(F.col("_r").isNull()).alias("extra"), *[F.count_if(compared & F.col(f"{f}_r").eqNullSafe(F.col(f"{f}_c"))).alias(f"m_{f}") for f in fields]
    )
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("compared"), F.col(f"m_{f}").alias("matched"), F.col("missing"), F.col("extra")) for f in fields])).alias("x")).select("x.*")


def fill_gaps(stored: DataFrame, found: DataFrame, edited: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """stored with blank fields filled from found, except where a user has edited the field (keys of edited)."""
    new = found.select(*keys, F.col(field).alias("_new"))
    touched = edited.select(*keys).distinct().withColumn("_edited", F.lit(True))
    joined = stored.join(new, list(keys), "left").join(touched, list(keys), "left")
    blank = F.coalesce(F.col(field), F.lit("")) == ""
    return joined.withColumn(field, F.when(blank & F.col("_edited").isNull(), F.coalesce("_new", field)).otherwise(F.col(field))).drop("_new", "_edited")


def state_hash(columns: Sequence[Column]) -> Column:
    """Digest of a row's values as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def upsert_version(history: DataFrame, new: DataFrame, owner: str, since: str, setting: str) -> DataFrame:
    """history with new versions put in: one for each owner and day, the new one wins; unchanged ones are not added."""
    marked = history.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    from quarry.operators.relational import first_by
    from quarry.operators.temporal import change_points

    latest = first_by(marked, [owner, since], [F.desc("_new")]).drop("_new")
    return change_points(latest, owner, [since], setting)
