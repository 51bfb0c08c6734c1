"""Upserts that say what became of every row: inserted, updated, unchanged or refused with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import written

Unique = Sequence[tuple[str, Sequence[str]]]


def _judged(table: DataFrame, pending: DataFrame, key: Sequence[str], values: Sequence[str], rules: Sequence[tuple[str, Column]], unique: Unique) -> DataFrame:
    """pending, merged with table, with outcome, reasons and clash: whether a shared value alone is what stands against it."""
    own = table.select(*key, *[F.col(c).alias(f"_old_{c}") for c in values], F.lit(True).alias("_stored"))
    met = pending.join(own, list(key), "left")
    merged = met.select(*key, "_at", F.coalesce("_stored", F.lit(False)).alias("_stored"), *[F.coalesce(c, f"_old_{c}").alias(c) for c in values], *[f"_old_{c}" for c in values], *[F.col(c).alias(f"_given_{c}") for c in values])
    same = F.col("_stored")
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    none = F.array().cast("array<string>")
    broken = F.array_compact(F.concat(none, *[F.array(F.when(F.coalesce(condition, F.lit(False)), F.lit(reason))) for reason, condition in rules]))
    told = merged.withColumn("_same", same).withColumn("_broken", F.when(F.col("_same"), none).otherwise(broken))
    clashes = none
    for number, (reason, columns) in enumerate(unique):
        known = F.lit(True)
        for c in columns:
            known = known & F.col(c).isNotNull()
        holder = table.where(known).groupBy(*columns).agg(F.min(F.struct(*key)).alias(f"_holder_{number}"))
        asks = Window.partitionBy(*columns, known & ~F.col("_same") & (F.size("_broken") == 0)).orderBy("_at", *key)
        told = told.withColumn(f"_place_{number}", F.when(known, F.row_number().over(asks)).otherwise(1)).join(holder, list(columns), "left")
        held = F.col(f"_holder_{number}").isNotNull() & (F.col(f"_holder_{number}") != F.struct(*key))
        clashes = F.concat(clashes, F.array(F.when(~F.col("_same") & known & (held | (F.col(f"_place_{number}") > 1)), F.lit(reason))))
    told = told.withColumn("_clashes", F.array_compact(clashes))
    refused = (F.size("_broken") > 0) | (F.size("_clashes") > 0)
    kind = F.when(F.col("_same"), "unchanged").when(refused, "refused").when(F.col("_stored"), "updated").otherwise("inserted")
    reasons = F.array_join(F.concat("_broken", "_clashes"), ",")
    return told.select(*key, "_at", *values, *[f"_given_{c}" for c in values], kind.alias("outcome"), reasons.alias("reasons"), ((kind == "refused") & (F.size("_broken") == 0)).alias("clash"))


def upsert(stored: DataFrame, batch: DataFrame, key: Sequence[str], rules: Sequence[tuple[str, Column]] = (), unique: Unique = (), order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, outcome) of merging batch into stored by key; both have the same columns; null in batch leaves a value as it is.

    rules: (reason, condition) on the merged row; where a condition is true the row is refused. unique: (reason,
    columns) that no two rows may share; nulls are never shared. A value belongs to the stored row that has it, else to
    the first batch row, by `order` and key, that asks for it and breaks no rule. A value that an accepted row gives up
    is free afterwards: refused rows are judged again until none is accepted, so a second run of the same batch finds
    nothing to change. Of several batch rows with one key the last by `order` counts, of equals the one whose values
    hash highest; the others are refused as repeated, rows with a null in the key as keyless.

    outcome: key, outcome (inserted, updated, unchanged, refused) and reasons, comma-separated, one for each batch row.
    """
    values = [c for c in batch.columns if c not in key and c != order]
    no_key = F.lit(False)
    for c in key:
        no_key = no_key | F.col(c).isNull()
    marked = batch.select(*key, *values, (F.col(order) if order else F.lit(0)).alias("_at"), no_key.alias("_no_key"))
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_at").desc_nulls_last(), F.xxhash64(*values).desc()))
    ranked = marked.withColumn("_again", ~F.col("_no_key") & (last > 1))
    early = ranked.where("_no_key OR _again").select(*key, F.lit("refused").alias("outcome"), F.when(F.col("_no_key"), "keyless").otherwise("repeated").alias("reasons"))
    table, pending, done = stored.select(*key, *values), ranked.where("NOT _no_key AND NOT _again").select(*key, "_at", *values), early
    while True:
        told = written(_judged(table, pending, key, values, rules, unique), "judged")
        accepted = told.where("outcome IN ('inserted', 'updated')").select(*key, *values)
        if accepted.isEmpty():
            break
        table = written(table.join(accepted.select(*key), list(key), "left_anti").unionByName(accepted), "upserted")
        done = done.unionByName(told.where("NOT clash").select(*key, "outcome", "reasons"))
        pending = told.where("clash").select(*key, "_at", *[F.col(f"_given_{c}").alias(c) for c in values])
    return table, done.unionByName(told.select(*key, "outcome", "reasons"))
