"""Days put together from records and sheets: inherited fields, cells with their sources, comparison of sheets, catalogues with aliases."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import components


def inherited(rows: DataFrame, owner: Sequence[str], day: str, groups: Sequence[Sequence[str]], fields: str = "fields", window_days: int = 31) -> DataFrame:
    """rows with each field's value, the day that it comes from and whether it is inherited, from maps that hold what a day has set.

    Fields of one group belong together: where a day sets any of them, the others are reset, so a vehicle never stands
    with the plate of another one. A field that is set to blank or null is set, and ends what came before; what was set
    more than window_days before is forgotten. Rows of one owner and day count as one, the greater value of a field.
    Adds <field>, <field>_day and <field>_inherited; not set within the window: null, null and false.
    """
    every = [f for g in groups for f in g]
    has = lambda f: F.array_contains(F.map_keys(fields), f)
    flat = rows.select(*owner, day, *[F.when(has(f), F.struct(F.element_at(fields, f).alias("v"))).alias(f"_{f}") for f in every])
    one = flat.groupBy(*owner, day).agg(*[F.max(f"_{f}").alias(f"_{f}") for f in every])
    back = Window.partitionBy(*owner).orderBy(F.unix_date(day)).rangeBetween(-window_days, 0)
    out = one
    for k, group in enumerate(groups):
        some = F.lit(False)
        for f in group:
            some = some | F.col(f"_{f}").isNotNull()
        kept = F.struct(F.col(day).alias("day"), *[F.col(f"_{f}.v").alias(f) for f in group])
        out = out.withColumn(f"_group_{k}", F.last(F.when(some, kept), ignorenulls=True).over(back))
    added = []
    for k, group in enumerate(groups):
        for f in group:
            value = F.nullif(F.trim(F.col(f"_group_{k}.{f}")), F.lit(""))
            source = F.when(value.isNotNull(), F.col(f"_group_{k}.day"))
            added += [value.alias(f), source.alias(f"{f}_day"), F.coalesce(source < F.col(day), F.lit(False)).alias(f"{f}_inherited")]
    return out.select(*owner, day, *added)


def assembled(records: DataFrame, precedence: DataFrame, cell: Sequence[str] = ("day", "entity", "field")) -> tuple[DataFrame, DataFrame]:
    """(cells, sources) of records (day, entity, field, value, record, role, at) by precedence (field, role, place, rule).

    Every cell is the value of the role with the least place for its field, of the newest `at` within a role, then of
    the least record; blank values are no values, and roles without a place for a field say nothing about it. cells:
    value, rule, record, how many records say the same and how many another value. sources: the records of each cell
    and whether they agree, so that every cell can be traced to all that was written about it.
    """
    ranked = records.where("trim(value) <> ''").join(F.broadcast(precedence), ["field", "role"])  # a few roles for each field
    order = F.struct("place", F.struct(-F.unix_seconds("at")), "record")
    by_value = ranked.groupBy(*cell, "value").agg(F.min(order).alias("first"), F.min_by("rule", order).alias("rule"), F.count("*").alias("n"))
    best = by_value.groupBy(*cell).agg(F.min_by(F.struct("value", "rule", F.col("first.record").alias("record"), "n"), "first").alias("b"), F.sum("n").alias("all"))
    cells = best.select(*cell, "b.value", "b.rule", "b.record", F.col("b.n").alias("agreeing"), (F.col("all") - F.col("b.n")).alias("conflicting"))
    sources = ranked.join(cells.select(*cell, F.col("value").alias("_value")), list(cell)).select(*cell, "record", "role", (F.col("value") == F.col("_value")).alias("agrees"))
    return cells, sources


def in_order(rows: DataFrame, group: Sequence[str], item: str, left: str, right: str) -> DataFrame:
    """(group, item, moved) for rows with places left and right in two orders: those outside a longest run kept by both are moved.

    The run is a longest increasing subsequence of right by left; of several the one that ends first. A group, one sheet
    of one day, is walked by one task as its rows come, with two numbers for each.
    """
    kinds = [(c, rows.schema[c].dataType.simpleString()) for c in (*group, item)]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column(right).to_numpy(), table.column(left).to_numpy()))
        places = table.column(right).to_numpy()[order]
        ends, at, before = np.empty(len(places), places.dtype), np.empty(len(places), np.int64), np.full(len(places), -1, np.int64)
        n = 0
        for k, place in enumerate(places):
            p = int(np.searchsorted(ends[:n], place))
            before[k] = at[p - 1] if p else -1
            ends[p], at[p] = place, k
            n = max(n, p + 1)
        moved, k = np.ones(len(places), bool), at[n - 1] if n else -1
        while k >= 0:
            moved[k], k = False, before[k]
        told = table.select([c for c, _ in kinds]).take(pa.array(order))
        return told.append_column("moved", pa.array(moved))

    schema = ", ".join(f"{c} {t}" for c, t in kinds) + ", moved boolean"
    return rows.select(*group, item, left, right).groupBy(*group).applyInArrow(run, schema)


def compared(archive: DataFrame, system: DataFrame, group: Sequence[str], key: str, place: str, fields: Sequence[str]) -> DataFrame:
    """(group, key, kind, field, archive_value, system_value): how two versions of a sheet differ.

    kinds: missing and extra, rows of one of them; content, fields that differ (blank and null are alike); order, rows
    of both that stand elsewhere among the rows of both. Rows that repeat a key are told apart by their occurrence.
    """

    def numbered(df: DataFrame, side: str) -> DataFrame:
        times = F.row_number().over(Window.partitionBy(*group, key).orderBy(place))
        return df.withColumn("_times", times).select(*group, key, "_times", F.col(place).alias(f"_{side}_place"), *[F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")).alias(f"_{side}_{f}") for f in fields])

    both = numbered(archive, "a").join(numbered(system, "s"), [*group, key, "_times"], "full_outer")
    none = F.lit(None).cast("string")
    one = F.when(F.col("_s_place").isNull(), "missing").when(F.col("_a_place").isNull(), "extra")
    alone = both.where(one.isNotNull()).select(*group, key, one.alias("kind"), none.alias("field"), none.alias("archive_value"), none.alias("system_value"))
    shared = both.where("_a_place IS NOT NULL AND _s_place IS NOT NULL")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a_{f}").alias("archive_value"), F.col(f"_s_{f}").alias("system_value")) for f in fields])).alias("c")
    content = shared.select(*group, key, F.lit("content").alias("kind"), cells).select(*group, key, "kind", "c.*").where("archive_value <> system_value")
    places = shared.select(*group, F.struct(key, "_times", F.col("_a_place").alias("a"), F.col("_s_place").alias("s")).alias("_item"), F.col("_a_place").cast("long").alias("_left"), F.col("_s_place").cast("long").alias("_right"))
    packed = places.withColumn("_name", F.to_json("_item"))
    moved = in_order(packed, group, "_name", "_left", "_right").where("moved")
    told = F.from_json("_name", shared.select(F.struct(key, "_times", F.col("_a_place").alias("a"), F.col("_s_place").alias("s")).alias("_item")).schema["_item"].dataType.simpleString()).alias("i")
    order = moved.select(*group, told).select(*group, F.col(f"i.{key}"), F.lit("order").alias("kind"), none.alias("field"), F.col("i.a").cast("string").alias("archive_value"), F.col("i.s").cast("string").alias("system_value"))
    return alone.unionByName(content).unionByName(order)


def packing(archive: DataFrame, system: DataFrame, group: Sequence[str], row: str, half: str, item: str) -> DataFrame:
    """(group, left_item, right_item, side): pairs that share a printed row in one version only, of items that both have."""

    def pairs(df: DataFrame) -> DataFrame:
        halves = lambda h, name: df.where(F.col(half) == h).select(*group, row, F.col(item).alias(name))
        return halves(0, "left_item").join(halves(1, "right_item"), [*group, row]).drop(row).distinct()

    both = archive.select(*group, item).distinct().join(system.select(*group, item).distinct(), [*group, item])
    known = lambda df, name: df.join(both.withColumnRenamed(item, name), [*group, name], "left_semi")
    a, s = (known(known(pairs(df), "left_item"), "right_item") for df in (archive, system))
    on = [*group, "left_item", "right_item"]
    return a.join(s, on, "left_anti").withColumn("side", F.lit("archive")).unionByName(s.join(a, on, "left_anti").withColumn("side", F.lit("system"))).select(*on, "side")


def catalogue(mentions: DataFrame, aliases: DataFrame, values: Sequence[str]) -> DataFrame:
    """(name, names, n, first, <value>, <value>_n) of mentions (name, id, <values>) and aliases (alias, name).

    Aliases of aliases lead to one entry, as do two names of one alias. An entry goes by its most frequent name, of
    equally frequent ones by that of the least id; <value> is the mode of its values, ties alike, nulls and blanks aside.
    names are all its names and aliases that occur in either table, first is its least id.
    """
    edges = aliases.where("alias IS NOT NULL AND name IS NOT NULL").select(F.col("alias").alias("a"), F.col("name").alias("b"))
    roots = components(edges)
    named = lambda df: df.join(roots, F.col("name") == F.col("node"), "left").withColumn("root", F.coalesce("root", "name")).drop("node")
    known = named(mentions.where("name IS NOT NULL"))
    mode = lambda c: known.where(F.col(c).isNotNull() & (F.trim(F.col(c)) != "")).groupBy("root", c).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    best = lambda c: mode(c).groupBy("root").agg(F.max_by(F.struct(c, "n"), F.struct("n", -F.col("first"))).alias("b"))
    out = best("name").select("root", F.col("b.name").alias("name"))
    sums = known.groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    every = named(mentions.select("name").where("name IS NOT NULL").unionByName(aliases.select(F.col("alias").alias("name")).where("name IS NOT NULL")).unionByName(aliases.select("name").where("name IS NOT NULL")).distinct())
    names = every.groupBy("root").agg(F.sort_array(F.collect_set("name")).alias("names"))
    out = out.join(sums, "root").join(names, "root")
    for c in values:
        out = out.join(best(c).select("root", F.col(f"b.{c}").alias(c), F.col("b.n").alias(f"{c}_n")), "root", "left")
    return out.select("name", "names", "n", "first", *[x for c in values for x in (c, f"{c}_n")])


def pivoted(cells: DataFrame, fields: Sequence[str], row: Sequence[str] = ("day", "entity")) -> DataFrame:
    """A row for each day and entity, each field with its value, rule and record."""
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    each: list[Column] = [pick(f, c).alias(n) for f in fields for c, n in (("value", f), ("rule", f"{f}_rule"), ("record", f"{f}_record"))]
    return cells.groupBy(*row).agg(*each)
