"""Lists kept as dated versions: ids by first appearance, the list of any day, and the days that still follow a template."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stable_ids(versions: DataFrame, group: str) -> DataFrame:
    """(group, name, id, first_from) for versions (group, since, items: array of (id, name, ..)).

    A name keeps the id that it had in its first version; of several in one version the first in the list that has an
    id. Names of which no version has an id are left out.
    """
    items = versions.select(group, "since", F.posexplode("items").alias("at", "item")).select(group, "since", "at", F.trim("item.name").alias("name"), F.trim("item.id").alias("id"))
    known = items.where((F.col("name") != "") & (F.col("id") != ""))
    return known.groupBy(group, "name").agg(F.min_by("id", F.struct("since", "at")).alias("id"), F.min("since").alias("first_from"))


def list_on(versions: DataFrame, days: DataFrame, group: str) -> DataFrame:
    """(group, day, since, at, id, name, changed) of each of days (group, day): the newest version by then, with stable ids.

    changed: the item's own id in that version is another one. Days before the first version have no rows. Versions of
    one day: the one that comes last in the order of its items' text.
    """
    newest = versions.groupBy(group, "since").agg(F.max("items").alias("items"))
    marks = newest.select(group, F.col("since").alias("day"), F.lit(0).alias("ask"), F.struct("since", "items").alias("v")).unionByName(days.select(group, "day", F.lit(1).alias("ask")), allowMissingColumns=True)
    latest = F.last("v", ignorenulls=True).over(Window.partitionBy(group).orderBy("day", "ask").rowsBetween(Window.unboundedPreceding, 0))
    asked = marks.withColumn("v", latest).where("ask = 1 AND v IS NOT NULL").select(group, "day", "v.since", F.posexplode("v.items").alias("at", "item"))
    named = asked.withColumn("name", F.trim("item.name")).where("name <> ''")
    with_id = named.join(stable_ids(versions, group).drop("first_from"), [group, "name"], "left")
    own = F.nullif(F.trim("item.id"), F.lit(""))
    return with_id.select(group, "day", "since", "at", F.coalesce("id", own).alias("id"), "name", F.coalesce(F.col("id") != own, F.lit(False)).alias("changed")).where("id IS NOT NULL")


def starting_rows(sheets: DataFrame, template: DataFrame, days: DataFrame, key: list[str], value: str) -> DataFrame:
    """(day, <key>, <value>, source, origin) for days (day, imported) without a stored sheet, from sheets (day, <key>, <value>).

    The sheet of the last stored day before it is copied if it is newer than the template's last change and was not
    imported; else the template (<key>, <value>, changed_on) is taken, with `value` carried from that sheet where it
    has the key and is not blank. Days with a stored sheet keep it.
    """
    stored = sheets.groupBy("day").agg(F.first("imported").alias("from_import"))
    asked = days.select("day").distinct()
    marks = asked.join(stored, "day", "full_outer").select("day", F.col("from_import").isNotNull().alias("has"), "from_import")
    held = F.when(F.col("has"), F.struct("day", "from_import"))
    # counted by months first, so that no task walks over all days
    block = F.trunc("day", "MM")
    ends = marks.groupBy(block.alias("block")).agg(F.max(held).alias("held"))
    earlier = ends.withColumn("earlier", F.max("held").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", "earlier")
    within = F.max(held).over(Window.partitionBy("block").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    told = marks.withColumn("block", block).withColumn("within", within).join(F.broadcast(earlier), "block").withColumn("last", F.coalesce("within", "earlier"))
    wanted = told.join(asked, "day", "left_semi")
    changed = template.agg(F.max("changed_on").alias("changed_on"))  # one row
    ruled = wanted.join(F.broadcast(changed)).select("day", "has", F.col("last.day").alias("source"), F.coalesce(F.col("last.day") > F.coalesce("changed_on", F.lit("0001-01-01").cast("date")), F.lit(False)).alias("newer"), F.coalesce("last.from_import", F.lit(True)).alias("from_import"))
    kind = F.when(F.col("has"), "own").when(F.col("newer") & ~F.col("from_import"), "copied").otherwise("template")
    ruled = ruled.withColumn("origin", kind)
    rows = sheets.select(F.col("day").alias("source"), *key, value)
    kept = ruled.where("origin <> 'template'").withColumn("source", F.when(F.col("origin") == "own", F.col("day")).otherwise(F.col("source"))).join(rows, "source").select("day", *key, value, "source", "origin")
    fresh = ruled.where("origin = 'template'").join(F.broadcast(template.drop("changed_on")))  # a template is one sheet
    carried = fresh.join(rows.withColumnRenamed(value, "_carried"), ["source", *key], "left")
    return kept.unionByName(carried.select("day", *key, F.coalesce(F.nullif(F.trim("_carried"), F.lit("")), value).alias(value), "source", "origin"))
