"""Operators on effective-dated records: interval joins, as-of lookup, islands, carry-forward, sessions.

Joins are equi-joins on owner and month: an interval goes to each month that it touches, so an owner with a great share
of all rows is dealt to many tasks and only rows of one month meet. Sequences are windows partitioned by owner. Bounds
are inclusive dates; a null end is open unless said otherwise. Null owners match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(df: DataFrame, first: Column, last: Column, name: str = "day") -> DataFrame:
    """One row for each day from first to last, both inclusive."""
    return df.withColumn(name, F.explode(F.sequence(first, last)))


def _months(intervals: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row for each month from that of first to that of last, as _month; none where one is null or last is earlier."""
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return intervals.where(first <= last).withColumn("_month", F.explode(months))


def point_in_interval(points: DataFrame, intervals: DataFrame, owner: str, at: str, start: str = "s", end: str = "e", first_by: Sequence[Column] = (), open_end: bool = False, how: str = "inner") -> DataFrame:
    """Points with the interval of the same owner that holds them: of several the first in the given order.

    Intervals are dealt only to months between the first and the last point, so open and far ends cost no more rows.
    """
    range_of = points.agg(F.min(at).cast("date").alias("_low"), F.max(at).cast("date").alias("_high"))  # one row
    upper = F.col(at) <= F.col(end)
    last = F.least(F.col(end), F.col("_high")) if open_end else F.when(F.col(end).isNotNull(), F.least(F.col(end), F.col("_high")))
    dealt = _months(intervals.join(F.broadcast(range_of)), F.greatest(F.col(start), F.col("_low")), last)
    dealt = dealt.drop("_low", "_high").withColumnsRenamed({owner: "_owner", "_month": "_in"})
    meets = (F.col(owner) == F.col("_owner")) & (F.trunc(at, "month") == F.col("_in"))
    holds = meets & (F.col(at) >= F.col(start)) & ((F.col(end).isNull() | upper) if open_end else upper)
    joined = points.join(dealt, holds, how).drop("_owner", "_in")
    if not first_by:
        return joined
    rank = F.row_number().over(Window.partitionBy(owner, at).orderBy(*first_by))
    return joined.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def overlapping_pairs(intervals: DataFrame, owner: str, key: str, start: str = "s", end: str = "e") -> DataFrame:
    """(owner, key_a, key_b) of intervals of one owner that share a day, key_a < key_b.

    A pair is found in the month in which the later of the two begins. Intervals without a day share none.
    """
    latest = intervals.agg(F.max(start).alias("_latest"))  # one row: no interval is dealt to months after it
    dealt = _months(intervals.where(F.col(start) <= F.col(end)).join(F.broadcast(latest)), F.col(start), F.least(F.col(end), F.col("_latest")))
    a = dealt.select(owner, "_month", F.col(key).alias("key_a"), F.col(start).alias("_as"), F.col(end).alias("_ae"))
    b = dealt.select(owner, "_month", F.col(key).alias("key_b"), F.col(start).alias("_bs"), F.col(end).alias("_be"))
    shared = a.join(b, [owner, "_month"]).where("key_a < key_b AND _as <= _be AND _bs <= _ae")
    return shared.where(F.trunc(F.greatest("_as", "_bs"), "month") == F.col("_month")).select(owner, "key_a", "key_b")


def as_of(probes: DataFrame, versions: DataFrame, owner: str, at: str, since: str, fallback: str | None = None) -> DataFrame:
    """Each probe with its owner's latest version since or before that day.

    fallback: 'earliest' lets the first version hold from the beginning, 'newest' takes the last one where none holds
    yet; None leaves nulls. Of an owner's versions of one day the greatest by their other columns counts. A probe
    without an owner or a day finds none.

    Probes and versions are put in one order for each owner and month; what holds at a month's beginning comes from one
    row for each owner and month. So nothing is paired, and the work grows with the rows.
    """
    others = [c for c in versions.columns if c not in (owner, since)]
    known = versions.where(F.col(owner).isNotNull() & F.col(since).isNotNull())
    known = known.select(F.col(owner).alias("_owner"), F.col(since).alias("_at"), F.struct(since, *others).alias("_version"))
    asked = probes.select(F.col(owner).alias("_owner"), F.col(at).alias("_at"), F.struct("*").alias("_probe"))
    rows = known.unionByName(asked, allowMissingColumns=True).withColumn("_month", F.trunc("_at", "month"))
    by_owner = Window.partitionBy("_owner")
    earlier = by_owner.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = rows.groupBy("_owner", "_month").agg(F.min("_version").alias("_low"), F.max("_version").alias("_high"))
    otherwise = {"earliest": F.min("_low").over(by_owner), "newest": F.max("_high").over(by_owner)}.get(fallback, F.lit(None))
    months = months.select("_owner", "_month", F.coalesce(F.last("_high", ignorenulls=True).over(earlier), otherwise).alias("_begun"))
    here = Window.partitionBy("_owner", "_month").orderBy("_at", F.col("_probe").isNotNull(), "_version")
    told = rows.withColumn("_here", F.last("_version", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.where("_probe IS NOT NULL").join(months, ["_owner", "_month"], "left").select("_probe", F.coalesce("_here", "_begun").alias("_found"))
    return told.select("_probe.*", "_found.*")


def merge_islands(intervals: DataFrame, owners: Sequence[str], start: str = "s", end: str = "e", gap: int = 1) -> DataFrame:
    """(owners, start, end, parts): intervals that touch or overlap (next start <= end + gap days) as one."""
    w = Window.partitionBy(*owners).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > F.date_add(before, gap)), 1).otherwise(0)
    numbered = intervals.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*owners, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_island")


def day_islands(days: DataFrame, owners: Sequence[str], day: str = "day") -> DataFrame:
    """(owners, s, e, days): runs of consecutive days; repeated days count once."""
    distinct = days.select(*owners, day).distinct()
    run = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(*owners).orderBy(day)))
    return distinct.withColumn("_run", run).groupBy(*owners, "_run").agg(F.min(day).alias("s"), F.max(day).alias("e"), F.count("*").alias("days")).drop("_run")


def split_on_days(intervals: DataFrame, busy: DataFrame, owner: str, key: str, start: str = "s", end: str = "e", day: str = "day") -> DataFrame:
    """(owner, key, s, e, days): what is left of each interval without its owner's busy days.

    Intervals of one owner and key that touch count as one. A piece lies between two neighbouring busy days, so an
    interval makes as many rows as it has busy days and months, not days.
    """
    whole = merge_islands(intervals.where(F.col(start) <= F.col(end)).select(owner, key, F.col(start).alias("s"), F.col(end).alias("e")), [owner, key])
    days = busy.select(owner, F.col(day).alias("_cut"), F.trunc(day, "month").alias("_month")).distinct()
    cuts = _months(whole, F.col("s"), F.col("e")).join(days, [owner, "_month"]).where("_cut BETWEEN s AND e").select(owner, key, "s", "e", "_cut")
    marks = whole.select(owner, key, "s", "e", F.date_sub("s", 1).alias("_cut")).unionByName(cuts)
    until = F.date_sub(F.lead("_cut", 1).over(Window.partitionBy(owner, key, "s").orderBy("_cut")), 1)
    pieces = marks.withColumn("_until", F.coalesce(until, "e")).select(owner, key, F.date_add("_cut", 1).alias("s"), F.col("_until").alias("e"))
    return pieces.where("s <= e").withColumn("days", F.datediff("e", "s").cast("bigint") + 1)


def change_points(rows: DataFrame, owner: str, order: Sequence[str], state: str) -> DataFrame:
    """The rows whose state differs from the one before; the first of an owner always."""
    before = F.lag(state).over(Window.partitionBy(owner).orderBy(*order))
    number = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return rows.withColumns({"_before": before, "_n": number}).where((F.col("_n") == 1) | ~F.col(state).eqNullSafe(F.col("_before"))).drop("_before", "_n")


def change_points_without_blips(rows: DataFrame, owner: str, order: str, state: str) -> DataFrame:
    """change_points after states that last one row between two equal states are passed over.

    Whether a row is a blip depends on the state kept before it, so each owner's rows are walked in order.
    """
    import pandas as pd

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        states, kept, last = group[state].tolist(), [], None
        for k, value in enumerate(states):
            blip = kept and value != last and k + 1 < len(states) and states[k + 1] == last
            if not kept or (value != last and not blip):
                kept.append(k)
                last = value
        return group.iloc[kept]

    return rows.groupBy(owner).applyInPandas(walk, rows.schema)


def carry_forward(rows: DataFrame, owner: str, day: str, fields: Sequence[str], days: int, blank: str = "") -> DataFrame:
    """For each field its last present value within so many days before or on the row's day, and that day.

    A present but blank value counts: it ends what was carried before.
    """
    w = Window.partitionBy(owner).orderBy(F.unix_date(day)).rangeBetween(-days, 0)
    out = {}
    for f in fields:
        present = F.last(F.when(F.col(f).isNotNull(), F.struct(F.col(f).alias("v"), F.col(day).alias("d"))), ignorenulls=True).over(w)
        out |= {f"{f}_carried": F.nullif(present["v"], F.lit(blank)), f"{f}_from": F.when(present["v"] != blank, present["d"])}
    return rows.withColumns(out)


def capped_gaps(rows: DataFrame, owner: str, ts: str, event: str, login: str, logout: str, cap: int) -> DataFrame:
    """(owner, seconds): time between an owner's events, each gap at most cap seconds.

    A gap before a login and one after a logout do not count.
    """
    w = Window.partitionBy(owner).orderBy(ts, event)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    counts = (F.col(event) != login) & (F.lag(event).over(w) != logout)
    seconds = F.when(counts, F.least(F.floor(gap / 1_000_000), F.lit(cap))).otherwise(0)
    return rows.withColumn("_seconds", F.coalesce(seconds, F.lit(0))).groupBy(owner).agg(F.sum("_seconds").alias("seconds"))


def close_periods(periods: DataFrame, owner: str, start: str = "s", end: str = "e", ties: Sequence[str] = ()) -> DataFrame:
    """Periods of one owner cut the day before the next begins; those that vanish are dropped.

    ties: columns that tell which of several periods with the same start and end comes first; the last of them stays.
    """
    nxt = F.lead(start).over(Window.partitionBy(owner).orderBy(start, end, *ties))
    cut = F.when(nxt.isNull(), F.col(end)).otherwise(F.least(F.coalesce(F.col(end), F.date_sub(nxt, 1)), F.date_sub(nxt, 1)))
    return periods.withColumn(end, cut).where(F.col(end).isNull() | (F.col(end) >= F.col(start)))


def clamp(intervals: DataFrame, low: Column, high: Column, start: str = "s", end: str = "e") -> DataFrame:
    """Intervals trimmed to [low, high]; a null bound is open; what lies outside is dropped."""
    cut = intervals.withColumns({start: F.greatest(F.col(start), low), end: F.least(F.col(end), high)})
    return cut.where(F.col(start) <= F.col(end))
