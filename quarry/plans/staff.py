"""The officer's day, the board and the rules on it, rests, drivers, missions.

People are customers: on force from `joined` to `left_on`, with a rank of 0 (highest) to 7. Assignments are line items
of a person's orders: one service on a day, in a section, on a shift. Leaves and versions are those of the domain;
courses and written statuses are intervals beside some orders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import dates
from quarry.operators import classify, relational, temporal
from quarry.plans.domain import LEAVES, VERSIONS, leaves, load, versions
from quarry.plans.registry import query

PEOPLE = "people AS (SELECT c_custkey AS person, c_name AS name, CAST(c_custkey % 8 AS INTEGER) AS rank, DATE '1995-01-01' + CAST(c_custkey % 400 AS INTEGER) AS joined, CASE WHEN c_custkey % 11 = 0 THEN DATE '2000-01-01' + CAST(c_custkey % 365 AS INTEGER) END AS left_on FROM customer)"
ASSIGN = "assign AS (SELECT o_custkey AS person, CAST(l_shipdate AS DATE) AS day, l_returnflag AS section, CASE l_linestatus WHEN 'O' THEN 'morning' ELSE 'night' END AS shift, l_partkey AS service FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
COURSES = "courses AS (SELECT o_orderkey AS id, o_custkey AS person, CAST(o_orderdate AS DATE) + 5 AS s, CAST(o_orderdate AS DATE) + 25 AS e FROM orders WHERE o_orderkey % 7 = 3)"
STATUSES = "statuses AS (SELECT o_orderkey AS id, o_custkey AS person, o_orderstatus AS status, CAST(o_orderdate AS DATE) + 2 AS s, CAST(o_orderdate AS DATE) + 9 AS e FROM orders WHERE o_orderkey % 5 = 4)"
TODAY = "DATE '1998-06-15'"


def today() -> Column:
    return F.lit("1998-06-15").cast("date")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    left = F.when(key % 11 == 0, F.date_add(F.lit("2000-01-01").cast("date"), (key % 365).cast("int")))
    joined = F.date_add(F.lit("1995-01-01").cast("date"), (key % 400).cast("int"))
    return load(spark, sf_dir, "customer").select(key.alias("person"), F.col("c_name").alias("name"), (key % 8).cast("int").alias("rank"), joined.alias("joined"), left.alias("left_on"))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("section"), F.when(F.col("l_linestatus") == "O", "morning").otherwise("night").alias("shift"), F.col("l_partkey").alias("service"))
    owners = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person"))
    return items.join(owners, "l_orderkey").select("person", "day", "section", "shift", "service")


def _beside(spark: SparkSession, sf_dir: str, condition: str, first: int, last: int) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return load(spark, sf_dir, "orders").where(condition).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), F.col("o_orderstatus").alias("status"), F.date_add(day, first).alias("s"), F.date_add(day, last).alias("e"))


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beside(spark, sf_dir, "o_orderkey % 7 = 3", 5, 25).drop("status")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beside(spark, sf_dir, "o_orderkey % 5 = 4", 2, 9)


def on_force(day: Column) -> Column:
    return (F.col("joined") <= day) & (F.col("left_on").isNull() | (day <= F.col("left_on")))


_DAY = f"""{PEOPLE}, {ASSIGN}, {LEAVES}, {VERSIONS}, {COURSES}, {STATUSES},
d AS (SELECT person, day, string_agg(DISTINCT section, '+' ORDER BY section) AS services, min(shift) AS shift, count(*) AS n FROM assign GROUP BY 1, 2),
f AS (SELECT d.*, rank FROM d JOIN people USING (person) WHERE joined <= day AND (left_on IS NULL OR day <= left_on)),
lv AS (SELECT f.person, f.day, arg_min(kind, struct_pack(s := s, i := id)) AS leave FROM f JOIN leaves l ON l.person = f.person AND f.day BETWEEN s AND e GROUP BY 1, 2),
cv AS (SELECT DISTINCT f.person, f.day, true AS course FROM f JOIN courses l ON l.person = f.person AND f.day BETWEEN s AND e),
sv AS (SELECT f.person, f.day, arg_max(status, struct_pack(s := s, i := id)) AS written FROM f JOIN statuses l ON l.person = f.person AND f.day BETWEEN s AND e GROUP BY 1, 2),
vs AS (SELECT *, lead(since) OVER (PARTITION BY person ORDER BY since) AS until, min(since) OVER (PARTITION BY person) AS first FROM versions),
rows AS (SELECT f.*, setting AS rest_system, leave, coalesce(course, false) AS course, written FROM f LEFT JOIN lv USING (person, day) LEFT JOIN cv USING (person, day) LEFT JOIN sv USING (person, day)
  LEFT JOIN vs ON vs.person = f.person AND (vs.since <= f.day AND (until IS NULL OR f.day < until) OR vs.since = first AND f.day < first))"""
_BUCKET = "CASE WHEN written IS NOT NULL THEN 'written' WHEN leave IS NOT NULL AND n = 1 THEN 'rest' WHEN services LIKE '%A%' THEN 'guard' WHEN course THEN 'course' WHEN shift = 'night' THEN 'night' ELSE 'service' END"


def _held(points: DataFrame, intervals: DataFrame, value: Column, name: str) -> DataFrame:
    """(person, day, name) of the points that an interval of their person holds."""
    i = intervals.withColumnRenamed("person", "_person")
    held = points.select("person", "day").join(i, (F.col("person") == F.col("_person")) & F.col("day").between(F.col("s"), F.col("e")))
    return held.groupBy("person", "day").agg(value.alias(name))


def officer_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's day on force: services, the rest system then in force, leave, course, written status."""
    days = assignments(spark, sf_dir).groupBy("person", "day").agg(F.array_join(F.array_sort(F.collect_set("section")), "+").alias("services"), F.min("shift").alias("shift"), F.count("*").alias("n"))
    force = days.join(people(spark, sf_dir).select("person", "rank", "joined", "left_on"), "person").where(on_force(F.col("day"))).drop("joined", "left_on")
    known = temporal.as_of(force, versions(spark, sf_dir), "person", "day", "since", "earliest").drop("since").withColumnRenamed("setting", "rest_system")
    first, last = F.min_by("kind", F.struct("s", "id")), F.max_by("status", F.struct("s", "id"))
    for part in (_held(force, leaves(spark, sf_dir), first, "leave"), _held(force, courses(spark, sf_dir), F.lit(True), "course"), _held(force, statuses(spark, sf_dir), last, "written")):
        known = known.join(part, ["person", "day"], "left")
    return known.withColumn("course", F.coalesce("course", F.lit(False)))


def _bucket() -> Column:
    c = F.col
    return classify.ladder([(c("written").isNotNull(), "written"), (c("leave").isNotNull() & (c("n") == 1), "rest"), (c("services").contains("A"), "guard"), (c("course"), "course"), (c("shift") == "night", "night")], "service")


@query(f"WITH {_DAY} SELECT person, day, rank, services, shift, n, rest_system, leave, course, written, {_BUCKET} AS bucket, concat_ws(' / ', services, leave, CASE WHEN course THEN 'course' END, written) AS text FROM rows")
def officer_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: the full row of an officer's day, with its bucket by the first rule that holds and its text."""
    text = F.concat_ws(" / ", "services", "leave", F.when(F.col("course"), "course"), "written")
    return officer_days(spark, sf_dir).select("person", "day", "rank", "services", "shift", "n", "rest_system", "leave", "course", "written", _bucket().alias("bucket"), text.alias("text"))


@query(f"WITH {_DAY}, b AS (SELECT person, day, {_BUCKET} AS bucket FROM rows) SELECT person, bucket, count(*) AS days, min(day) AS first_day, max(day) AS last_day, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS log FROM b GROUP BY 1, 2")
def officer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each officer's log, by bucket."""
    b = officer_days(spark, sf_dir).select("person", "day", _bucket().alias("bucket"))
    return b.groupBy("person", "bucket").agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.array_join(F.array_sort(F.collect_list(F.col("day").cast("string"))), ",").alias("log"))


_SECTIONS = "(VALUES ('A', 0), ('N', 1), ('R', 2)) x(section, place)"


@query(f"""WITH {PEOPLE}, {ASSIGN}, {LEAVES}, days AS (SELECT DISTINCT day FROM assign),
o AS (SELECT DISTINCT day, section, person, rank FROM assign JOIN people USING (person) WHERE joined <= day AND (left_on IS NULL OR day <= left_on)),
g AS (SELECT day, section, count(*) AS n, string_agg(CAST(person AS VARCHAR), ',' ORDER BY rank, person) AS officers FROM o GROUP BY 1, 2),
r AS (SELECT s - 1 AS day, count(*) AS n FROM leaves GROUP BY 1)
SELECT days.day, section, place, coalesce(g.n, 0) AS n, coalesce(officers, '') AS officers, g.n IS NULL AS vacant, coalesce(r.n, 0) AS rests_tomorrow FROM days CROSS JOIN {_SECTIONS} LEFT JOIN g USING (day, section) LEFT JOIN r ON r.day = days.day""")
def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board of each day: every section in its place, its officers by rank, vacancies, rests of tomorrow."""
    a = assignments(spark, sf_dir).select("day", "section", "person").distinct()
    o = a.join(people(spark, sf_dir), "person").where(on_force(F.col("day")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "person"))), lambda x: x["person"].cast("string")), ",")
    groups = o.groupBy("day", "section").agg(F.count("*").alias("n"), listed.alias("officers"))
    sections = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("place")) for k, s in enumerate("ANR")]))
    domain = a.select("day").distinct().select("day", sections.alias("x")).select("day", "x.*")
    rests = leaves(spark, sf_dir).groupBy(F.date_add("s", -1).alias("day")).agg(F.count("*").alias("rests_tomorrow"))
    full = relational.on_domain(domain.join(rests, "day", "left").withColumn("rests_tomorrow", F.coalesce("rests_tomorrow", F.lit(0))), groups, ["day", "section"], {})
    return full.select("day", "section", "place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("officers", F.lit("")).alias("officers"), F.col("n").isNull().alias("vacant"), "rests_tomorrow")


@query(f"""WITH {_DAY}
SELECT day, person, 'leave and duty' AS kind, 'critical' AS level FROM rows WHERE leave IS NOT NULL
UNION ALL SELECT day, person, 'status and duty', 'critical' FROM rows WHERE written IS NOT NULL
UNION ALL SELECT day, person, 'leave and course', 'warning' FROM rows WHERE leave IS NOT NULL AND course
UNION ALL SELECT day, person, 'same shift', 'info' FROM assign GROUP BY day, person, shift HAVING count(*) >= 2
UNION ALL SELECT day, NULL, 'vacant', 'warning' FROM assign WHERE service % 500 = 0
UNION ALL SELECT DISTINCT day, person, 'mission and duty', 'info' FROM assign JOIN (SELECT DISTINCT day, person FROM assign WHERE section = 'R') m USING (day, person) WHERE section = 'N'
UNION ALL SELECT day, person, 'weekly rest not recorded', 'info' FROM rows WHERE rest_system = '1-URGENT' AND person % 7 = (isodow(day) + 1) % 7 AND leave IS NULL""")
def all_rule_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on a day's rows, with its kind and level."""
    rows, a = officer_days(spark, sf_dir), assignments(spark, sf_dir)
    told = lambda df, kind, level: df.select("day", "person", F.lit(kind).alias("kind"), F.lit(level).alias("level"))
    mission = a.where("section = 'R'").select("day", "person").distinct()
    unrecorded = rows.where((F.col("rest_system") == "1-URGENT") & (F.col("person") % 7 == dates.weekday_index(F.col("day"))) & F.col("leave").isNull())
    rules = [
        told(rows.where("leave IS NOT NULL"), "leave and duty", "critical"),
        told(rows.where("written IS NOT NULL"), "status and duty", "critical"),
        told(rows.where("leave IS NOT NULL AND course"), "leave and course", "warning"),
        told(a.groupBy("day", "person", "shift").count().where("count >= 2"), "same shift", "info"),
        told(a.where("service % 500 = 0").withColumn("person", F.lit(None).cast("bigint")), "vacant", "warning"),
        told(a.where("section = 'N'").join(mission, ["day", "person"]).select("day", "person").distinct(), "mission and duty", "info"),
        told(unrecorded, "weekly rest not recorded", "info"),
    ]
    return reduce(DataFrame.unionAll, rules)


_REST_DAY = f"""e AS (SELECT p.person, p.name, coalesce((SELECT arg_max(setting, since) FROM versions v WHERE v.person = p.person AND since <= {TODAY}), (SELECT arg_min(setting, since) FROM versions v WHERE v.person = p.person)) AS rest_system FROM people p WHERE joined <= {TODAY} AND (left_on IS NULL OR {TODAY} <= left_on))"""


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person, name, rest_system): people on force today with the rest system then in force."""
    force = people(spark, sf_dir).where(on_force(today())).select("person", "name", today().alias("day"))
    return temporal.as_of(force, versions(spark, sf_dir), "person", "day", "since", "earliest").select("person", "name", F.col("setting").alias("rest_system"))


@query(f"""WITH {PEOPLE}, {VERSIONS}, {LEAVES}, {COURSES}, {_REST_DAY}
SELECT person, name FROM e WHERE rest_system IN ('1-URGENT', '2-HIGH') AND person % 7 = (isodow({TODAY}) + 1) % 7
  AND person NOT IN (SELECT person FROM leaves WHERE {TODAY} BETWEEN s AND e) AND person NOT IN (SELECT person FROM courses WHERE {TODAY} BETWEEN s AND e)""")
def weekly_rest_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People whose effective weekly rest day is this day, without those on leave or in a course."""
    due = _effective(spark, sf_dir).where(F.col("rest_system").isin("1-URGENT", "2-HIGH") & (F.col("person") % 7 == dates.weekday_index(today())))
    for busy in (leaves(spark, sf_dir), courses(spark, sf_dir)):
        due = due.join(busy.where(today().between(F.col("s"), F.col("e"))).select("person").distinct(), "person", "left_anti")
    return due.select("person", "name")


@query(f"""WITH {PEOPLE}, {VERSIONS}, {LEAVES}, {_REST_DAY}
SELECT e.person, rest_system, {TODAY} + CAST((person % 7 - (isodow({TODAY}) + 1) % 7 + 6) % 7 + 1 AS INTEGER) AS next_fixed, coalesce(upcoming, '') AS upcoming
FROM e LEFT JOIN (SELECT person, string_agg(CAST(s AS VARCHAR) || ' ' || kind, '; ' ORDER BY s, id) AS upcoming FROM leaves WHERE s > {TODAY} GROUP BY 1) USING (person)""")
def weekly_rest_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each officer's next fixed rest day and the rests recorded from now on, in order."""
    ahead = leaves(spark, sf_dir).where(F.col("s") > today())
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "id", "kind"))), lambda x: F.concat_ws(" ", x["s"].cast("string"), x["kind"])), "; ")
    rows = ahead.groupBy("person").agg(listed.alias("upcoming"))
    out = _effective(spark, sf_dir).join(rows, "person", "left")
    return out.select("person", "rest_system", dates.next_weekday(today(), F.col("person") % 7).alias("next_fixed"), F.coalesce("upcoming", F.lit("")).alias("upcoming"))


@query(f"""WITH {PEOPLE}, {VERSIONS}, {_REST_DAY}
SELECT person, 'driver' AS kind FROM e WHERE rest_system LIKE '%HIGH%' OR rest_system LIKE '%URGENT%' UNION ALL SELECT s_suppkey, 'conscript' FROM supplier WHERE s_suppkey % 10 = 0""")
def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People on force whose effective post mentions one of two words, and flagged conscripts."""
    told = _effective(spark, sf_dir).where(F.col("rest_system").contains("HIGH") | F.col("rest_system").contains("URGENT"))
    flagged = load(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("person"), F.lit("conscript").alias("kind"))
    return told.select("person", F.lit("driver").alias("kind")).unionByName(flagged)


@query(f"""WITH {PEOPLE}, {ASSIGN} SELECT day, CASE WHEN section = 'A' THEN 'external' ELSE 'internal' END AS kind, count(DISTINCT person) AS n, string_agg(DISTINCT coalesce(name, 'missing'), ',' ORDER BY coalesce(name, 'missing')) AS names
FROM assign LEFT JOIN people USING (person) WHERE service % 3 = 0 AND section <> 'R' GROUP BY 1, 2""")
def mission_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rows in two groups of kinds, with the people's names."""
    flagged = assignments(spark, sf_dir).where("service % 3 = 0 AND section <> 'R'")
    named = flagged.join(people(spark, sf_dir).select("person", "name"), "person", "left")
    kind = F.when(F.col("section") == "A", "external").otherwise("internal")
    return named.groupBy("day", kind.alias("kind")).agg(F.countDistinct("person").alias("n"), F.array_join(F.array_sort(F.collect_set(F.coalesce("name", F.lit("missing")))), ",").alias("names"))


@query(f"""WITH {LEAVES}, l AS (SELECT *, row_number() OVER (PARTITION BY person, kind ORDER BY s DESC, id DESC) AS n FROM leaves)
SELECT person, kind, id, CASE WHEN kind = '5-LOW' THEN 'suspended' WHEN {TODAY} BETWEEN s AND e THEN 'active' WHEN s > {TODAY} THEN 'upcoming' ELSE 'due' END AS status FROM l WHERE n = 1""")
def latest_by_person_and_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's latest leave of each type and how it stands."""
    last = leaves(spark, sf_dir).groupBy("person", "kind").agg(F.max(F.struct("s", "id", "e")).alias("x")).select("person", "kind", "x.*")
    status = F.when(F.col("kind") == "5-LOW", "suspended").when(today().between(F.col("s"), F.col("e")), "active").when(F.col("s") > today(), "upcoming").otherwise("due")
    return last.select("person", "kind", "id", status.alias("status"))


_STATES = f"""n AS (SELECT person, min(s) AS next_leave FROM leaves WHERE s > {TODAY} GROUP BY 1), c AS (SELECT DISTINCT person FROM courses WHERE {TODAY} BETWEEN s AND e), r AS (SELECT DISTINCT person FROM leaves WHERE {TODAY} BETWEEN s AND e),
w AS (SELECT e.person, r.person IS NOT NULL AS resting, next_leave, CASE WHEN rest_system <> '5-LOW' AND c.person IS NULL THEN {TODAY} + CAST((e.person % 7 - (isodow({TODAY}) + 1) % 7 + 6) % 7 + 1 AS INTEGER) END AS weekly FROM e LEFT JOIN n ON n.person = e.person LEFT JOIN c ON c.person = e.person LEFT JOIN r ON r.person = e.person),
st AS (SELECT person, least(next_leave, weekly) AS next_rest, CASE WHEN resting THEN 'resting' WHEN least(next_leave, weekly) IS NULL THEN 'shortfall' WHEN least(next_leave, weekly) <= {TODAY} + 3 THEN 'upcoming' ELSE 'working' END AS state FROM w)"""


def _rest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = today().between(F.col("s"), F.col("e"))
    every = leaves(spark, sf_dir)
    ahead = every.groupBy("person").agg(F.min(F.when(F.col("s") > today(), F.col("s"))).alias("next_leave"), F.bool_or(on).alias("resting"))
    busy = courses(spark, sf_dir).where(on).select("person", F.lit(True).alias("course")).distinct()
    rows = _effective(spark, sf_dir).join(ahead, "person", "left").join(busy, "person", "left")
    weekly = F.when((F.col("rest_system") != "5-LOW") & F.col("course").isNull(), dates.next_weekday(today(), F.col("person") % 7))
    rows = rows.withColumn("next_rest", F.least("next_leave", weekly))
    state = F.when(F.coalesce("resting", F.lit(False)), "resting").when(F.col("next_rest").isNull(), "shortfall").when(F.col("next_rest") <= F.date_add(today(), 3), "upcoming").otherwise("working")
    return rows.select("person", "next_rest", state.alias("state"))


@query(f"WITH {PEOPLE}, {VERSIONS}, {LEAVES}, {COURSES}, {_REST_DAY}, {_STATES} SELECT * FROM st")
def rest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next rest, of recorded ones and the weekly one unless suspended or in a course, and the state now."""
    return _rest_states(spark, sf_dir)


@query(f"WITH {PEOPLE}, {VERSIONS}, {LEAVES}, {COURSES}, {_REST_DAY}, {_STATES} SELECT person, next_rest, state, row_number() OVER (PARTITION BY state ORDER BY next_rest NULLS LAST, person) AS place FROM st WHERE state IN ('shortfall', 'upcoming')")
def rest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of each state by date, numbered over ranges: a state may hold a third of all people."""
    alerts = _rest_states(spark, sf_dir).where(F.col("state").isin("shortfall", "upcoming"))
    return relational.numbered_in_groups(alerts, ["state"], [F.col("next_rest").asc_nulls_last(), F.col("person")], "place")


@query(f"""WITH {PEOPLE}, {LEAVES}
SELECT id, l.person, concat_ws(',', CASE WHEN p.person IS NULL THEN 'unknown person' END, CASE WHEN e < s THEN 'ends before it starts' END, CASE WHEN e - s + 1 > 14 THEN 'too long' END, CASE WHEN s < joined THEN 'before joining' END, CASE WHEN e > left_on THEN 'after leaving' END,
  CASE WHEN EXISTS (SELECT 1 FROM leaves o WHERE o.person = l.person AND o.id <> l.id AND o.s <= l.e AND l.s <= o.e) THEN 'overlaps' END) AS violations FROM leaves l LEFT JOIN people p USING (person)""")
def leave_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each leave row; overlaps are seen from the neighbours in order, not from all pairs."""
    w = Window.partitionBy("person").orderBy("s", "e", "id")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("s").over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = leaves(spark, sf_dir).withColumn("overlaps", F.coalesce(before >= F.col("s"), F.lit(False)) | F.coalesce(after <= F.col("e"), F.lit(False)))
    rows = rows.join(people(spark, sf_dir).withColumn("known", F.lit(True)), "person", "left")
    found = [(F.col("known").isNull(), "unknown person"), (F.col("e") < F.col("s"), "ends before it starts"), (F.datediff("e", "s") + 1 > 14, "too long"), (F.col("s") < F.col("joined"), "before joining"), (F.col("e") > F.col("left_on"), "after leaving"), (F.col("overlaps"), "overlaps")]
    return rows.select("id", "person", F.concat_ws(",", *[F.when(c, label) for c, label in found]).alias("violations"))


@query(f"""WITH {LEAVES} SELECT id, person, s, CASE WHEN kind IN ('3-MEDIUM', '5-LOW') AND s <= {TODAY} AND e > {TODAY} THEN {TODAY} ELSE e END AS e, CASE WHEN kind NOT IN ('3-MEDIUM', '5-LOW') OR e <= {TODAY} THEN 'kept' WHEN s > {TODAY} THEN 'cancelled' ELSE 'trimmed' END AS outcome, e AS restored_end FROM leaves""")
def suspended_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of suspended types: future ones cancelled, running ones trimmed to today; their end for a restore."""
    stopped = F.col("kind").isin("3-MEDIUM", "5-LOW") & (F.col("e") > today())
    outcome = F.when(~stopped, "kept").when(F.col("s") > today(), "cancelled").otherwise("trimmed")
    return leaves(spark, sf_dir).select("id", "person", "s", F.when(outcome == "trimmed", today()).otherwise(F.col("e")).alias("e"), outcome.alias("outcome"), F.col("e").alias("restored_end"))


@query(f"""WITH {LEAVES}, h AS (SELECT id, person, kind, s, e, CASE WHEN id % 4 = 0 THEN e ELSE e + 1 END AS recorded FROM leaves WHERE kind IN ('3-MEDIUM', '5-LOW'))
SELECT id, person, CASE WHEN EXISTS (SELECT 1 FROM leaves o WHERE o.person = h.person AND o.id <> h.id AND o.kind = h.kind AND o.s <= h.e AND h.s <= o.e) THEN 'overlaps' WHEN recorded <> e THEN 'changed since' ELSE 'restored' END AS verdict FROM h""")
def guarded_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped leaves come back unless their row has changed since or another of the type now overlaps."""
    w = Window.partitionBy("person", "kind").orderBy("s", "e", "id")
    before, after = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.min("s").over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = leaves(spark, sf_dir).where("kind IN ('3-MEDIUM', '5-LOW')").withColumn("overlaps", F.coalesce(before >= F.col("s"), F.lit(False)) | F.coalesce(after <= F.col("e"), F.lit(False)))
    verdict = F.when(F.col("overlaps"), "overlaps").when(F.col("id") % 4 != 0, "changed since").otherwise("restored")
    return rows.select("id", "person", verdict.alias("verdict"))


@query(f"""WITH {PEOPLE}, {ASSIGN}, {LEAVES}
SELECT a.person, a.day, count(*) AS n, bool_or(p.person IS NULL) AS unknown, bool_or(day < joined OR day > left_on) AS off_force, bool_or(service % 500 = 0) AS without_service, bool_or(l.person IS NOT NULL) AS on_leave
FROM assign a LEFT JOIN (SELECT * FROM people WHERE person % 50 <> 7) p USING (person) LEFT JOIN (SELECT DISTINCT person, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS day FROM leaves) l USING (person, day) GROUP BY 1, 2
HAVING bool_or(p.person IS NULL) OR bool_or(coalesce(day < joined OR day > left_on, day < joined)) OR bool_or(service % 500 = 0) OR bool_or(l.person IS NOT NULL)""")
def assignment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments that an upsert would refuse, by person and day."""
    a = assignments(spark, sf_dir)
    rested = _held(a.select("person", "day").distinct(), leaves(spark, sf_dir), F.lit(True), "on_leave")
    register = people(spark, sf_dir).where("person % 50 <> 7")  # some people of the lines are not in it
    rows = a.join(register.withColumn("known", F.lit(True)), "person", "left").join(rested, ["person", "day"], "left")
    off = (F.col("day") < F.col("joined")) | (F.col("day") > F.col("left_on"))
    sums = rows.groupBy("person", "day").agg(F.count("*").alias("n"), F.bool_or(F.col("known").isNull()).alias("unknown"), F.bool_or(off).alias("off_force"), F.bool_or(F.col("service") % 500 == 0).alias("without_service"), F.bool_or(F.col("on_leave").isNotNull()).alias("on_leave"))
    return sums.where(F.col("unknown") | F.coalesce("off_force", F.lit(False)) | F.col("without_service") | F.col("on_leave"))


@query(f"""WITH {PEOPLE}, {ASSIGN} SELECT day, section, shift, coalesce(string_agg(CASE WHEN joined <= day AND (left_on IS NULL OR day <= left_on) THEN CAST(person AS VARCHAR) END, ',' ORDER BY person), '') AS kept, count(*) FILTER (joined > day OR day > left_on) AS dropped FROM (SELECT DISTINCT person, day, section, shift FROM assign) JOIN people USING (person) GROUP BY 1, 2, 3""")
def detached_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People not on force that day are taken out of a row's list; how many went."""
    rows = assignments(spark, sf_dir).select("person", "day", "section", "shift").distinct().join(people(spark, sf_dir), "person")
    inside = on_force(F.col("day"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.col("person")))), lambda x: x.cast("string")), ",")
    gone = F.count_if((F.col("joined") > F.col("day")) | (F.col("day") > F.col("left_on")))
    return rows.groupBy("day", "section", "shift").agg(listed.alias("kept"), gone.alias("dropped"))


@query(f"""WITH {PEOPLE} SELECT person, CASE WHEN left_on IS NULL THEN row_number() OVER (PARTITION BY rank, left_on IS NULL ORDER BY name) ELSE row_number() OVER (PARTITION BY rank, left_on IS NULL ORDER BY left_on DESC, name) END AS place, rank, left_on IS NOT NULL AS archived FROM people""")
def roster_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: the active block by rank and name, the archived one by the day of leaving, latest first."""
    rows = people(spark, sf_dir).withColumn("archived", F.col("left_on").isNotNull())
    placed = relational.numbered_in_groups(rows, ["rank", "archived"], [F.desc("left_on"), F.col("name"), F.col("person")], "place")
    return placed.select("person", "place", "rank", "archived")


@query(f"""WITH {PEOPLE}, {ASSIGN} SELECT d.day, d.section, x.role, CASE x.role WHEN 'configured' THEN min(CASE WHEN rank = 0 THEN person END) WHEN 'shared' THEN min(CASE WHEN rank <= 2 THEN person END) ELSE min(person) END AS candidate, coalesce(min(CASE WHEN rank = 0 THEN person END), min(CASE WHEN rank <= 2 THEN person END), min(person)) AS signer
FROM (SELECT DISTINCT day, section, person FROM assign) d JOIN people USING (person) CROSS JOIN (VALUES ('configured'), ('shared'), ('first')) x(role) GROUP BY 1, 2, 3""")
def signers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who signs: the configured one, else a shared one, else the first who is there."""
    rows = assignments(spark, sf_dir).select("day", "section", "person").distinct().join(people(spark, sf_dir), "person")
    best = rows.groupBy("day", "section").agg(F.min(F.when(F.col("rank") == 0, F.col("person"))).alias("configured"), F.min(F.when(F.col("rank") <= 2, F.col("person"))).alias("shared"), F.min("person").alias("first"))
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("candidate")) for r in ("configured", "shared", "first")]))
    return best.select("day", "section", F.coalesce("configured", "shared", "first").alias("signer"), roles.alias("x")).select("day", "section", "x.role", "x.candidate", "signer")


@query(f"""WITH {ASSIGN}, g AS (SELECT day, section, shift, count(*) AS n, count(DISTINCT person) AS strength, min(service) AS place FROM assign GROUP BY 1, 2, 3)
SELECT day, section, shift, concat_ws(', ', 'strength ' || strength, CASE shift WHEN 'morning' THEN 'from 08:00' ELSE 'from 20:00' END, CASE WHEN place % 2 = 0 THEN 'at post ' || place END) AS text FROM g""")
def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of a service order: strength, time and, where given, place."""
    g = assignments(spark, sf_dir).groupBy("day", "section", "shift").agg(F.countDistinct("person").alias("strength"), F.min("service").alias("place"))
    parts = [F.concat(F.lit("strength "), F.col("strength")), F.when(F.col("shift") == "morning", "from 08:00").otherwise("from 20:00"), F.when(F.col("place") % 2 == 0, F.concat(F.lit("at post "), F.col("place")))]
    return g.select("day", "section", "shift", F.concat_ws(", ", *parts).alias("text"))


@query(f"""WITH {ASSIGN}, {LEAVES}, a AS (SELECT day, count(*) AS rows, count(DISTINCT person) AS people FROM assign GROUP BY 1), l AS (SELECT s AS day, count(*) AS leaves FROM leaves GROUP BY 1)
SELECT coalesce(a.day, l.day) AS day, coalesce(rows, 0) AS rows, coalesce(people, 0) AS people, coalesce(leaves, 0) AS leaves, '{{"rows":' || coalesce(rows, 0) || ',"people":' || coalesce(people, 0) || ',"leaves":' || coalesce(leaves, 0) || '}}' AS payload FROM a FULL JOIN l ON a.day = l.day""")
def day_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a day holds, as one document."""
    a = assignments(spark, sf_dir).groupBy("day").agg(F.count("*").alias("rows"), F.countDistinct("person").alias("people"))
    started = leaves(spark, sf_dir).groupBy(F.col("s").alias("day")).agg(F.count("*").alias("leaves"))
    both = a.join(started, "day", "full").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "people", "leaves")])
    return both.withColumn("payload", F.to_json(F.struct("rows", "people", "leaves")))


@query(f"""WITH {LEAVES}, {COURSES}, x AS (SELECT person, 'leave' AS what, s AS day FROM leaves UNION ALL SELECT person, 'return', e + 1 FROM leaves UNION ALL SELECT person, 'course', s FROM courses)
SELECT day, what, count(*) AS n, string_agg(CAST(person AS VARCHAR), ',' ORDER BY person) AS people FROM x WHERE day BETWEEN {TODAY} AND {TODAY} + 3 GROUP BY 1, 2""")
def horizon_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who starts a leave, comes back or starts a course within three days."""
    l, c = leaves(spark, sf_dir), courses(spark, sf_dir)  # noqa: E741
    rows = l.select("person", F.lit("leave").alias("what"), F.col("s").alias("day")).unionAll(l.select("person", F.lit("return"), F.date_add("e", 1))).unionAll(c.select("person", F.lit("course"), "s"))
    near = rows.where(F.col("day").between(today(), F.date_add(today(), 3)))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("person")), lambda x: x.cast("string")), ",")
    return near.groupBy("day", "what").agg(F.count("*").alias("n"), listed.alias("people"))


@query(f"""WITH {ASSIGN}, s AS (SELECT day, section, shift, count(*) AS n, row_number() OVER (PARTITION BY day ORDER BY section, shift) AS place FROM assign GROUP BY 1, 2, 3)
SELECT day, section, shift, n, place, CAST(sum(n) OVER (PARTITION BY day) AS BIGINT) AS day_total, CAST(sum(n) OVER (PARTITION BY day, section) AS BIGINT) AS section_total FROM s""")
def roster_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered sheet of a day's groups with their totals; a day has six groups at most."""
    g = assignments(spark, sf_dir).groupBy("day", "section", "shift").agg(F.count("*").alias("n"))
    day = Window.partitionBy("day")
    return g.withColumns({"place": F.row_number().over(day.orderBy("section", "shift")).cast("bigint"), "day_total": F.sum("n").over(day), "section_total": F.sum("n").over(Window.partitionBy("day", "section"))})
