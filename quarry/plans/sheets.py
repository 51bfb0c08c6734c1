"""Sheets with inheritance, templates, run states, plans of changes, totals: one query for each report or step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import dates
from quarry.operators import classify, graph, relational
from quarry.plans.domain import LEAVES, events, leaves, load
from quarry.plans.registry import query
from quarry.plans.staff import ASSIGN, PEOPLE, TODAY, assignments, people, today

_FLAT = "g AS (SELECT user_id AS person, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'purchase' THEN props END) AS note, max(CASE WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR) END) AS car, count(*) AS n FROM events GROUP BY 1, 2)"


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's sheet: sparse fields of each person."""
    e = load(spark, sf_dir, "events")
    note, car = F.when(F.col("event_type") == "purchase", F.col("props")), F.when(F.col("event_type") == "click", F.col("event_id").cast("string"))
    return e.groupBy(F.col("user_id").alias("person"), F.col("ts").cast("date").alias("day")).agg(F.max(note).alias("note"), F.max(car).alias("car"), F.count("*").alias("n"))


def _ids(c: Column) -> Column:
    """Sorted numbers joined by commas."""
    return F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")


@query(f"""WITH {_FLAT} SELECT s.person, s.day, coalesce(s.note, p.note, CASE WHEN s.person % 2 = 0 THEN 'default' END, '') AS note, CASE WHEN s.note IS NOT NULL THEN 'today' WHEN p.note IS NOT NULL THEN 'previous day' WHEN s.person % 2 = 0 THEN 'default' ELSE 'blank' END AS source FROM g s LEFT JOIN g p ON p.person = s.person AND p.day = s.day - 1""")
def carry_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field from today, else the previous day, else the defaults, else blank, and which it was."""
    s = _flat(spark, sf_dir)
    before = s.select("person", F.date_add("day", 1).alias("day"), F.col("note").alias("previous"))
    default = F.when(F.col("person") % 2 == 0, "default")
    source = classify.ladder([(F.col("note").isNotNull(), "today"), (F.col("previous").isNotNull(), "previous day"), (default.isNotNull(), "default")], "blank")
    return s.join(before, ["person", "day"], "left").select("person", "day", F.coalesce("note", "previous", default, F.lit("")).alias("note"), source.alias("source"))


@query(f"""WITH {_FLAT} SELECT s.person, s.day, max(CASE WHEN p.day < DATE '2024-01-15' THEN p.day END) AS last_before, count(p.day) AS seen,
  CASE WHEN max(CASE WHEN p.day < DATE '2024-01-15' THEN p.day END) IS NULL THEN coalesce(string_agg(CAST(p.day AS VARCHAR), ',' ORDER BY p.day), '') ELSE CAST(max(CASE WHEN p.day < DATE '2024-01-15' THEN p.day END) AS VARCHAR) END AS taken
FROM g s LEFT JOIN g p ON p.person = s.person AND p.day < s.day AND p.day >= s.day - 31 GROUP BY 1, 2""")
def cutover_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the prior 31 days the last one before the cutover, else all of them."""
    w = Window.partitionBy("person").orderBy(F.datediff("day", F.lit("2024-01-01"))).rangeBetween(-31, -1)
    early = F.when(F.col("day") < F.lit("2024-01-15").cast("date"), F.col("day"))
    rows = _flat(spark, sf_dir).select("person", "day", F.max(early).over(w).alias("last_before"), F.count("*").over(w).alias("seen"), F.collect_list("day").over(w).alias("days"))
    listed = F.array_join(F.transform(F.array_sort("days"), lambda x: x.cast("string")), ",")
    return rows.select("person", "day", "last_before", "seen", F.when(F.col("last_before").isNull(), listed).otherwise(F.col("last_before").cast("string")).alias("taken"))


@query(f"""WITH {_FLAT}, c AS (SELECT s.person, s.day, s.n, coalesce(s.car, (SELECT arg_max(p.car, p.day) FROM g p WHERE p.person = s.person AND p.car IS NOT NULL AND p.day < s.day AND p.day >= s.day - 7)) AS car, s.car IS NULL AS inherited FROM g s)
SELECT c.person, c.day, coalesce(name, 'missing') AS name, CAST(c.person % 5 AS INTEGER) AS section, row_number() OVER (PARTITION BY c.day, c.person % 5 ORDER BY c.person) AS place, coalesce(car, '') AS car, inherited AND car IS NOT NULL AS inherited,
  CASE WHEN car IS NULL AND n < 2 THEN 'empty' WHEN car IS NULL OR n < 2 THEN 'partial' ELSE 'complete' END AS state, concat_ws(',', CASE WHEN car IS NULL THEN 'car' END, CASE WHEN n < 2 THEN 'second row' END) AS missing, count(*) OVER (PARTITION BY c.day, c.person % 5) AS group_size
FROM c LEFT JOIN (SELECT c_custkey, c_name AS name FROM customer) ON c_custkey = c.person""")
def campaign_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet of each day: inherited fields, names, places in groups, state and what is missing."""
    back = F.last("car", ignorenulls=True).over(Window.partitionBy("person").orderBy(F.datediff("day", F.lit("2024-01-01"))).rangeBetween(-7, -1))
    rows = _flat(spark, sf_dir).withColumn("inherited", F.col("car").isNull()).withColumn("car", F.coalesce("car", back))
    names = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"))
    group = Window.partitionBy("day", "section")
    lacking = F.concat_ws(",", F.when(F.col("car").isNull(), "car"), F.when(F.col("n") < 2, "second row"))
    full = rows.join(names, "person", "left").withColumn("section", (F.col("person") % 5).cast("int"))
    state = F.when(lacking == "", "complete").when(lacking == "car,second row", "empty").otherwise("partial")
    return full.select(
        "person", "day", F.coalesce("name", F.lit("missing")).alias("name"), "section", F.row_number().over(group.orderBy("person")).cast("bigint").alias("place"), F.coalesce("car", F.lit("")).alias("car"), (F.col("inherited") & F.col("car").isNotNull()).alias("inherited"),
        state.alias("state"), lacking.alias("missing"), F.count("*").over(group).alias("group_size"),
    )


@query(f"""WITH {ASSIGN}, v AS (SELECT day, section, service, list(DISTINCT person ORDER BY person) AS crew FROM assign GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY day, section ORDER BY service) AS k FROM v),
free AS (SELECT day, section, string_agg(CAST(person AS VARCHAR), ',' ORDER BY person) AS extra FROM (SELECT DISTINCT day, section, person FROM assign WHERE person % 9 = 0) GROUP BY 1, 2)
SELECT r.day, r.section, service, CAST(len(crew) AS INTEGER) AS crew_size, CASE WHEN k = 1 THEN coalesce(extra, '') ELSE '' END AS attached, len(crew) > 1 AS crowded FROM r LEFT JOIN free USING (day, section)""")
def regularity_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vehicle; people without one attach to the first vehicle that has a crew; a warning."""
    a = assignments(spark, sf_dir)
    v = a.groupBy("day", "section", "service").agg(F.countDistinct("person").cast("int").alias("crew_size"))
    free = a.where("person % 9 = 0").groupBy("day", "section").agg(_ids(F.collect_set("person")).alias("extra"))
    first = v.groupBy("day", "section").agg(F.min("service").alias("first"))
    rows = v.join(first, ["day", "section"]).join(free, ["day", "section"], "left")
    return rows.select("day", "section", "service", "crew_size", F.when(F.col("service") == F.col("first"), F.coalesce("extra", F.lit(""))).otherwise("").alias("attached"), (F.col("crew_size") > 1).alias("crowded"))


@query(f"""WITH {ASSIGN} SELECT day, section, shift, greatest(count(*) - count(*) FILTER (service % 4 = 0), 1) AS slots, count(DISTINCT person) AS people, printf('%02d:%02d', CASE shift WHEN 'morning' THEN 8 ELSE 20 END, min(service) % 60) AS time,
  CAST(CASE shift WHEN 'morning' THEN 480 ELSE 1200 END + min(service) % 60 AS INTEGER) AS minutes FROM assign GROUP BY 1, 2, 3""")
def formation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a formation: slots (one at least), people, time and its minutes for the order."""
    g = assignments(spark, sf_dir).groupBy("day", "section", "shift").agg(F.greatest(F.count("*") - F.count_if(F.col("service") % 4 == 0), F.lit(1)).alias("slots"), F.countDistinct("person").alias("people"), (F.min("service") % 60).cast("int").alias("m"))
    hour = F.when(F.col("shift") == "morning", 8).otherwise(20)
    return g.select("day", "section", "shift", "slots", "people", F.format_string("%02d:%02d", hour, F.col("m")).alias("time"), (hour * 60 + F.col("m")).alias("minutes"))


@query("""WITH p AS (SELECT p_brand, p_type, CASE WHEN p_name LIKE 'small %' THEN substr(p_name, 7) ELSE p_name END AS meal, p_size FROM part) SELECT p_brand, meal, CAST(sum(p_size) AS BIGINT) AS total, count(*) AS orders, count(DISTINCT p_type) AS kinds, min(p_type) AS candidate FROM p GROUP BY 1, 2""")
def meal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of equivalent orders, and each candidate once."""
    meal = F.regexp_replace("p_name", "^small ", "")
    return load(spark, sf_dir, "part").groupBy("p_brand", meal.alias("meal")).agg(F.sum("p_size").alias("total"), F.count("*").alias("orders"), F.countDistinct("p_type").alias("kinds"), F.min("p_type").alias("candidate"))


_RUNS = "runs AS (SELECT o_orderkey AS id, o_custkey AS line, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'back' WHEN 'O' THEN 'out' ELSE '' END AS mark FROM orders)"


@query(f"""WITH {_RUNS}, s AS (SELECT *, CASE WHEN mark <> '' THEN mark WHEN day > {TODAY} THEN 'upcoming' ELSE 'fixed' END AS state FROM runs)
SELECT id, line, state, CASE WHEN state = 'upcoming' AND day <= {TODAY} + 1 THEN 'prepare' WHEN state = 'out' AND day < {TODAY} - 3 THEN 'late' ELSE '' END AS hint, state = 'out' AND day BETWEEN {TODAY} - 3 AND {TODAY} - 1 AS carried,
  count(*) FILTER (state = 'out') OVER (PARTITION BY line) AS line_out, min(CASE WHEN day > {TODAY} THEN day END) OVER (PARTITION BY line) AS next_run FROM s""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: each run's state relative to now, hints, runs carried over three days, the line's next run and counter."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("line"), F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus")
    state = classify.ladder([(F.col("o_orderstatus") == "F", "back"), (F.col("o_orderstatus") == "O", "out"), (F.col("day") > today(), "upcoming")], "fixed")
    s = o.withColumn("state", state)
    out, line = F.col("state") == "out", Window.partitionBy("line")
    hint = classify.ladder([((F.col("state") == "upcoming") & (F.col("day") <= F.date_add(today(), 1)), "prepare"), (out & (F.col("day") < F.date_add(today(), -3)), "late")], "")
    carried = out & F.col("day").between(F.date_add(today(), -3), F.date_add(today(), -1))
    return s.select("id", "line", "state", hint.alias("hint"), carried.alias("carried"), F.count_if(out).over(line).alias("line_out"), F.min(F.when(F.col("day") > today(), F.col("day"))).over(line).alias("next_run"))


@query("SELECT user_id AS key, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS state, max(ts) AS since, count(*) AS transitions, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS reverted FROM events GROUP BY 1")
def folded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: each key's state is that of its last transition."""
    e = load(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("since"), F.count("*").alias("transitions"), F.count_if(F.col("event_type") == "error").alias("reverted"))


@query(f"""WITH {LEAVES}, b AS (SELECT id, kind FROM leaves WHERE s >= {TODAY} - 60 AND s <= {TODAY}), n AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'x' ELSE kind END AS kind FROM leaves WHERE s <= {TODAY} AND s >= {TODAY} - 50)
SELECT coalesce(b.id, n.id) AS id, CASE WHEN b.id IS NULL THEN 'create' WHEN n.id IS NULL THEN 'expire' ELSE 'update' END AS event, coalesce(b.kind, '') AS before, coalesce(n.kind, '') AS after FROM b FULL JOIN n ON b.id = n.id WHERE b.kind IS DISTINCT FROM n.kind""")
def baseline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7: what differs from a baseline that is kept for sixty days; rows past their retention expire."""
    rows = leaves(spark, sf_dir).where(F.col("s") <= today())
    base = rows.where(F.col("s") >= F.date_add(today(), -60)).select("id", F.col("kind").alias("before"))
    now = rows.where(F.col("s") >= F.date_add(today(), -50)).select("id", F.when(F.col("id") % 10 == 0, "x").otherwise(F.col("kind")).alias("after"))
    both = base.join(now, "id", "full").where(~F.col("before").eqNullSafe(F.col("after")))
    event = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "expire").otherwise("update")
    return both.select("id", event.alias("event"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))


@query(f"""WITH {PEOPLE}, d AS (SELECT {TODAY} + CAST(unnest(range(0, 8)) AS INTEGER) AS day), m AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 50 = 0)
SELECT person, d.day, CASE WHEN d.day = {TODAY} THEN 'written' ELSE 'preview' END AS kind FROM people JOIN d ON person % 7 = (isodow(d.day) + 1) % 7 WHERE joined <= d.day AND (left_on IS NULL OR d.day <= left_on) AND d.day NOT IN (SELECT day FROM m)""")
def fixed_rest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8: weekly rests written once a day (marked days are done) and previewed for the next seven."""
    days = spark.range(8).select(F.date_add(today(), F.col("id").cast("int")).alias("day")).withColumn("weekday", dates.weekday_index(F.col("day")).cast("bigint"))
    marked = load(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    open_days = days.join(marked, "day", "left_anti")
    rows = people(spark, sf_dir).withColumn("weekday", F.col("person") % 7).join(F.broadcast(open_days), "weekday")
    force = (F.col("joined") <= F.col("day")) & (F.col("left_on").isNull() | (F.col("day") <= F.col("left_on")))
    return rows.where(force).select("person", "day", F.when(F.col("day") == today(), "written").otherwise("preview").alias("kind"))


@query(f"""WITH {PEOPLE}, {ASSIGN}, {LEAVES}, a AS (SELECT DISTINCT person, day, section, shift FROM assign), rest AS (SELECT DISTINCT person, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS day FROM leaves)
SELECT a.person, a.day + 1 AS day, a.section, a.shift FROM a JOIN people p USING (person) WHERE a.shift = 'morning' AND joined <= a.day + 1 AND (left_on IS NULL OR a.day + 1 <= left_on)
  AND NOT EXISTS (SELECT 1 FROM rest r WHERE r.person = a.person AND r.day = a.day + 1) AND NOT EXISTS (SELECT 1 FROM a b WHERE b.person = a.person AND b.day = a.day + 1)""")
def copied_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9, Z3: yesterday's confirmed rows, once each, of people who may serve and have nothing written yet."""
    a = assignments(spark, sf_dir).select("person", "day", "section", "shift").distinct()
    copied = a.where("shift = 'morning'").withColumn("day", F.date_add("day", 1)).join(people(spark, sf_dir).select("person", "joined", "left_on"), "person")
    copied = copied.where((F.col("joined") <= F.col("day")) & (F.col("left_on").isNull() | (F.col("day") <= F.col("left_on"))))
    rest = leaves(spark, sf_dir).select("person", F.explode(F.sequence("s", "e")).alias("day")).distinct()
    return copied.join(rest, ["person", "day"], "left_anti").join(a.select("person", "day").distinct(), ["person", "day"], "left_anti").select("person", "day", "section", "shift")


@query(f"""WITH {ASSIGN}, d AS (SELECT DISTINCT day FROM assign), t AS (SELECT n_nationkey AS template, n_name AS name, n_nationkey % 7 AS weekday FROM nation) SELECT d.day, template, name FROM d JOIN t ON t.weekday = (isodow(d.day) + 1) % 7 WHERE NOT EXISTS (SELECT 1 FROM assign a WHERE a.day = d.day AND a.service % 100 = 0)""")
def weekday_template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10, X9: the rows of a weekday's template, for days that are not marked yet."""
    a = assignments(spark, sf_dir)
    days = a.select("day").distinct().join(a.where("service % 100 = 0").select("day").distinct(), "day", "left_anti").withColumn("weekday", dates.weekday_index(F.col("day")))
    templates = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("template"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 7).alias("weekday"))
    return days.join(F.broadcast(templates), "weekday").select("day", "template", "name")


@query("""WITH h AS (SELECT o_custkey AS owner, max(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END) AS stored, max(CASE WHEN o_orderstatus = 'P' THEN o_orderdate END) AS changed FROM orders GROUP BY 1)
SELECT owner, CASE WHEN stored IS NOT NULL AND (changed IS NULL OR stored > changed) THEN 'stored sheet' ELSE 'template' END AS source, CAST(greatest(coalesce(stored, changed), coalesce(changed, stored)) AS DATE) AS since FROM h""")
def starting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day starts from the last stored sheet if that is newer than the template's last change."""
    stored, changed = F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")))
    h = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(stored.alias("stored"), changed.alias("changed"))
    newer = F.col("stored").isNotNull() & (F.col("changed").isNull() | (F.col("stored") > F.col("changed")))
    return h.select("owner", F.when(newer, "stored sheet").otherwise("template").alias("source"), F.greatest("stored", "changed").cast("date").alias("since"))


@query("SELECT p_partkey, p_name, CASE WHEN p_size % 6 = 0 THEN 0 ELSE p_size END AS n, p_size % 6 = 0 AS needs_count, CASE WHEN p_size < 12 THEN 'morning' WHEN p_size < 24 THEN 'night' ELSE 'morning' END AS shift, CASE WHEN p_size < 24 THEN 'from time' ELSE 'default' END AS rule FROM part")
def needs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that still need a count, and a shift from the time or else the default, with the rule that gave it."""
    size = F.col("p_size")
    n = F.when(size % 6 == 0, 0).otherwise(size)
    return load(spark, sf_dir, "part").select("p_partkey", "p_name", n.alias("n"), (n <= 0).alias("needs_count"), F.when(size < 12, "morning").when(size < 24, "night").otherwise("morning").alias("shift"), F.when(size < 24, "from time").otherwise("default").alias("rule"))


@query("""WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS first_id, min(p_size) AS since FROM part GROUP BY 1, 2) SELECT p_brand, p_name, first_id, since, row_number() OVER (PARTITION BY p_brand ORDER BY since, p_name) AS place, count(*) OVER (PARTITION BY p_brand) AS known FROM f""")
def list_with_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list as of now, each name under the id it had first; the union of all its versions."""
    f = load(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("first_id"), F.min("p_size").alias("since"))
    brand = Window.partitionBy("p_brand")
    return f.withColumns({"place": F.row_number().over(brand.orderBy("since", "p_name")).cast("bigint"), "known": F.count("*").over(brand)})


@query("""WITH l AS (SELECT *, CAST(list_position(['SMALL', 'PROMO', 'LARGE'], p_type) AS INTEGER) AS declared FROM part), g AS (SELECT p_type, p_brand, count(*) AS runs, max(CASE WHEN p_size > 45 THEN p_size END) AS override FROM l WHERE declared IS NOT NULL GROUP BY 1, 2)
SELECT l.p_partkey, l.p_type, declared, runs, coalesce(override, p_size) AS time, override IS NOT NULL AS overridden FROM l JOIN g USING (p_type, p_brand)""")
def service_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by line in the declared order; an override of the time holds for all runs of the line."""
    p = load(spark, sf_dir, "part").withColumn("declared", F.array_position(F.array(F.lit("SMALL"), F.lit("PROMO"), F.lit("LARGE")), F.col("p_type")).cast("int")).where("declared > 0")
    g = p.groupBy("p_type", "p_brand").agg(F.count("*").alias("runs"), F.max(F.when(F.col("p_size") > 45, F.col("p_size"))).alias("override"))
    return p.join(g, ["p_type", "p_brand"]).select("p_partkey", "p_type", "declared", "runs", F.coalesce("override", "p_size").alias("time"), F.col("override").isNotNull().alias("overridden"))


@query(f"""WITH {LEAVES} SELECT id, kind IN ('1-URGENT', '2-HIGH') AS continuous, kind NOT IN ('1-URGENT', '2-HIGH') AS bounded, id % 6 = 0 AS open, s < DATE '1996-01-01' AS legacy, concat_ws(', ', CASE WHEN kind IN ('1-URGENT', '2-HIGH') THEN 'continuous' ELSE 'bounded' END, CASE WHEN id % 6 = 0 THEN 'open since ' || s END, CASE WHEN s < DATE '1996-01-01' THEN 'legacy' END) AS label FROM leaves""")
def period_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of period each is, and its label."""
    going, open_yet, legacy = F.col("kind").isin("1-URGENT", "2-HIGH"), F.col("id") % 6 == 0, F.col("s") < F.lit("1996-01-01").cast("date")
    label = F.concat_ws(", ", F.when(going, "continuous").otherwise("bounded"), F.when(open_yet, F.concat(F.lit("open since "), F.col("s").cast("string"))), F.when(legacy, "legacy"))
    return leaves(spark, sf_dir).select("id", going.alias("continuous"), (~going).alias("bounded"), open_yet.alias("open"), legacy.alias("legacy"), label.alias("label"))


_ROSTERS = "old AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS post FROM customer WHERE c_custkey % 10 <> 3), new AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 8 = 1 THEN 'MOVED' ELSE c_mktsegment END AS post FROM customer WHERE c_custkey % 10 <> 7), m AS (SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.post <> n.post THEN 'changed' ELSE 'matched' END AS outcome FROM new n FULL JOIN old o ON n.name = o.name)"


def _merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    old = c.where(key % 10 != 3).select(key.alias("old_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("old_post"))
    new = c.where(key % 10 != 7).select(key.alias("new_id"), F.col("c_name").alias("name"), F.when(key % 8 == 1, "MOVED").otherwise(F.col("c_mktsegment")).alias("post"))
    outcome = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").when(F.col("old_post") != F.col("post"), "changed").otherwise("matched")
    return old.join(new, "name", "full").select(F.coalesce("new_id", "old_id").alias("id"), outcome.alias("outcome"))


@query(f"WITH {_ROSTERS} SELECT id, outcome FROM m")
def roster_merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each row when a roster is read again."""
    return _merge_plan(spark, sf_dir)


@query(f"WITH {_ROSTERS} SELECT outcome, count(*) AS n, min(id) AS first_id FROM m GROUP BY 1")
def roster_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows matched, changed, came or went."""
    return _merge_plan(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""WITH o AS (SELECT user_id AS person, CAST(ts AS DATE) AS day, event_type AS name, count(*) AS n FROM events GROUP BY 1, 2, 3), c AS (SELECT person, name, sum(n) AS n FROM o GROUP BY 1, 2), d AS (SELECT person, day, arg_max(name, struct_pack(n := n, x := name)) AS name FROM o GROUP BY 1, 2), p AS (SELECT *, lag(name) OVER (PARTITION BY person ORDER BY day) AS before FROM d)
SELECT p.person, min(day) AS first_seen, max(day) AS last_seen, min(u.usual) AS usual, count(*) FILTER (before IS DISTINCT FROM p.name) AS changes, string_agg(CASE WHEN before IS DISTINCT FROM p.name THEN day || ' ' || p.name END, ';' ORDER BY day) AS history
FROM p JOIN (SELECT person, arg_max(name, struct_pack(n := n, x := name)) AS usual FROM c GROUP BY 1) u ON u.person = p.person GROUP BY 1""")
def person_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day observations as spans: first and last seen, the usual name, and the history of its changes."""
    o = events(spark, sf_dir).groupBy("person", "day", F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    usual = o.groupBy("person", "name").agg(F.sum("n").alias("n")).groupBy("person").agg(F.max_by("name", F.struct("n", "name")).alias("usual"))
    d = o.groupBy("person", "day").agg(F.max_by("name", F.struct("n", "name")).alias("name"))
    changed = ~F.col("name").eqNullSafe(F.lag("name").over(Window.partitionBy("person").orderBy("day")))
    at = F.when(F.col("changed"), F.struct("day", F.concat_ws(" ", F.col("day").cast("string"), "name").alias("x")))
    history = F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["x"]), ";")
    spans = d.withColumn("changed", changed).groupBy("person").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count_if("changed").alias("changes"), history.alias("history"))
    return spans.join(usual, "person")


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_size % 10 > 0 THEN list_distinct(list_filter([p_name || '=1', CASE WHEN p_size % 4 = 0 THEN '=' ELSE p_type || '=' END || (p_size % 2 + 1), p_name || '=1', p_name || '=2'], lambda x: x[1] <> '=')) END AS clean FROM part)
SELECT p_partkey, clean IS NOT NULL AS ok, CAST(coalesce(len(clean), 0) AS INTEGER) AS n, list_aggregate(list_sort(clean), 'string_agg', ',') AS clean FROM e""")
def cleaned_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of structs without those of a blank name and without repeats; a null one is told apart from an empty one."""
    entry = lambda name, n: F.struct(name.alias("name"), n.alias("n"))
    size, name = F.col("p_size"), F.col("p_name")
    raw = F.array(entry(name, F.lit(1)), entry(F.when(size % 4 == 0, "").otherwise(F.col("p_type")), (size % 2 + 1).cast("int")), entry(name, F.lit(1)), entry(name, F.lit(2)))
    clean = F.when(size % 10 > 0, F.array_distinct(F.filter(raw, lambda x: x["name"] != "")))
    told = F.array_join(F.array_sort(F.transform(clean, lambda x: F.concat_ws("=", x["name"], x["n"].cast("string")))), ",")
    return load(spark, sf_dir, "part").select("p_partkey", clean.isNotNull().alias("ok"), F.when(clean.isNull(), 0).otherwise(F.size(clean)).alias("n"), told.alias("clean"))


_FAMILIES = "(VALUES ('P', 'external', 'work'), ('F', NULL, 'rest'), ('O', 'internal', 'work')) f(bucket, label, family)"


@query(f"SELECT o_orderkey, coalesce(o_orderstatus || left(o_orderpriority, 1), '?') AS code, coalesce(label, 'other ' || o_orderstatus) AS label, coalesce(family, 'outside') AS family FROM orders LEFT JOIN {_FAMILIES} ON bucket = o_orderstatus")
def register_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, label and family of a bucket by a small table, with fallbacks for what it lacks."""
    table = spark.sql(f"SELECT * FROM {_FAMILIES}")
    rows = load(spark, sf_dir, "orders").join(F.broadcast(table), F.col("bucket") == F.col("o_orderstatus"), "left")
    return rows.select("o_orderkey", F.concat("o_orderstatus", F.left("o_orderpriority", F.lit(1))).alias("code"), F.coalesce("label", F.concat(F.lit("other "), "o_orderstatus")).alias("label"), F.coalesce("family", F.lit("outside")).alias("family"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN n > 0 ELSE n = 0 END AS active, CASE o_orderkey % 3 WHEN 0 THEN 'explicit' ELSE 'inferred' END AS source FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey, LATERAL (SELECT coalesce(k, 0) AS n)")
def explicit_or_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag as written, else inferred from whether ids are there, or are not."""
    ids = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    kind, n = F.col("o_orderkey") % 3, F.coalesce("n", F.lit(0))
    rows = load(spark, sf_dir, "orders").select("o_orderkey").join(ids, "o_orderkey", "left")
    return rows.select("o_orderkey", F.when(kind == 0, True).when(kind == 1, n > 0).otherwise(n == 0).alias("active"), F.when(kind == 0, "explicit").otherwise("inferred").alias("source"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"k":1}' WHEN 1 THEN '{"k":1,"note":""}' ELSE '{"k":1,"note":"x","extra":[1,2]}' END AS record FROM events)
SELECT event_id, json_exists(record, '$.note') AS has_note, coalesce(record ->> '$.note', 'default') AS note, CASE WHEN json_exists(record, '$.extra') THEN CAST(record -> '$.extra' AS VARCHAR) ELSE '' END AS unknown FROM r""")
def shape_preserving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: a field that is missing is not one that is blank; unknown fields are kept as they are."""
    kind = F.col("event_id") % 3
    record = F.when(kind == 0, '{"k":1}').when(kind == 1, '{"k":1,"note":""}').otherwise('{"k":1,"note":"x","extra":[1,2]}')
    note = F.get_json_object(record, "$.note")
    return load(spark, sf_dir, "events").select("event_id", note.isNotNull().alias("has_note"), F.coalesce(note, F.lit("default")).alias("note"), F.coalesce(F.get_json_object(record, "$.extra"), F.lit("")).alias("unknown"))


@query("SELECT CAST(ts AS DATE) AS day, user_id % 20 AS entity, count(*) AS refs, count(DISTINCT event_type) AS sections FROM events GROUP BY 1, 2")
def referenced_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that mention an entity anywhere in their nested sections."""
    counts = events(spark, sf_dir).groupBy("day", "kind", (F.col("person") % 20).alias("entity")).agg(F.count("*").alias("n"))
    nested = counts.groupBy("day", "entity").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("sections"))  # a few sections, each with its count
    refs = F.aggregate(F.map_values("sections"), F.lit(0).cast("bigint"), lambda s, n: s + n)
    return nested.select("day", "entity", refs.alias("refs"), F.size("sections").cast("bigint").alias("sections"))


@query("""WITH k AS (SELECT o_custkey AS k, o_orderstatus AS g, o_orderkey AS id, o_totalprice > 250000 AS big FROM orders), x AS (SELECT k, g, count(*) AS n, bool_or(big) AS big, min(id) AS first FROM k GROUP BY 1, 2)
SELECT k, g, n, CASE WHEN n = 1 THEN 'single' WHEN big THEN 'best' ELSE 'first' END AS how, first FROM x""")
def choice_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several candidates is taken, and by which rule."""
    x = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("g")).agg(F.count("*").alias("n"), F.bool_or(F.col("o_totalprice") > 250000).alias("big"), F.min("o_orderkey").alias("first"))
    return x.select("k", "g", "n", classify.ladder([(F.col("n") == 1, "single"), (F.col("big"), "best")], "first").alias("how"), "first")


@query("""WITH e AS (SELECT o_custkey AS owner, o_orderkey AS id, o_orderdate AS ts, o_orderstatus = 'O' AS by_user FROM orders), u AS (SELECT owner, max(ts) AS last FROM e WHERE by_user GROUP BY 1) SELECT e.owner, id, coalesce(last > ts, false) AS edited_later FROM e LEFT JOIN u USING (owner) WHERE NOT by_user""")
def edited_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user has edited the owner after the batch's time; the last edit of each owner is enough."""
    e = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), "o_orderdate", (F.col("o_orderstatus") == "O").alias("by_user"))
    last = e.where("by_user").groupBy("owner").agg(F.max("o_orderdate").alias("last"))
    return e.where("not by_user").join(last, "owner", "left").select("owner", "id", F.coalesce(F.col("last") > F.col("o_orderdate"), F.lit(False)).alias("edited_later"))


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS day, count(*) AS rows FROM events WHERE user_id % 3 <> 0 AND day(ts) % 4 <> 0 GROUP BY 1), a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS rows, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1)
SELECT a.day, a.rows - coalesce(s.rows, 0) AS lacking, CASE WHEN s.day IS NULL THEN 'gap' WHEN s.rows < a.rows THEN 'partial' ELSE 'complete' END AS state, CASE WHEN s.day IS NULL AND kinds = 5 THEN 'fill' WHEN s.day IS NULL THEN 'quarantine' ELSE 'keep' END AS plan FROM a LEFT JOIN s USING (day)""")
def gap_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days the target lacks or has in part, by evidence, and what is planned for each."""
    e = events(spark, sf_dir)
    full = e.groupBy("day").agg(F.count("*").alias("rows"), F.countDistinct("kind").alias("kinds"))
    stored = e.where((F.col("person") % 3 != 0) & (F.dayofmonth("day") % 4 != 0)).groupBy("day").agg(F.count("*").alias("stored"))
    gap = F.col("stored").isNull()
    both = full.join(stored, "day", "left")
    state = F.when(gap, "gap").when(F.col("stored") < F.col("rows"), "partial").otherwise("complete")
    return both.select("day", (F.col("rows") - F.coalesce("stored", F.lit(0))).alias("lacking"), state.alias("state"), F.when(gap & (F.col("kinds") == 5), "fill").when(gap, "quarantine").otherwise("keep").alias("plan"))


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s2, CASE WHEN o_orderkey % 7 = 0 THEN 'Y' ELSE o_orderpriority END AS p2 FROM orders), f AS (SELECT id, 'status' AS field, s <> s2 AS differs FROM c UNION ALL SELECT id, 'priority', p <> p2 FROM c)
SELECT field, CASE WHEN NOT differs THEN 'same' WHEN id % 2 = 0 THEN 'corrected' ELSE 'protected' END AS outcome, count(*) AS n FROM f GROUP BY 1, 2""")
def correction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range read again: planned corrections by field and outcome."""
    key = F.col("o_orderkey")
    cells = F.array(F.struct(F.lit("status").alias("field"), (key % 5 == 0).alias("differs")), F.struct(F.lit("priority").alias("field"), (key % 7 == 0).alias("differs")))
    f = load(spark, sf_dir, "orders").select("o_orderkey", F.explode(cells).alias("c")).select("o_orderkey", "c.*")
    outcome = F.when(~F.col("differs"), "same").when(key % 2 == 0, "corrected").otherwise("protected")
    return f.groupBy("field", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT o_orderstatus AS g, count(*) FILTER (o_orderpriority LIKE '1%') AS p1, count(*) FILTER (o_orderpriority LIKE '2%') AS p2, count(*) AS force FROM orders GROUP BY 1), printed AS (SELECT g, '1' AS sub, p1 + CASE WHEN g = 'F' THEN 1 ELSE 0 END AS n FROM t UNION ALL SELECT g, '2', p2 FROM t), computed AS (SELECT o_orderstatus AS g, left(o_orderpriority, 1) AS sub, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT p.g, p.sub, p.n AS printed, coalesce(c.n, 0) AS computed, CASE WHEN p.n = c.n THEN 'ok' ELSE 'stale' END AS verdict FROM printed p LEFT JOIN computed c ON c.g = p.g AND c.sub = p.sub""")
def printed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed totals in columns as (group, sub) pairs against computed ones."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("g"), F.left("o_orderpriority", F.lit(1)).alias("sub"))
    wide = o.groupBy("g").agg(F.count_if(F.col("sub") == "1").alias("1"), F.count_if(F.col("sub") == "2").alias("2")).withColumn("1", F.col("1") + F.when(F.col("g") == "F", 1).otherwise(0))
    printed = wide.unpivot("g", ["1", "2"], "sub", "printed")
    both = printed.join(o.groupBy("g", "sub").agg(F.count("*").alias("computed")), ["g", "sub"], "left")
    return both.select("g", "sub", "printed", F.coalesce("computed", F.lit(0)).alias("computed"), F.when(F.col("printed") == F.col("computed"), "ok").otherwise("stale").alias("verdict"))


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS id, p_brand AS g, p_name, p_size, list_distinct([p_size % 12, p_partkey % 9]) AS people FROM part), e AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.g = b.g AND a.p_name = b.p_name AND list_has_any(a.people, b.people)), c AS (SELECT a AS id, b AS root FROM e UNION SELECT c.id, e.b FROM c JOIN e ON c.root = e.a), m AS (SELECT id, min(root) AS root FROM c GROUP BY 1)
SELECT root, count(*) AS merged, max(p_size) AS most, (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT unnest(r2.people) AS x FROM m m2 JOIN r r2 USING (id) WHERE m2.root = m.root)) AS people FROM m JOIN r USING (id) GROUP BY root""")
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one name with overlapping people become one, again and again until nothing changes."""
    people_of = F.array_distinct(F.array((F.col("p_size") % 12).cast("bigint"), F.col("p_partkey") % 9))
    r = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_name", "p_size", people_of.alias("people"))
    roots = graph.components(relational.links_of_sets(r, ["p_brand", "p_name"], "id", "people"))
    rows = r.join(roots, r["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
    return rows.groupBy("root").agg(F.count("*").alias("merged"), F.max("p_size").alias("most"), _ids(F.array_distinct(F.flatten(F.collect_list("people")))).alias("people"))


@query("""WITH k AS (SELECT p_brand AS block, p_name AS name, max(p_size) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2), w AS (SELECT p_partkey, p_brand AS block, CASE WHEN p_partkey % 3 = 1 THEN p_name ELSE substr(p_name, 2) END AS name FROM part WHERE p_partkey % 3 <> 0), c AS (SELECT p_partkey, n, count(*) OVER (PARTITION BY p_partkey) AS m FROM w JOIN k ON k.block = w.block AND levenshtein(w.name, k.name) = 1)
SELECT w.p_partkey, coalesce(k.n, c.n) AS headcount, CASE WHEN k.n IS NOT NULL THEN 'exact' WHEN c.n IS NOT NULL THEN 'near' ELSE 'none' END AS how FROM w LEFT JOIN k ON k.block = w.block AND k.name = w.name LEFT JOIN c ON c.p_partkey = w.p_partkey AND c.m = 1""")
def filled_headcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headcounts by block and key, else by the only key of the block that is one edit away."""
    p = load(spark, sf_dir, "part")
    k = p.where("p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("block"), F.col("p_name").alias("known")).agg(F.max("p_size").alias("n"))
    w = p.where("p_partkey % 3 <> 0").select("p_partkey", F.col("p_brand").alias("block"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.expr("substr(p_name, 2)")).alias("name"))
    exact = w.join(k.withColumnRenamed("known", "name"), ["block", "name"], "left")
    # names that are one edit apart agree in what is left of them by one character or more: here the block bounds the pairs
    pairs = w.join(k, "block").where(F.levenshtein("name", "known", 1) == 1).groupBy("p_partkey").agg(F.count("*").alias("m"), F.min("n").alias("near")).where("m = 1")
    both = exact.join(pairs, "p_partkey", "left")
    return both.select("p_partkey", F.coalesce("n", "near").alias("headcount"), F.when(F.col("n").isNotNull(), "exact").when(F.col("near").isNotNull(), "near").otherwise("none").alias("how"))


@query("SELECT o_custkey AS person, CAST(min(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS DATE) AS first_old, count(*) FILTER (o_orderstatus = 'F') AS old_shape, count(*) FILTER (o_orderstatus <> 'F') AS new_shape, string_agg(DISTINCT coalesce(CASE left(o_orderpriority, 1) WHEN '1' THEN 'chief' WHEN '2' THEN 'deputy' END, 'none'), ',' ORDER BY coalesce(CASE left(o_orderpriority, 1) WHEN '1' THEN 'chief' WHEN '2' THEN 'deputy' END, 'none')) AS roles FROM orders GROUP BY 1")
def legacy_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two shapes read as one, roles by a fixed map."""
    o = load(spark, sf_dir, "orders")
    digit = F.left("o_orderpriority", F.lit(1))
    shape = lambda df, name: df.select(F.col("o_custkey").alias("person"), F.col("o_orderdate").cast("date").alias("day"), F.when(digit == "1", "chief").when(digit == "2", "deputy").otherwise("none").alias("role"), F.lit(name).alias("shape"))
    both = shape(o.where("o_orderstatus = 'F'"), "old").unionByName(shape(o.where("o_orderstatus <> 'F'"), "new"))
    old = F.col("shape") == "old"
    return both.groupBy("person").agg(F.min(F.when(old, F.col("day"))).alias("first_old"), F.count_if(old).alias("old_shape"), F.count_if(~old).alias("new_shape"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("""WITH i AS (SELECT p_partkey AS id, 'size' AS rule FROM part WHERE p_size > 48 UNION ALL SELECT p_partkey, 'type' FROM part WHERE p_type = 'ECONOMY' AND p_size < 5 UNION ALL SELECT min(p_partkey), 'repeated' FROM part GROUP BY p_brand, p_name, p_type, p_size HAVING count(*) > 1 UNION ALL SELECT p_partkey, 'unused' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) SELECT rule, count(*) AS issues, min(id) AS example FROM i GROUP BY 1""")
def structural_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on the structure of what was read, as a list of issues."""
    p = load(spark, sf_dir, "part")
    told = lambda df, rule: df.select(F.col("p_partkey").alias("id"), F.lit(rule).alias("rule"))
    used = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    repeated = p.groupBy("p_brand", "p_name", "p_type", "p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey")).where("n > 1")
    issues = reduce(DataFrame.unionAll, [told(p.where("p_size > 48"), "size"), told(p.where("p_type = 'ECONOMY' AND p_size < 5"), "type"), told(repeated, "repeated"), told(p.join(used, "p_partkey", "left_anti"), "unused")])
    return issues.groupBy("rule").agg(F.count("*").alias("issues"), F.min("id").alias("example"))


@query("""WITH old AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS v FROM orders), new AS (SELECT id, day, CASE WHEN id % 20 = 0 THEN 'X' ELSE v END AS v FROM old WHERE id % 31 <> 0)
SELECT o.day, count(*) AS changed, string_agg(DISTINCT CASE WHEN n.id IS NULL THEN 'removed' ELSE 'status' END, ',' ORDER BY CASE WHEN n.id IS NULL THEN 'removed' ELSE 'status' END) AS sections, string_agg(CAST(o.id AS VARCHAR), ',' ORDER BY o.id) AS keys FROM old o LEFT JOIN new n USING (id) WHERE n.id IS NULL OR n.v <> o.v GROUP BY 1""")
def changed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: what a commit tells its listeners: days, sections and keys that changed."""
    old = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("v"))
    new = old.where("id % 31 <> 0").select("id", F.when(F.col("id") % 20 == 0, "X").otherwise(F.col("v")).alias("w"))
    both = old.join(new, "id", "left").where(F.col("w").isNull() | (F.col("w") != F.col("v")))
    section = F.when(F.col("w").isNull(), "removed").otherwise("status")
    return both.groupBy("day").agg(F.count("*").alias("changed"), F.array_join(F.array_sort(F.collect_set(section)), ",").alias("sections"), _ids(F.collect_list("id")).alias("keys"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey + 1 <= m THEN p_partkey + 1 WHEN p_partkey % 2 = 1 THEN p_partkey - 1 ELSE p_partkey END AS position FROM part, (SELECT max(p_partkey) AS m FROM part)")
def swapped_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows change places with a neighbour; what is stored keeps its order."""
    p = load(spark, sf_dir, "part").select("p_partkey")
    partner = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") + 1).otherwise(F.col("p_partkey") - 1)
    there = p.select(F.col("p_partkey").alias("position"))
    return p.withColumn("position", partner).join(there, "position", "left_semi").unionByName(p.withColumn("position", partner).join(there, "position", "left_anti").select("p_partkey", F.col("p_partkey").alias("position")))


@query("SELECT p_partkey, p_brand, CASE p_type WHEN 'STANDARD' THEN 0 WHEN 'PROMO' THEN 1 ELSE 2 END AS band, CAST(sum(p_size) OVER (PARTITION BY p_brand) AS BIGINT) AS brand_total, 24 * 60 - (p_size * 37) % 1440 AS minutes, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN (p_size * 37) % 1440 < 360 THEN (p_size * 37) % 1440 + 1440 ELSE (p_size * 37) % 1440 END, p_partkey) AS place FROM part WHERE p_type NOT IN ('SMALL', 'LARGE')")
def emergency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all but two fixed sections, ordered by their parsed time; nights before six come last."""
    m = (F.col("p_size") * 37) % 1440
    p = load(spark, sf_dir, "part").where(~F.col("p_type").isin("SMALL", "LARGE")).withColumn("late", F.when(m < 360, m + 1440).otherwise(m))
    totals = p.groupBy("p_brand").agg(F.sum("p_size").alias("brand_total"))
    placed = relational.numbered_in_groups(p, ["p_brand"], [F.col("late"), F.col("p_partkey")], "place").join(totals, "p_brand")
    band = F.when(F.col("p_type") == "STANDARD", 0).when(F.col("p_type") == "PROMO", 1).otherwise(2)
    return placed.select("p_partkey", "p_brand", band.alias("band"), "brand_total", (F.lit(1440) - m).alias("minutes"), "place")
