"""Reports: counts, classification ladders, matrices, completeness, warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import classify, relational, temporal
from quarry.plans.domain import LEAVES, events, leaves, load
from quarry.plans.registry import query

_MONEY = "decimal(18,2)"


def _leave_counts(key_sql: str) -> str:
    return f"WITH {LEAVES} SELECT {key_sql} AS key, count(*) AS n, CAST(sum(e - s + 1) AS BIGINT) AS days FROM leaves GROUP BY 1"


def _leave_stats(spark: SparkSession, sf_dir: str, key) -> DataFrame:
    rows = leaves(spark, sf_dir)
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(F.datediff("e", "s") + 1).alias("days"))


@query(_leave_counts("kind"))
def leaves_stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: leaves and days by kind."""
    return _leave_stats(spark, sf_dir, F.col("kind"))


@query(_leave_counts("strftime(s, '%Y-%m')"))
def leaves_stats_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: by month of the start."""
    return _leave_stats(spark, sf_dir, F.date_format("s", "yyyy-MM"))


@query(_leave_counts("CAST((isodow(s) + 1) % 7 AS INTEGER)"))
def leaves_stats_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, DT2: by weekday of the start, Saturday first."""
    return _leave_stats(spark, sf_dir, F.pmod(F.weekday("s") + 2, F.lit(7)))


@query(_leave_counts("CASE WHEN e - s + 1 = 1 THEN '1' WHEN e - s + 1 <= 3 THEN '2-3' WHEN e - s + 1 <= 7 THEN '4-7' ELSE '8+' END"))
def leaves_stats_by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, DT8: by length."""
    n = F.datediff("e", "s") + 1
    return _leave_stats(spark, sf_dir, F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 7, "4-7").otherwise("8+"))


@query(_leave_counts("CASE WHEN e < DATE '1998-06-15' THEN 'past' WHEN s > DATE '1998-06-15' THEN 'future' ELSE 'running' END"))
def leaves_stats_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: by how they stand on a day."""
    today = F.lit("1998-06-15").cast("date")
    return _leave_stats(spark, sf_dir, F.when(F.col("e") < today, "past").when(F.col("s") > today, "future").otherwise("running"))


@query("SELECT user_id AS person, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("signup", "purchase", "error", "click", "view")) + ", count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def duty_load_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: each person's rows by kind and distinct days, in one pass."""
    kinds = ("signup", "purchase", "error", "click", "view")
    return events(spark, sf_dir).groupBy("person").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n"), F.countDistinct("day").alias("days"))


@query("SELECT user_id AS person, count(*) FILTER (event_type NOT IN ('error', 'view')) AS net, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (event_type NOT IN ('error', 'view')) / count(*), 2) AS rate FROM events GROUP BY 1")
def net_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: share of days of the kind that counts."""
    sums = events(spark, sf_dir).groupBy("person").agg(F.count_if(~F.col("kind").isin("error", "view")).alias("net"), F.count("*").alias("n"))
    return sums.withColumn("rate", F.round(F.lit(100.0) * F.col("net") / F.col("n"), 2))


@query("SELECT user_id AS person, count(*) FILTER (hour(ts) BETWEEN 6 AND 17) AS mornings, count(*) FILTER (hour(ts) NOT BETWEEN 6 AND 17) AS nights FROM events GROUP BY 1")
def shift_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: morning against night."""
    morning = F.hour("ts").between(6, 17)
    return events(spark, sf_dir).groupBy("person").agg(F.count_if(morning).alias("mornings"), F.count_if(~morning).alias("nights"))


@query("SELECT CAST((isodow(ts) + 1) % 7 AS INTEGER) AS weekday, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def weekday_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: rows by weekday (Saturday first) and kind."""
    return events(spark, sf_dir).groupBy(F.pmod(F.weekday("day") + 2, F.lit(7)).alias("weekday"), "kind").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT event_type AS kind, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT kind, max(day) AS last_day, CAST(DATE '2024-02-15' - max(day) AS INTEGER) AS days_since, count(*) AS days, max(n) AS most FROM t GROUP BY 1")
def target_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: when each target last had somebody, and how long ago."""
    days = events(spark, sf_dir).groupBy("kind", "day").agg(F.count("*").alias("n"))
    out = days.groupBy("kind").agg(F.max("day").alias("last_day"), F.count("*").alias("days"), F.max("n").alias("most"))
    return out.withColumn("days_since", F.datediff(F.lit("2024-02-15").cast("date"), "last_day"))


_FLAGS = """f AS (SELECT user_id AS person, CAST(ts AS DATE) AS day, bool_or(event_type = 'error') AS written, bool_or(event_type = 'signup') AS medical, bool_or(event_type = 'purchase' AND value > 50) AS on_leave, bool_or(event_type = 'purchase') AS shortfall, arg_min(event_type, ts) AS first_service FROM events GROUP BY 1, 2)"""
_LADDER = "CASE WHEN written THEN 'written' WHEN medical THEN 'medical' WHEN on_leave THEN 'rest' WHEN shortfall THEN 'shortfall' WHEN first_service = 'click' THEN 'external' WHEN first_service = 'view' THEN 'internal' ELSE 'net' END"


def _day_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("kind")
    return events(spark, sf_dir).groupBy("person", "day").agg(
        F.bool_or(k == "error").alias("written"), F.bool_or(k == "signup").alias("medical"), F.bool_or((k == "purchase") & (F.col("value") > 50)).alias("on_leave"), F.bool_or(k == "purchase").alias("shortfall"), F.min_by("kind", "ts").alias("first_service")
    )


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rules = [(c("written"), "written"), (c("medical"), "medical"), (c("on_leave"), "rest"), (c("shortfall"), "shortfall"), (c("first_service") == "click", "external"), (c("first_service") == "view", "internal")]
    return _day_flags(spark, sf_dir).select("person", "day", classify.ladder(rules, "net").alias("bucket"))


@query(f"WITH {_FLAGS} SELECT day, bucket, count(*) AS n FROM (SELECT person, day, {_LADDER} AS bucket FROM f) GROUP BY 1, 2")
def day_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every person's day in one bucket by the first rule that holds, counted by day."""
    return _classified(spark, sf_dir).groupBy("day", "bucket").agg(F.count("*").alias("n"))


@query(f"WITH {_FLAGS}, b AS (SELECT person, day, {_LADDER} AS bucket FROM f) SELECT d.bucket, coalesce(n, 0) AS n, coalesce(people, 0) AS people FROM (VALUES ('written'), ('medical'), ('rest'), ('shortfall'), ('external'), ('internal'), ('net'), ('course'), ('subcamp')) d(bucket) LEFT JOIN (SELECT bucket, count(*) AS n, count(DISTINCT person) AS people FROM b GROUP BY 1) USING (bucket)")
def classification_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over a fixed list of buckets, zero where none."""
    buckets = spark.sql("SELECT * FROM VALUES ('written'), ('medical'), ('rest'), ('shortfall'), ('external'), ('internal'), ('net'), ('course'), ('subcamp') AS t(bucket)")
    counts = _classified(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("person").alias("people"))
    return buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("people", F.lit(0)).alias("people"))


@query("SELECT user_id AS person, " + ", ".join(f"count(*) FILTER (day(ts) = {d}) AS d{d:02d}" for d in range(1, 32)) + " FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1")
def month_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People by days of a month; the days are given, so the pivot needs no pass of its own."""
    month = events(spark, sf_dir).where((F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-02-01").cast("timestamp_ntz")))
    return month.groupBy("person").agg(*[F.count_if(F.dayofmonth("day") == d).alias(f"d{d:02d}") for d in range(1, 32)])


@query("WITH p AS (SELECT DISTINCT user_id AS person FROM events), d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day), h AS (SELECT DISTINCT user_id AS person, CAST(ts AS DATE) AS day FROM events) SELECT p.person, count(h.day) AS present, count(*) - count(h.day) AS absent FROM p, d LEFT JOIN h ON h.person = p.person AND h.day = d.day GROUP BY 1")
def row_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present and absent days of each person over a spine; absence is the rest, so no cross product is made."""
    first, last = F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date")
    present = F.countDistinct(F.when(F.col("day").between(first, last), F.col("day")))
    return events(spark, sf_dir).groupBy("person").agg(present.alias("present")).withColumn("absent", F.datediff(last, first) + 1 - F.col("present"))


@query("WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS day) SELECT d.day, count(e.event_id) AS n, count(DISTINCT e.user_id) AS people, count(*) FILTER (e.event_type = 'error') AS errors FROM d LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day GROUP BY 1")
def activity_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense daily series."""
    days = temporal.spine(spark.range(1), F.lit("2024-01-01").cast("date"), F.lit("2024-02-10").cast("date")).select("day")
    counts = events(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("person").alias("people"), F.count_if(F.col("kind") == "error").alias("errors"))
    return days.join(counts, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "people", "errors")])


@query("WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, arg_max(event_type, struct_pack(n := n, k := event_type)) AS top FROM k GROUP BY 1) SELECT user_id AS person, count(*) FILTER (event_type = 'signup') AS logins, count(*) FILTER (event_type = 'error') AS denied, count(DISTINCT CAST(ts AS DATE)) AS active_days, max(ts) AS last_seen, any_value(top) AS top FROM events JOIN t USING (user_id) GROUP BY 1")
def activity_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each member's counts, active days, last activity and most frequent action."""
    e = events(spark, sf_dir)
    kinds = e.groupBy("person", "kind").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    days = e.groupBy("person").agg(F.countDistinct("day").alias("active_days"))
    count_of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    members = kinds.groupBy("person").agg(count_of("signup").alias("logins"), count_of("error").alias("denied"), F.max("last").alias("last_seen"), F.max_by("kind", F.struct("n", "kind")).alias("top"))
    return members.join(days, "person")


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, count(DISTINCT user_id) AS people FROM events GROUP BY 1")
def activity_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: by hour of the day."""
    return events(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.countDistinct("person").alias("people"))


@query(f"WITH {LEAVES} SELECT person, strftime(s, '%Y-%m') AS month, grouping(strftime(s, '%Y-%m')) AS overall, count(*) AS n, CAST(sum(e - s + 1) AS BIGINT) AS days FROM leaves GROUP BY ROLLUP (person, strftime(s, '%Y-%m')) HAVING grouping(person) = 0")
def person_register_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's tally by month and over all."""
    rows = leaves(spark, sf_dir).select("person", F.date_format("s", "yyyy-MM").alias("month"), (F.datediff("e", "s") + 1).alias("d"))
    return rows.rollup("person", "month").agg(F.grouping("person").alias("_p"), F.grouping("month").cast("bigint").alias("overall"), F.count("*").alias("n"), F.sum("d").alias("days")).where("_p = 0").drop("_p")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, grouping(l_returnflag) + grouping(l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def block_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals of blocks and the grand total."""
    lines = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast(_MONEY).alias("q"))
    level = (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("bigint")
    return lines.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("q").cast("double").alias("quantity"), level.alias("level"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_totalprice < 50000) AS partial, count(*) FILTER (o_totalprice < 50000 OR o_orderpriority = '5-LOW') AS missing, count(*) FILTER (o_orderpriority <> '4-NOT SPECIFIED') AS counted FROM orders GROUP BY 1")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by completeness; optional rows stay out of the total."""
    partial, low = F.col("o_totalprice") < 50000, F.col("o_orderpriority") == "5-LOW"
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(partial).alias("partial"), F.count_if(partial | low).alias("missing"), F.count_if(F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("counted"))


@query("SELECT l_suppkey, l_shipdate, count(*) AS posts, CAST(sum(greatest(1, CAST(l_quantity AS BIGINT) - 20)) AS BIGINT) AS slots FROM lineitem GROUP BY 1, 2")
def post_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of each section, at least one a post."""
    slots = F.greatest(F.lit(1), F.round("l_quantity").cast("bigint") - 20)
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.count("*").alias("posts"), F.sum(slots).alias("slots"))


@query("SELECT p_type, p_size, count(*) AS rows, count(DISTINCT p_brand) AS brands, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM part GROUP BY 1, 2")
def equivalent_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over rows that are equivalent by key."""
    return load(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("rows"), F.countDistinct("p_brand").alias("brands"), F.sum(F.col("p_retailprice").cast(_MONEY)).cast("double").alias("total"))


@query("SELECT c_nationkey, c_mktsegment, min(c_custkey) AS first_id, arg_min(c_name, c_custkey) FILTER (c_acctbal > 0) AS name, count(*) AS merged, string_agg(DISTINCT CAST(c_custkey % 4 AS VARCHAR), ',' ORDER BY CAST(c_custkey % 4 AS VARCHAR)) AS sources FROM customer GROUP BY 1, 2")
def merged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key as one: the first present value of a field, the union of sources."""
    first = F.min_by(F.when(F.col("c_acctbal") > 0, F.col("c_name")), F.when(F.col("c_acctbal") > 0, F.col("c_custkey")))
    return load(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.min("c_custkey").alias("first_id"), first.alias("name"), F.count("*").alias("merged"), F.array_join(F.sort_array(F.collect_set((F.col("c_custkey") % 4).cast("string"))), ",").alias("sources")
    )


@query("SELECT l_suppkey, l_shipdate, count(*) AS rows, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS others FROM (SELECT DISTINCT l_suppkey, l_shipdate, l_orderkey FROM lineitem) GROUP BY 1, 2 HAVING count(*) >= 2")
def resource_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resource with several rows on one day, and which."""
    used = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey").distinct()
    grouped = used.groupBy("l_suppkey", "l_shipdate").agg(F.count("*").alias("rows"), F.sort_array(F.collect_list("l_orderkey")).alias("o"))
    return grouped.where("rows >= 2").select("l_suppkey", "l_shipdate", "rows", F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("others"))


@query(f"""WITH {LEAVES}, x AS (SELECT user_id AS person, CAST(ts AS DATE) - 9000 + CAST(user_id % 2000 AS INTEGER) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT person, day, 'leave' AS rule, 'critical' AS level, count(*) AS n FROM x WHERE EXISTS (SELECT 1 FROM leaves l WHERE l.person = x.person AND x.day BETWEEN l.s AND l.e) GROUP BY 1, 2
UNION ALL SELECT person, day, 'crowded', 'info', count(*) FROM x WHERE n >= 2 GROUP BY 1, 2 UNION ALL SELECT person, day, 'vacant', 'warning', count(*) FROM x WHERE kind = 'error' GROUP BY 1, 2""")
def rule_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of several rules, each with its level."""
    shifted = F.expr("date_add(date_sub(day, 9000), cast(person % 2000 as int))")
    x = events(spark, sf_dir).groupBy("person", shifted.alias("day"), "kind").agg(F.count("*").alias("n"))
    away = leaves(spark, sf_dir).select(F.col("person").alias("_p"), "s", "e")
    clash = x.join(away, (F.col("person") == F.col("_p")) & F.col("day").between(F.col("s"), F.col("e")), "left_semi")
    rules = [(clash, "leave", "critical"), (x.where("n >= 2"), "crowded", "info"), (x.where("kind = 'error'"), "vacant", "warning")]
    return reduce(DataFrame.unionByName, [found.groupBy("person", "day").agg(F.count("*").alias("n")).select("person", "day", F.lit(rule).alias("rule"), F.lit(level).alias("level"), "n") for found, rule, level in rules])


@query("SELECT p_name AS name, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names used more than once."""
    return load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).where("n > 1")


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars >= 1000) AS high, round(100.0::DOUBLE * count(*) FILTER (n_chars >= 1000) / count(*), 2) AS share FROM documents GROUP BY GROUPING SETS ((), (lang), (source))")
def coverage_by_year_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all, by one key and by the other, in one pass over two columns and a size."""
    docs = load(spark, sf_dir, "documents").select("lang", "source", (F.col("n_chars") >= 1000).alias("high"))
    sets = docs.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n"), F.count_if("high").alias("high"))
    return sets.withColumn("share", F.round(F.lit(100.0) * F.col("high") / F.col("n"), 2))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 AND quality = 1 THEN round(100.0::DOUBLE * 0.35 * quality / 0.35) WHEN doc_id % 9 = 0 THEN round(0.0::DOUBLE) ELSE round(100.0::DOUBLE * (0.35 * quality + 0.65 * (1 - toxic)) / 1.0) END AS score FROM labels")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted score over the components that are there."""
    rows = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("q"), F.when(F.col("doc_id") % 9 != 0, 1.0 - F.col("toxic")).alias("t"))
    return rows.select("doc_id", classify.weighted([(F.col("q"), 0.35), (F.col("t"), 0.65)]).alias("score"))


@query("""WITH d AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS day), a AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT CASE WHEN a.n IS NULL THEN 'none' WHEN a.n > 2 THEN 'full' ELSE 'partial' END AS source, CASE WHEN b.n IS NULL THEN 'none' ELSE 'stored' END AS target, CASE WHEN a.n IS NULL THEN 'skip' WHEN b.n IS NULL THEN 'write' WHEN a.n > b.n THEN 'update' ELSE 'keep' END AS action, count(*) AS days FROM d LEFT JOIN a USING (day) LEFT JOIN b USING (day) GROUP BY 1, 2, 3""")
def audit_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day of a year needs, by what either side has."""
    days = temporal.spine(spark.range(1), F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date")).select("day")
    o = load(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    per = o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "P").alias("b"))
    both = days.join(per, "day", "left").withColumns({"a": F.nullif(F.col("a"), F.lit(0)), "b": F.nullif(F.col("b"), F.lit(0))})
    a, b = F.col("a"), F.col("b")
    source = classify.ladder([(a.isNull(), "none"), (a > 2, "full")], "partial")
    action = classify.ladder([(a.isNull(), "skip"), (b.isNull(), "write"), (a > b, "update")], "keep")
    return both.groupBy(source.alias("source"), F.when(b.isNull(), "none").otherwise("stored").alias("target"), action.alias("action")).agg(F.count("*").alias("days"))


@query("SELECT user_id AS person, min(CAST(ts AS DATE)) AS first_seen, max(CAST(ts AS DATE)) AS last_seen, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def person_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations folded into a span for each person."""
    return events(spark, sf_dir).groupBy("person").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.countDistinct("day").alias("days"))


@query("SELECT c_custkey AS person, coalesce(nullif(CASE WHEN c_acctbal < 0 THEN 'archived' ELSE CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'active' END END, ''), 'active') AS status FROM customer WHERE c_acctbal >= 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY')")
def active_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter by equality; a missing status is active."""
    c = load(spark, sf_dir, "customer").where("c_acctbal >= 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY')")
    status = F.when(F.col("c_acctbal") < 0, "archived").otherwise(F.when(F.col("c_custkey") % 3 != 0, "active"))
    return c.select(F.col("c_custkey").alias("person"), F.coalesce(status, F.lit("active")).alias("status"))


@query("WITH m AS (SELECT CAST(max(ts) AS DATE) AS last FROM events) SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events, m WHERE CAST(ts AS DATE) BETWEEN m.last - 9 AND m.last GROUP BY 1")
def default_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without bounds, the last recorded days; the bound is one row."""
    e = events(spark, sf_dir)
    last = e.agg(F.max("day").alias("last"))
    return e.join(F.broadcast(last), F.col("day").between(F.date_sub("last", 9), F.col("last"))).groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'open' WHEN bool_or(o_orderpriority = '5-LOW') THEN 'closed' WHEN CAST(o_orderdate AS DATE) < DATE '1998-01-01' THEN 'auto_closed' ELSE 'not_open' END AS stage FROM orders GROUP BY 1")
def day_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18, ST5: a day's stage: reopened, closed by hand, closed by age."""
    days = load(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("reopened"), F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("by_hand"))
    return days.select("day", classify.ladder([(F.col("reopened"), "open"), (F.col("by_hand"), "closed"), (F.col("day") < F.lit("1998-01-01").cast("date"), "auto_closed")], "not_open").alias("stage"))


@query(f"WITH {LEAVES} SELECT id, CASE WHEN s > DATE '1998-06-15' THEN 'cancel' ELSE 'trim' END AS change, CASE WHEN s > DATE '1998-06-15' THEN NULL ELSE DATE '1998-06-14' END AS new_end FROM leaves WHERE kind IN ('1-URGENT', '2-HIGH') AND e >= DATE '1998-06-15'")
def suspension_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a suspension does to running and coming leaves of its kinds."""
    day = F.lit("1998-06-15").cast("date")
    hit = leaves(spark, sf_dir).where(F.col("kind").isin("1-URGENT", "2-HIGH") & (F.col("e") >= day))
    return hit.select("id", F.when(F.col("s") > day, "cancel").otherwise("trim").alias("change"), F.when(F.col("s") <= day, F.date_sub(day, 1)).alias("new_end"))


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) FILTER (l_partkey % 5 <> 0) AS shown, count(*) FILTER (l_partkey % 5 <> 0) = 0 AS vacant FROM lineitem GROUP BY 1")
def hidden_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden ids taken out of an array, and whether it is vacant then."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m"))
    shown = F.transform(F.filter("m", lambda x: x["l_partkey"] % 5 != 0), lambda x: x["l_partkey"].cast("string"))
    return lines.select("l_orderkey", F.when(F.size(shown) > 0, F.array_join(shown, ",")).alias("shown"), (F.size(shown) == 0).alias("vacant"))


@query("SELECT s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place, count(*) OVER (PARTITION BY s_nationkey) AS of_all FROM supplier")
def numbered_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered in their group."""
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return relational.numbered_in_groups(rows, ["s_nationkey"], [F.col("s_suppkey")], "place", "of_all").drop("s_nationkey")


@query(f"WITH {LEAVES} SELECT s AS day, count(*) AS starts FROM leaves WHERE s BETWEEN DATE '1998-06-15' AND DATE '1998-06-18' GROUP BY 1")
def horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What begins within three days."""
    low, high = F.lit("1998-06-15").cast("date"), F.lit("1998-06-18").cast("date")
    return leaves(spark, sf_dir).where(F.col("s").between(low, high)).groupBy(F.col("s").alias("day")).agg(F.count("*").alias("starts"))
