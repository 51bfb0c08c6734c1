"""Joins: by interval, as of a day, against fixed domains, for what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import relational, temporal
from quarry.plans.domain import LEAVES, VERSIONS, events, leaves, load, versions
from quarry.plans.registry import query

_CALENDAR = "cal AS (SELECT DISTINCT o_custkey AS person, CAST(o_orderdate AS DATE) + 3 AS day FROM orders)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.date_add(F.col("o_orderdate").cast("date"), 3).alias("day")).distinct()


@query(f"WITH {LEAVES}, {_CALENDAR} SELECT person, day, id, kind FROM (SELECT c.person, c.day, l.id, l.kind, row_number() OVER (PARTITION BY c.person, c.day ORDER BY l.s, l.id) AS r FROM cal c JOIN leaves l ON l.person = c.person AND c.day BETWEEN l.s AND l.e) WHERE r = 1")
def interval_point_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first leave that covers each person's day."""
    found = temporal.point_in_interval(_days(spark, sf_dir), leaves(spark, sf_dir), "person", "day", first_by=[F.col("s"), F.col("id")])
    return found.select("person", "day", "id", "kind")


@query(f"WITH {LEAVES}, o AS (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN NULL ELSE e END AS e) FROM leaves), {_CALENDAR} SELECT person, day, id FROM (SELECT c.person, c.day, o.id, row_number() OVER (PARTITION BY c.person, c.day ORDER BY o.s DESC, o.id DESC) AS r FROM cal c JOIN o ON o.person = c.person AND c.day >= o.s AND (o.e IS NULL OR c.day <= o.e)) WHERE r = 1")
def interval_open_end_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest period, open ends allowed, that covers each day."""
    periods = leaves(spark, sf_dir).withColumn("e", F.when(F.col("id") % 7 != 0, F.col("e")))
    return temporal.point_in_interval(_days(spark, sf_dir), periods, "person", "day", first_by=[F.desc("s"), F.desc("id")], open_end=True).select("person", "day", "id")


@query(f"WITH {LEAVES} SELECT a.person, a.id AS key_a, b.id AS key_b FROM leaves a JOIN leaves b ON a.person = b.person AND a.id < b.id AND a.s <= b.e AND b.s <= a.e")
def interval_overlap_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of one person that overlap."""
    return temporal.overlapping_pairs(leaves(spark, sf_dir), "person", "id")


@query(f"WITH {LEAVES} SELECT id, person, s, e FROM leaves WHERE s <= DATE '1996-06-30' AND e >= DATE '1996-06-01'")
def interval_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that touch a month; both bounds reach the scan as filters on the stored dates."""
    low, high = F.lit("1996-06-01").cast("date"), F.lit("1996-06-30").cast("date")
    return leaves(spark, sf_dir).where((F.col("s") <= high) & (F.col("e") >= low)).select("id", "person", "s", "e")


def _as_of_sql(otherwise: str) -> str:
    return f"""WITH {VERSIONS}, p AS (SELECT DISTINCT o_custkey AS person, make_date(y, 3, 15) AS day FROM orders, (VALUES (1994), (1996), (1998)) t(y)),
    v AS (SELECT *, min(since) OVER (PARTITION BY person) AS f, max(since) OVER (PARTITION BY person) AS l FROM versions)
    SELECT p.person, p.day, {otherwise} AS setting
    FROM p LEFT JOIN (SELECT p.person, p.day, arg_max(v.setting, v.since) AS s FROM p JOIN v ON v.person = p.person AND v.since <= p.day GROUP BY 1, 2) n USING (person, day)
    LEFT JOIN (SELECT person, arg_min(setting, since) AS e, arg_max(setting, since) AS w FROM versions GROUP BY 1) x USING (person)"""


def _as_of(spark: SparkSession, sf_dir: str, fallback: str | None) -> DataFrame:
    people = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person")).distinct()
    probes = people.withColumn("day", F.explode(F.array(*[F.lit(f"{y}-03-15").cast("date") for y in (1994, 1996, 1998)])))
    return temporal.as_of(probes, versions(spark, sf_dir), "person", "day", "since", fallback).select("person", "day", "setting")


@query(_as_of_sql("coalesce(n.s, x.e)"))
def asof_effective_earliest_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version in force, before the first one the earliest."""
    return _as_of(spark, sf_dir, "earliest")


@query(_as_of_sql("coalesce(n.s, x.w)"))
def asof_newest_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version in force, before the first one the newest."""
    return _as_of(spark, sf_dir, "newest")


@query(_as_of_sql("coalesce(n.s, 'none')"))
def asof_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version in force, before the first one a constant."""
    return _as_of(spark, sf_dir, None).withColumn("setting", F.coalesce("setting", F.lit("none")))


@query(f"WITH {LEAVES} SELECT c_custkey AS person, c_mktsegment AS section FROM customer c WHERE c_mktsegment <> 'MACHINERY' AND NOT EXISTS (SELECT 1 FROM leaves l WHERE l.person = c.c_custkey AND DATE '1996-06-15' BETWEEN l.s AND l.e)")
def anti_join_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People who can be assigned on a day: not of a hidden group, not on leave."""
    day = F.lit("1996-06-15").cast("date")
    away = leaves(spark, sf_dir).where(day.between(F.col("s"), F.col("e"))).select("person")
    people = load(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("section"))
    return people.join(away, "person", "left_anti")


@query("SELECT n_name AS slot, count(s_suppkey) AS held, coalesce(max(s_name), '') AS last_name FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON s_nationkey = n_nationkey GROUP BY n_name")
def fixed_domain_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of a fixed list, filled or not."""
    slots = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("slot"))
    rows = load(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("held"), F.max("s_name").alias("last_name"))
    return relational.on_domain(slots, rows, ["k"], {"held": 0, "last_name": ""}).select("slot", "held", "last_name")


@query("SELECT a.p_partkey AS part, b.brand FROM part a JOIN (SELECT DISTINCT lower(p_brand) AS brand FROM part) b ON 'post of ' || lower(a.p_brand) LIKE 'post of %' AND substr('post of ' || lower(a.p_brand), 9) = b.brand")
def prefix_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that begin with a prefix, joined by what follows it."""
    posts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat(F.lit("post of "), F.lower("p_brand")).alias("post"))
    targets = load(spark, sf_dir, "part").select(F.lower("p_brand").alias("brand")).distinct()
    return relational.after_prefix(posts, targets, "post", "brand", "post of ").select("part", "brand")


@query("SELECT c.c_custkey AS person, count(o.o_orderkey) AS terms, coalesce(string_agg(CAST(o.o_orderkey AS VARCHAR), ',' ORDER BY o.o_orderdate, o.o_orderkey), '') AS term_list FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY 1")
def nested_children_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with their children in order, parents without children kept."""
    parents = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"))
    children = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("person"), "o_orderdate", "o_orderkey")
    nested = relational.with_children(parents, children, "person", ["o_orderdate", "o_orderkey"], "terms")
    return nested.select("person", F.size("terms").cast("bigint").alias("terms"), F.array_join(F.transform("terms", lambda t: t["o_orderkey"].cast("string")), ",").alias("term_list"))


@query("SELECT l_orderkey, count(*) AS n, string_agg(CASE WHEN p_size > 5 THEN p_name ELSE '' END, '|' ORDER BY l_linenumber, l_partkey) AS names FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def array_dim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in an array resolved in order, blank where the dimension has no such row."""
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    names = load(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    found = relational.resolve_ids(rows, names, "l_orderkey", "ids", "id", "name", "")
    return found.select("l_orderkey", F.size("name").cast("bigint").alias("n"), F.array_join("name", "|").alias("names"))


@query("SELECT 'order' AS target, l_orderkey AS id, count(*) AS uses FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 2 UNION ALL SELECT 'part', l_partkey, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3) GROUP BY 2")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a registry that lead nowhere."""
    lines = load(spark, sf_dir, "lineitem")
    return relational.dangling(
        [("order", lines.select(F.col("l_orderkey").alias("id")), load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))), ("part", lines.select(F.col("l_partkey").alias("id")), load(spark, sf_dir, "part").where("p_size > 3").select(F.col("p_partkey").alias("id")))]
    )


_SERVICE = "service AS (SELECT o_custkey AS person, min(CAST(o_orderdate AS DATE)) + 200 AS joined, max(CAST(o_orderdate AS DATE)) - 200 AS gone FROM orders GROUP BY 1)"


def _service(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.date_add(F.min(day), 200).alias("joined"), F.date_sub(F.max(day), 200).alias("gone"))


@query(f"WITH {LEAVES}, {_SERVICE} SELECT id, person, CASE WHEN s < joined THEN 'before' ELSE 'after' END AS side FROM leaves JOIN service USING (person) WHERE s < joined OR e > gone")
def out_of_window_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records outside their owner's time of service."""
    both = leaves(spark, sf_dir).join(_service(spark, sf_dir), "person")
    return both.where("s < joined OR e > gone").select("id", "person", F.when(F.col("s") < F.col("joined"), "before").otherwise("after").alias("side"))


@query(f"WITH {LEAVES}, {_SERVICE} SELECT id, person, greatest(s, joined) AS s, least(e, gone) AS e FROM leaves JOIN service USING (person) WHERE greatest(s, joined) <= least(e, gone)")
def clamp_to_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records trimmed to the time of service."""
    both = leaves(spark, sf_dir).join(_service(spark, sf_dir), "person")
    return temporal.clamp(both, F.col("joined"), F.col("gone")).select("id", "person", "s", "e")


@query("WITH g AS (SELECT l_orderkey, l_suppkey % 3 AS shift, list(DISTINCT l_partkey % 40) AS people FROM lineitem GROUP BY 1, 2) SELECT a.l_orderkey AS a_key, b.l_orderkey AS b_key, a.shift FROM g a JOIN g b ON a.shift = b.shift AND a.l_orderkey < b.l_orderkey AND a.l_orderkey // 20 = b.l_orderkey // 20 AND list_has_any(a.people, b.people)")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one name and shift whose people overlap."""
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 3).alias("shift")).agg(F.collect_set(F.col("l_partkey") % 40).alias("people"))
    rows = rows.withColumn("name", F.floor(F.col("l_orderkey") / 20))
    return relational.overlapping_sets(rows, ["name", "shift"], "l_orderkey", "people").select("a_key", "b_key", "shift")


@query("SELECT p_partkey AS part, arg_min(b, o) AS service FROM part JOIN (SELECT 'ring' AS b, 'ring' AS k, 2 AS o UNION ALL SELECT 'ring', 'small', 2 UNION ALL SELECT 'bolt', 'bolt', 1 UNION ALL SELECT 'widget', 'widget', 3 UNION ALL SELECT 'widget', 'red', 3) a ON list_contains(string_split(p_name, ' '), k) GROUP BY 1")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved through an alias-expanded catalogue, the lowest catalogue order wins."""
    aliases = spark.sql("SELECT * FROM VALUES ('ring', 'ring', 2), ('ring', 'small', 2), ('bolt', 'bolt', 1), ('widget', 'widget', 3), ('widget', 'red', 3) AS t(service, k, o)")
    words = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.explode(F.split("p_name", " ")).alias("k"))
    return words.join(F.broadcast(aliases), "k").groupBy("part").agg(F.min_by("service", "o").alias("service"))


@query("SELECT user_id AS person, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderpriority = '1-URGENT') GROUP BY 1")
def anti_join_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one source has and another does not, by normalised key."""
    listed = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("person"))
    return events(spark, sf_dir).join(listed, "person", "left_anti").groupBy("person").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS task, l_suppkey AS vehicle, 'direct' AS source FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT a.l_orderkey, b.l_partkey, 'attached' FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND b.l_linenumber = 7 AND b.l_orderkey = a.l_orderkey WHERE a.l_linenumber = 1")
def direct_and_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles that serve a task directly, and those attached to one that does."""
    lines = load(spark, sf_dir, "lineitem")
    first = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("vehicle"))
    attached = lines.where("l_linenumber = 7").select(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("vehicle"), "l_partkey")
    via = first.join(attached, ["task", "vehicle"]).select("task", F.col("l_partkey").alias("vehicle"), F.lit("attached").alias("source"))
    return first.select("task", "vehicle", F.lit("direct").alias("source")).unionByName(via)
