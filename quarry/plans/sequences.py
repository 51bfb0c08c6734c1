"""Sequences: islands, change points, carry-forward, sessions, order and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import relational, temporal
from quarry.plans.domain import LEAVES, events, leaves, load
from quarry.plans.registry import query

_EVENTS = "ev AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id AS person, event_type AS kind, value FROM events)"


@query(f"""WITH {LEAVES}, a AS (SELECT *, max(e) OVER (PARTITION BY person ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM leaves),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT person, min(s) AS s, max(e) AS e, count(*) AS parts FROM b GROUP BY person, g""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of one person that touch, as one."""
    return temporal.merge_islands(leaves(spark, sf_dir), ["person"])


@query(f"WITH {_EVENTS}, d AS (SELECT DISTINCT person, kind, day FROM ev WHERE kind IN ('error', 'signup')), r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY person, kind ORDER BY day) AS INTEGER) AS g FROM d) SELECT person, kind, min(day) AS s, max(day) AS e, count(*) AS days FROM r GROUP BY person, kind, g")
def consecutive_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive days of one status."""
    return temporal.day_islands(events(spark, sf_dir).where(F.col("kind").isin("error", "signup")), ["person", "kind"])


@query(f"""WITH {LEAVES}, days AS (SELECT id, person, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS day FROM leaves),
busy AS (SELECT DISTINCT o_custkey AS person, CAST(o_orderdate AS DATE) + 4 AS day FROM orders), f AS (SELECT * FROM days d WHERE NOT EXISTS (SELECT 1 FROM busy b WHERE b.person = d.person AND b.day = d.day)),
r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY person, id ORDER BY day) AS INTEGER) AS g FROM f) SELECT person, id, min(day) AS s, max(day) AS e, count(*) AS days FROM r GROUP BY person, id, g""")
def split_on_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves split around days of duty."""
    busy = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.date_add(F.col("o_orderdate").cast("date"), 4).alias("day"))
    return temporal.split_on_days(leaves(spark, sf_dir), busy, "person", "id")


@query("WITH r AS (SELECT o_custkey AS person, o_orderkey AS id, o_orderstatus AS state, lag(o_orderstatus) OVER w AS p, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT person, id, state FROM r WHERE n = 1 OR state IS DISTINCT FROM p")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows where a person's state changes."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("id"), "o_orderdate", F.col("o_orderstatus").alias("state"))
    return temporal.change_points(rows, "person", ["o_orderdate", "id"], "state").select("person", "id", "state")


_TURNS = "o.state <> r.last AND (o.ahead IS NULL OR o.ahead <> r.last)"


@query(f"""WITH RECURSIVE o AS (SELECT o_custkey AS person, o_orderkey AS id, o_orderstatus AS state, row_number() OVER w AS k, lead(o_orderstatus) OVER w AS ahead FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
r AS (SELECT person, id, state, k, state AS last, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.person, o.id, o.state, o.k, CASE WHEN {_TURNS} THEN o.state ELSE r.last END, {_TURNS} FROM r JOIN o ON o.person = r.person AND o.k = r.k + 1) SELECT person, id, state FROM r WHERE kept""")
def change_points_without_blips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points after one-row blips are passed over."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    return temporal.change_points_without_blips(rows, "person", "id", "state")


@query("WITH t AS (SELECT conv_id, turn, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM (SELECT * FROM conversations WHERE (conv_id + turn) % 5 <> 3)) SELECT conv_id, turn, step FROM t WHERE step <> 1")
def counter_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where a counter does not go up by one."""
    rows = load(spark, sf_dir, "conversations").where("(conv_id + turn) % 5 <> 3")
    step = F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("step", step).where("step <> 1").select("conv_id", "turn", "step")


_SHEET = """sheet AS (SELECT user_id AS person, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 4 = 0 THEN '' ELSE props END END) AS note, max(CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END) AS car FROM events GROUP BY 1, 2)"""


@query(f"""WITH {_SHEET} SELECT s.person, s.day,
  (SELECT nullif(arg_max(t.note, t.day), '') FROM sheet t WHERE t.person = s.person AND t.note IS NOT NULL AND t.day BETWEEN s.day - 7 AND s.day) AS note_carried,
  (SELECT CASE WHEN arg_max(t.note, t.day) <> '' THEN max(t.day) END FROM sheet t WHERE t.person = s.person AND t.note IS NOT NULL AND t.day BETWEEN s.day - 7 AND s.day) AS note_from,
  (SELECT nullif(arg_max(t.car, t.day), '') FROM sheet t WHERE t.person = s.person AND t.car IS NOT NULL AND t.day BETWEEN s.day - 7 AND s.day) AS car_carried,
  (SELECT CASE WHEN arg_max(t.car, t.day) <> '' THEN max(t.day) END FROM sheet t WHERE t.person = s.person AND t.car IS NOT NULL AND t.day BETWEEN s.day - 7 AND s.day) AS car_from FROM sheet s""")
def locf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field's last present value within a window, its day, and blanks that cut."""
    e = load(spark, sf_dir, "events")
    note = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("props")))
    car = F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string"))
    sheet = e.groupBy(F.col("user_id").alias("person"), F.col("ts").cast("date").alias("day")).agg(F.max(note).alias("note"), F.max(car).alias("car"))
    return temporal.carry_forward(sheet, "person", "day", ["note", "car"], 7).drop("note", "car")


@query("""WITH g AS (SELECT user_id AS person, event_type AS k, lag(event_type) OVER w AS pk, date_diff('microsecond', lag(ts) OVER w, ts) // 1000000 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type))
SELECT person, CAST(sum(CASE WHEN pk IS NULL OR k = 'signup' OR pk = 'error' THEN 0 ELSE least(gap, 900) END) AS BIGINT) AS seconds FROM g GROUP BY person""")
def capped_session_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active time with gaps capped at a quarter of an hour; sign-ups start, errors end a session."""
    return temporal.capped_gaps(events(spark, sf_dir), "person", "ts", "kind", "signup", "error", 900)


@query(f"WITH {LEAVES}, m AS (SELECT date_trunc('month', s) AS month, count(*) AS n FROM leaves GROUP BY 1) SELECT CAST(month AS DATE) AS month, n, CAST(sum(n) OVER (ORDER BY month) AS BIGINT) AS running FROM m")
def leaves_stats_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total by month; the window sees one row for each month."""
    months = leaves(spark, sf_dir).groupBy(F.trunc("s", "month").alias("month")).agg(F.count("*").alias("n"))
    return months.withColumn("running", F.sum("n").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


@query(f"""WITH {LEAVES}, r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY s DESC, id DESC) AS n FROM leaves)
SELECT person, id, kind, CASE WHEN kind = '5-LOW' THEN 'suspended' WHEN DATE '2000-06-15' BETWEEN s AND e THEN 'active' WHEN s > DATE '2000-06-15' THEN 'upcoming' ELSE 'due' END AS status FROM r WHERE n = 1""")
def latest_per_type_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's latest leave and how it stands on a day."""
    today = F.lit("2000-06-15").cast("date")
    last = relational.first_by(leaves(spark, sf_dir), ["person"], [F.desc("s"), F.desc("id")])
    status = F.when(F.col("kind") == "5-LOW", "suspended").when(today.between(F.col("s"), F.col("e")), "active").when(F.col("s") > today, "upcoming").otherwise("due")
    return last.select("person", "id", "kind", status.alias("status"))


@query(f"""WITH {LEAVES}, n AS (SELECT c_custkey AS person, DATE '2000-06-15' + CAST((c_custkey % 7 - isodow(DATE '2000-06-15') + 1 + 6) % 7 + 1 AS INTEGER) AS day, 'weekly' AS source FROM customer UNION ALL SELECT person, s, 'leave' FROM leaves WHERE s > DATE '2000-06-15')
SELECT person, min(day) AS next_rest, arg_min(source, struct_pack(d := day, s := source)) AS source FROM n GROUP BY person""")
def next_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16, DT3, R11, R15: the next rest of each person from two sources."""
    today = F.lit("2000-06-15").cast("date")
    ahead = F.pmod(F.col("c_custkey") % 7 - (F.weekday(today) + 1) + 1 + 6, F.lit(7)) + 1
    weekly = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.date_add(today, ahead.cast("int")).alias("day"), F.lit("weekly").alias("source"))
    recorded = leaves(spark, sf_dir).where(F.col("s") > today).select("person", F.col("s").alias("day"), F.lit("leave").alias("source"))
    return weekly.unionByName(recorded).groupBy("person").agg(F.min("day").alias("next_rest"), F.min_by("source", F.struct("day", "source")).alias("source"))


@query("SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS group_size, min(p_partkey) OVER (PARTITION BY p_brand) AS group_at, p_type IS DISTINCT FROM lag(p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS breaks FROM part")
def grouped_stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in first-seen order, with break flags from neighbours."""
    by = Window.partitionBy("p_brand")
    before = F.lag("p_type").over(by.orderBy("p_partkey"))
    return load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.count("*").over(by).alias("group_size"), F.min("p_partkey").over(by).alias("group_at"), (~F.col("p_type").eqNullSafe(before)).alias("breaks"))


@query("WITH r AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_shipdate, l_linenumber, l_suppkey, l_partkey) AS o FROM lineitem GROUP BY 1) SELECT l_orderkey, o[-1] AS owner FROM r")
def last_period_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of the last of several periods."""
    key = F.struct("l_shipdate", "l_linenumber", "l_suppkey", "l_partkey")
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_suppkey", key).alias("owner"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, c_nationkey, c_name) AS place FROM customer")
def composite_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: places by a composite order, the name last. Rows are numbered within their group, of which the few sizes are summed up."""
    level = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    rows = load(spark, sf_dir, "customer").select("c_custkey", level.alias("level"), "c_nationkey", "c_name")
    sizes = rows.groupBy("level", "c_nationkey").agg(F.count("*").alias("n"))  # one row for each level and nation
    earlier = Window.orderBy("level", "c_nationkey").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("level", "c_nationkey", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("level", "c_nationkey").orderBy("c_name"))
    return rows.withColumn("within", within).join(F.broadcast(before), ["level", "c_nationkey"]).select("c_custkey", (F.col("before") + F.col("within")).alias("place"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01', 5000) AND contains(lower(o_orderpriority || ' ' || o_orderstatus), 'high') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page behind a cursor, newest first, one row more than shown; a top-k report."""
    o = load(spark, sf_dir, "orders")
    cursor = F.lit("1998-01-01").cast("timestamp_ntz")
    behind = (F.col("o_orderdate") < cursor) | ((F.col("o_orderdate") == cursor) & (F.col("o_orderkey") < 5000))
    found = F.contains(F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")), F.lit("high"))
    return o.where(behind & found).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(51).select("o_orderkey", "o_orderdate")


@query(f"WITH {LEAVES} SELECT person, count(*) AS n, min(id) AS first_id FROM leaves GROUP BY person ORDER BY n DESC, first_id LIMIT 10")
def leaves_stats_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the ten people with most leaves; a top-k report."""
    return leaves(spark, sf_dir).groupBy("person").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("n"), "first_id").limit(10)


@query("SELECT p_brand, count(*) FILTER (p_type = 'PROMO') AS m, count(*) FILTER (p_type = 'SMALL') AS n, row_number() OVER (ORDER BY abs(count(*) FILTER (p_type = 'PROMO') - count(*) FILTER (p_type = 'SMALL')) DESC, p_brand) AS place FROM part GROUP BY p_brand")
def sorted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by the distance of two counts; one row for each brand is ranked."""
    counts = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(F.col("p_type") == "PROMO").alias("m"), F.count_if(F.col("p_type") == "SMALL").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs(F.col("m") - F.col("n"))), "p_brand")).cast("bigint"))


@query("""WITH k AS (SELECT *, least(n_chars // 100, 60) AS score FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, n_chars DESC, doc_id) AS n, count(*) OVER (PARTITION BY lang, source, score) AS ties FROM k)
SELECT lang, source, doc_id AS best, ties > 1 AS conflict FROM r WHERE n = 1""")
def best_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of each role, and whether another has its score."""
    k = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.least(F.expr("n_chars div 100"), F.lit(60)).alias("score"))
    scores = k.groupBy("lang", "source", "score").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("best"), F.count("*").alias("ties"))
    return scores.groupBy("lang", "source").agg(F.max_by(F.struct("best", (F.col("ties") > 1).alias("conflict")), "score").alias("b")).select("lang", "source", "b.*")


@query(f"WITH {LEAVES}, c AS (SELECT id, person, s, least(e, coalesce(lead(s) OVER (PARTITION BY person ORDER BY s, e) - 1, e)) AS e FROM leaves) SELECT * FROM c WHERE e >= s")
def close_status_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period ends the day before the next one of its owner begins; of equal ones that of the greatest id stays."""
    return temporal.close_periods(leaves(spark, sf_dir), "person", ties=["id"]).select("id", "person", "s", "e")


@query("SELECT event_type AS name, max(CAST(ts AS DATE)) AS last_day, min(event_id) AS first_seen, row_number() OVER (ORDER BY max(CAST(ts AS DATE)) DESC, min(event_id)) AS place FROM events GROUP BY 1")
def names_by_recent_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by most recent use, ties by first seen."""
    names = events(spark, sf_dir).groupBy(F.col("kind").alias("name")).agg(F.max("day").alias("last_day"), F.min("event_id").alias("first_seen"))
    return names.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_day"), "first_seen")).cast("bigint"))


@query("""WITH d AS (SELECT source, max(CAST(n_chars AS BIGINT)) FILTER (n_chars < 2000) AS earlier, max(n_chars) AS other FROM documents GROUP BY 1)
SELECT x.source, x.doc_id, x.n_chars FROM documents x JOIN d ON d.source = x.source AND x.n_chars = coalesce(d.earlier, d.other)""")
def latest_section_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest earlier version that has the section, else the latest other one, and its rows."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    wanted = d.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("n_chars") < 2000, F.col("n_chars"))), F.max("n_chars")).alias("n_chars"))
    return d.join(wanted, ["source", "n_chars"]).select("source", "doc_id", "n_chars")


@query("""WITH v AS (SELECT user_id AS folder, CAST(ts AS DATE) AS day, count(*) AS votes FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY votes DESC, day) AS n FROM v)
SELECT folder, day, votes FROM r WHERE n = 1 AND votes >= 2""")
def majority_vote_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day that most rows of a folder name, if at least two do."""
    votes = events(spark, sf_dir).groupBy(F.col("person").alias("folder"), "day").agg(F.count("*").alias("votes"))
    return relational.first_by(votes, ["folder"], [F.desc("votes"), F.col("day")]).where("votes >= 2")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS person, CAST(left(o_orderpriority, 1) AS INTEGER) AS rank, min(CAST(left(o_orderpriority, 1) AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM orders)
SELECT id, person, rank, best FROM r WHERE best < rank""")
def running_best_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose rank is worse than the best one before."""
    w = Window.partitionBy("person").orderBy("o_orderdate", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("rank"), "o_orderdate")
    return rows.withColumn("best", F.min("rank").over(w)).where("best < rank").select("id", "person", "rank", "best")
