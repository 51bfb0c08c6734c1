"""Snapshots compared: differences, merges, agreement; unions of registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import changes, relational
from quarry.plans.domain import LEAVES, VERSIONS, events, leaves, load, versions
from quarry.plans.registry import query

_OLD = "old AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 10 <> 1)"
_NEW = "new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 10 <> 2)"


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").where("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").where("o_orderkey % 10 <> 2").select(key.alias("id"), F.when(key % 6 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(key % 4 != 0, F.col("o_orderpriority")).alias("priority"))


@query(f"""WITH {_OLD}, {_NEW}, b AS (SELECT coalesce(old.id, new.id) AS id, CASE WHEN old.id IS NULL THEN 'create' WHEN new.id IS NULL THEN 'delete' ELSE 'update' END AS action,
concat_ws(',', CASE WHEN old.status IS DISTINCT FROM new.status THEN 'status' END, CASE WHEN old.priority IS DISTINCT FROM new.priority THEN 'priority' END) AS c FROM old FULL JOIN new ON old.id = new.id)
SELECT id, action, CASE WHEN action = 'update' THEN c ELSE '' END AS changed FROM b WHERE action <> 'update' OR c <> ''""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2, ST1, ST7: rows created, deleted and updated between two snapshots."""
    return changes.snapshot_diff(_old(spark, sf_dir), _new(spark, sf_dir), ["id"], ["status", "priority"])


@query(f"""WITH {_OLD}, {_NEW}, st AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'user' ELSE o_orderstatus END AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 7 <> 3),
c AS (SELECT n.id, st.id IS NULL AS gone, 'status' AS field, o.status AS o, n.status AS a, st.status AS s FROM new n LEFT JOIN old o USING (id) LEFT JOIN st USING (id) UNION ALL SELECT n.id, st.id IS NULL, 'priority', o.priority, n.priority, st.priority FROM new n LEFT JOIN old o USING (id) LEFT JOIN st USING (id)),
d AS (SELECT *, CASE WHEN gone THEN 'deleted' WHEN s IS NOT DISTINCT FROM a THEN 'same' WHEN s IS NOT DISTINCT FROM o THEN 'correct' ELSE 'protected' END AS decision FROM c WHERE a IS DISTINCT FROM o) SELECT id, field, decision, CASE WHEN decision = 'correct' THEN a ELSE s END AS value FROM d""")
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archive corrects, and what a user's edit protects."""
    stored = load(spark, sf_dir, "orders").where("o_orderkey % 7 <> 3").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "user").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))
    return changes.three_way(_old(spark, sf_dir), _new(spark, sf_dir), stored, ["id"], ["status", "priority"])


@query("WITH a AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose number of rows rose or fell."""
    o, cut = load(spark, sf_dir, "orders"), F.lit("1998-01-01").cast("timestamp_ntz")
    return changes.multiset_diff(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), ["o_custkey", "o_orderstatus"])


@query(f"""WITH {_OLD}, {_NEW}, b AS (SELECT old.id AS oid, new.id AS nid, old.status AS os, new.status AS ns, old.priority AS op, new.priority AS np FROM old FULL JOIN new ON old.id = new.id)
SELECT 'status' AS field, count(*) FILTER (oid IS NOT NULL AND nid IS NOT NULL) AS compared, count(*) FILTER (oid IS NOT NULL AND nid IS NOT NULL AND os IS NOT DISTINCT FROM ns) AS matched, count(*) FILTER (nid IS NULL) AS missing, count(*) FILTER (oid IS NULL) AS extra FROM b
UNION ALL SELECT 'priority', count(*) FILTER (oid IS NOT NULL AND nid IS NOT NULL), count(*) FILTER (oid IS NOT NULL AND nid IS NOT NULL AND op IS NOT DISTINCT FROM np), count(*) FILTER (nid IS NULL), count(*) FILTER (oid IS NULL) FROM b""")
def golden_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a candidate agrees with a reference, by field."""
    return changes.field_agreement(_old(spark, sf_dir), _new(spark, sf_dir), ["id"], ["status", "priority"])


@query(f"WITH {_OLD}, {_NEW} SELECT old.id, old.status, CASE WHEN old.id % 4 = 0 AND old.id % 3 <> 0 THEN coalesce(f.p, '') ELSE coalesce(new.priority, '') END AS priority FROM old JOIN new USING (id) LEFT JOIN (SELECT id, priority AS p FROM old) f USING (id)")
def fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks filled from an archive, never over a user's edit."""
    old, new = _old(spark, sf_dir), _new(spark, sf_dir)
    stored = old.select("id", "status").join(new.select("id", F.coalesce("priority", F.lit("")).alias("priority")), "id")
    return changes.fill_gaps(stored, old, old.where("id % 3 = 0"), ["id"], "priority")


@query("WITH k AS (SELECT DISTINCT o_custkey FROM orders), n AS (SELECT o_custkey, 3 * o_custkey AS id FROM k WHERE o_custkey % 4 = 0) SELECT 'o' || CAST(o_custkey AS VARCHAR) AS name, id FROM n UNION ALL SELECT 'o' || CAST(o_custkey AS VARCHAR), (SELECT max(id) FROM n) + row_number() OVER (ORDER BY o_custkey) FROM k WHERE o_custkey % 4 <> 0")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by natural key: numbers after the known ones, in order."""
    rows = load(spark, sf_dir, "orders").select("o_custkey").distinct()
    known = rows.where("o_custkey % 4 = 0").withColumn("id", 3 * F.col("o_custkey"))
    numbered = relational.allocate_ids(rows, known, ["o_custkey"], "id", ["o_custkey"])
    return numbered.select(F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("name"), "id")


@query("SELECT day, count(*) AS sections FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, event_type AS s FROM events UNION SELECT DISTINCT CAST(ts AS DATE), 'all' FROM events) GROUP BY 1")
def union_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct days over several sections."""
    e = events(spark, sf_dir)
    both = e.select("day", F.col("kind").alias("s")).union(e.select("day", F.lit("all"))).distinct()
    return both.groupBy("day").agg(F.count("*").alias("sections"))


@query(f"WITH {LEAVES} SELECT person, 'leave' AS source, kind AS label, s, e FROM leaves WHERE kind = '1-URGENT' UNION ALL SELECT user_id, 'status', event_type, min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) FROM events GROUP BY 1, 3")
def union_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several kinds of records in one register."""
    l = leaves(spark, sf_dir).where("kind = '1-URGENT'").select("person", F.lit("leave").alias("source"), F.col("kind").alias("label"), "s", "e")  # noqa: E741
    statuses = events(spark, sf_dir).groupBy("person", F.col("kind").alias("label")).agg(F.min("day").alias("s"), F.max("day").alias("e")).withColumn("source", F.lit("status"))
    return l.unionByName(statuses)


@query(f"WITH {VERSIONS}, c AS (SELECT *, lag(setting) OVER (PARTITION BY person ORDER BY since) AS p, row_number() OVER (PARTITION BY person ORDER BY since) AS n FROM (SELECT person, since, setting FROM versions WHERE since <> DATE '1999-01-01' UNION ALL SELECT DISTINCT person, DATE '1999-01-01', '5-LOW' FROM versions)) SELECT person, since, setting FROM c WHERE n = 1 OR setting IS DISTINCT FROM p")
def upsert_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12, X3, X8, DT9: a dated version for everybody, put into their histories; unchanged versions vanish."""
    v = versions(spark, sf_dir)
    new = v.select("person").distinct().select("person", F.lit("1999-01-01").cast("date").alias("since"), F.lit("5-LOW").alias("setting"))
    return changes.upsert_version(v, new, "person", "since", "setting")


@query("SELECT o_orderkey, sha256('{\"s\":\"' || o_orderstatus || '\",\"p\":\"' || o_orderpriority || '\"}') AS state FROM orders")
def canonical_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a row's canonical JSON."""
    return load(spark, sf_dir, "orders").select("o_orderkey", changes.state_hash([F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")]).alias("state"))


@query("SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size > 25 AND q.p_name = p.p_name AND q.p_brand = p.p_brand) AND p_size <= 25")
def copy_missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3, ST8-ST10, X9: rows to copy that the target does not have yet."""
    p = load(spark, sf_dir, "part")
    return p.where("p_size <= 25").join(p.where("p_size > 25").select("p_name", "p_brand"), ["p_name", "p_brand"], "left_anti").select("p_partkey", "p_name")
