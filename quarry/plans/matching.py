"""Entity resolution and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import classify, graph, matching
from quarry.plans.domain import load
from quarry.plans.registry import query

_WORDS = "SELECT s_suppkey AS k, list_sort(list_distinct([CAST(s_nationkey AS VARCHAR) || 'n', CAST(s_suppkey // 3 AS VARCHAR) || 'g', CAST(s_suppkey // 7 AS VARCHAR) || 'h'])) AS s FROM supplier"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(key.alias("k"), F.array(F.concat(F.col("s_nationkey").cast("string"), F.lit("n")), F.concat(F.expr("s_suppkey div 3").cast("string"), F.lit("g")), F.concat(F.expr("s_suppkey div 7").cast("string"), F.lit("h"))).alias("s"))


@query(f"WITH t AS ({_WORDS}) SELECT a.k AS a, b.k AS b, len(list_intersect(a.s, b.s)) AS common FROM t a JOIN t b ON a.k < b.k AND list_has_any(a.s, b.s)")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the tokens they share."""
    return matching.token_overlap(_tokens(spark, sf_dir), "k", "s").withColumn("common", F.col("common").cast("bigint"))


@query("WITH t AS (SELECT DISTINCT p_name AS s FROM part UNION SELECT DISTINCT replace(p_name, 'e', '') FROM part) SELECT a.s AS a, b.s AS b, CAST(levenshtein(a.s, b.s) AS INTEGER) AS edits FROM t a JOIN t b ON a.s < b.s AND levenshtein(a.s, b.s) <= 1")
def levenshtein_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names one edit apart, joined by pieces."""
    p = load(spark, sf_dir, "part").select(F.col("p_name").alias("s")).distinct()
    names = p.union(p.select(F.replace("s", F.lit("e"), F.lit("")))).distinct()
    return matching.near_spellings(names.withColumn("k", F.col("s")), "k", "s", 1)


@query("SELECT p_partkey, p_name LIKE 'small%' AS starts, p_name LIKE '%ring' AS ends FROM part")
def ordered_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that occur in order in a name."""
    words = F.split("p_name", " ")
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", text.ordered_subsequence(F.array(F.lit("small")), words).alias("starts"), text.ordered_subsequence(F.array(F.lit("ring")), words).alias("ends"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey - o_custkey % 5 + o_orderkey % 2 AS b FROM orders), n AS (SELECT a AS x, b AS y FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT x AS node, x AS reach FROM n UNION SELECT r.node, n.y FROM r JOIN n ON n.x = r.reach) SELECT node, min(reach) AS root FROM r GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with their least member."""
    o = load(spark, sf_dir, "orders")
    return graph.components(o.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") - F.col("o_custkey") % 5 + F.col("o_orderkey") % 2).alias("b")))


@query("""WITH l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS code, c_custkey // 2 AS phone FROM customer), r AS (SELECT c_custkey + 100000 AS id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS code, c_custkey // 2 AS phone FROM customer),
s1 AS (SELECT l.k, r.id FROM l JOIN r ON l.code = r.code), l2 AS (SELECT * FROM l WHERE k NOT IN (SELECT k FROM s1)), r2 AS (SELECT * FROM r WHERE id NOT IN (SELECT id FROM s1)),
s2 AS (SELECT min(l.k) AS k, min(r.id) AS id FROM (SELECT phone, min(k) AS k FROM l2 GROUP BY 1 HAVING count(*) = 1) l JOIN (SELECT phone, min(id) AS id FROM r2 GROUP BY 1 HAVING count(*) = 1) r USING (phone) GROUP BY phone)
SELECT k, id, 'code' AS step FROM s1 UNION ALL SELECT k, id, 'phone' FROM s2""")
def cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cascade of keys, each only if exactly one row has it, matched rows consumed."""
    c = load(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    phone = F.expr("c_custkey div 2").alias("phone")
    left = c.select(key.alias("k"), F.when(key % 3 == 0, key).alias("code"), phone)
    right = c.select((key + 100000).alias("id"), F.when(key % 2 == 0, key).alias("code"), phone)
    return matching.cascade(left, right, "k", "id", [("code", "code"), ("phone", "phone")])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd against even lines of an order, by the names of their parts; each two names are compared once."""
    names = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), "l_linenumber", "l_partkey").join(names, "l_partkey")
    a = lines.where("l_linenumber % 2 = 1").select("grp", F.col("l_linenumber").alias("left"), F.col("name").alias("x"))
    b = lines.where("l_linenumber % 2 = 0").select("grp", F.col("l_linenumber").alias("right"), F.col("name").alias("y"))
    both = a.join(b, "grp")
    score = F.when(F.col("x") == F.col("y"), F.lit(100.0)).otherwise(matching.similarity(F.col("x"), F.col("y")) * 10)
    told = both.select("x", "y").distinct().withColumn("score", score)
    return both.join(told, ["x", "y"]).select("grp", "left", "right", "score")


@query()
def bipartite_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy pairs by similarity; tested against a loop."""
    return matching.greedy_pairs(_scored(spark, sf_dir), "grp", "left", "right", "score")


@query()
def fuzzy_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of similar names, never two that were seen on one day; tested against a loop."""
    p = load(spark, sf_dir, "part")
    rows = p.select(F.concat_ws("/", "p_brand", "p_type").alias("block"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", (F.col("p_size") % 5).cast("string")).alias("name"), F.array((F.col("p_partkey") % 11).cast("int")).alias("seen"))
    return matching.constrained_clusters(rows, "block", "id", "name", "seen")


@query("WITH s AS (SELECT l_partkey AS a, l_orderkey AS b, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2), t AS (SELECT a, max(score) AS top FROM s GROUP BY 1), u AS (SELECT s.a, min(s.b) AS b FROM s JOIN t ON t.a = s.a AND s.score = t.top GROUP BY 1 HAVING count(*) = 1) SELECT a, b FROM u WHERE b IN (SELECT b FROM u GROUP BY b HAVING count(*) = 1)")
def unique_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best partner, if it is the only best and nobody else's."""
    scores = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_orderkey").alias("b")).agg(F.sum("l_quantity").alias("score"))
    return matching.unique_best(scores, "a", "b", "score")


_VERDICT = "CASE WHEN text IS NULL OR n_chars = 0 THEN 2 WHEN n_chars < 200 OR lang IS NULL THEN 1 ELSE 0 END"


@query(f"WITH v AS (SELECT doc_id, source, {_VERDICT} AS severity FROM documents) SELECT doc_id, source, CAST(severity AS INTEGER) AS severity, CAST(max(severity) OVER (PARTITION BY source) AS INTEGER) AS source_severity FROM v")
def validation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's verdict and the worst of its source; the worst is summed first, then joined back."""
    label = classify.ladder([(F.col("text").isNull() | (F.col("n_chars") == 0), "quarantine"), ((F.col("n_chars") < 200) | F.col("lang").isNull(), "warn")], "ok")
    v = load(spark, sf_dir, "documents").select("doc_id", "source", classify.worst(["ok", "warn", "quarantine"], label).alias("severity"))
    worst = v.groupBy("source").agg(F.max("severity").alias("source_severity"))
    return v.join(worst, "source").select("doc_id", "source", "severity", "source_severity")


@query("SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS stated, CAST(sum(CASE WHEN l_linenumber < 7 THEN l_quantity ELSE 0 END) AS BIGINT) AS found, sum(l_quantity) <> sum(CASE WHEN l_linenumber < 7 THEN l_quantity ELSE 0 END) AS stale FROM lineitem GROUP BY 1")
def recomputed_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated sums against recomputed ones."""
    q = F.col("l_quantity").cast("bigint")
    sums = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(q).alias("stated"), F.sum(F.when(F.col("l_linenumber") < 7, q).otherwise(0)).alias("found"))
    return sums.withColumn("stale", F.col("stated") != F.col("found"))


@query("WITH w AS (SELECT p_name AS phrase, p_type AS source, p_partkey FROM part) SELECT phrase, count(*) AS n, count(DISTINCT source) AS sources, min(p_partkey) AS example FROM w GROUP BY 1")
def phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases by key with counts, sources and an example."""
    return load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("phrase")).agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("sources"), F.min("p_partkey").alias("example"))


@query("SELECT o_orderkey, o_orderstatus AS state, CASE o_orderpriority WHEN '1-URGENT' THEN 'F' WHEN '2-HIGH' THEN 'P' ELSE 'O' END AS wanted FROM orders WHERE (o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'F' WHEN '2-HIGH' THEN 'P' ELSE 'O' END) IN (('O', 'P'), ('P', 'F'), ('O', 'F'))")
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z16, ST4, ST5: transitions that a table allows."""
    allowed = spark.sql("SELECT * FROM VALUES ('O', 'P'), ('P', 'F'), ('O', 'F') AS t(state, wanted)")
    wanted = F.when(F.col("o_orderpriority") == "1-URGENT", "F").when(F.col("o_orderpriority") == "2-HIGH", "P").otherwise("O")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), wanted.alias("wanted")).join(F.broadcast(allowed), ["state", "wanted"], "left_semi").select("o_orderkey", "state", "wanted")
