"""Labels, controlled vocabularies, free texts and names: one query for each function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import dates, text
from quarry.operators import classify, matching
from quarry.plans.domain import load
from quarry.plans.registry import query

_TOKENS = "str_split(p_name || ' ' || lower(p_type), ' ')"


def _part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("tokens"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Gen' WHEN 1 THEN 'Col' WHEN 2 THEN 'Maj' ELSE '' END AS short, trim(CASE c_custkey % 4 WHEN 0 THEN 'Gen' WHEN 1 THEN 'Col' WHEN 2 THEN 'Maj' ELSE '' END || ' ' || c_name) AS label FROM customer")
def rank_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviated ranks, and names with them; unknown ranks have none."""
    c = load(spark, sf_dir, "customer")
    rank = F.element_at(F.array(F.lit("general"), F.lit("colonel"), F.lit("major"), F.lit("cadet")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", text.abbreviated(rank, {"general": "Gen", "colonel": "Col", "major": "Maj"}).alias("short"), "c_name").select("c_custkey", "short", F.trim(F.concat_ws(" ", "short", "c_name")).alias("label"))


@query("SELECT event_id, concat_ws(',', CASE WHEN length(props) > 9 THEN 'too long' END, CASE WHEN NOT regexp_full_match(props, '[ -9:;<-~]*') THEN 'charset' END, CASE WHEN contains(props, '9') THEN 'has 9' END) AS problems FROM events")
def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and characters of a field; blank where all is well."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", text.problems(F.col("props"), 9, r"^[ -9:;<-~]*$", {"has 9": "9"}).alias("problems"))


_CATEGORY = "CASE WHEN contains(p_name, 'anvil') THEN 'lorry' WHEN contains(p_name, 'gear') OR contains(p_name, 'widget') THEN 'bus' WHEN contains(p_name, 'ring') THEN 'micro' WHEN contains(p_name, 'bolt') THEN 'pickup' ELSE 'other' END"


@query(f"SELECT p_partkey, {_CATEGORY} AS category, CAST(list_position(['lorry', 'bus', 'micro', 'pickup', 'other'], {_CATEGORY}) - 1 AS INTEGER) AS place FROM part")
def vehicle_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of the first rule of which a keyword occurs, and its place."""
    found = text.by_keyword(F.col("p_name"), [("lorry", ["anvil"]), ("bus", ["gear", "widget"]), ("micro", ["ring"]), ("pickup", ["bolt"])], "other")
    order = ["lorry", "bus", "micro", "pickup", "other"]
    return load(spark, sf_dir, "part").select("p_partkey", found.alias("category")).withColumn("place", classify.worst(order, F.col("category")))


@query("WITH e AS (SELECT user_id AS person, event_type || ' ' || CAST(CAST(value AS INTEGER) % 3 AS VARCHAR) AS f, min(event_id) AS seen FROM events GROUP BY 1, 2) SELECT person, string_agg(f, ' + ' ORDER BY seen) AS text, count(*) AS fragments FROM e GROUP BY 1")
def assembled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments in order, each identity once where it first stood."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("person"), F.concat_ws(" ", "event_type", (F.rint("value").cast("int") % 3).cast("string")).alias("f"), "event_id")
    first = e.groupBy("person", "f").agg(F.min("event_id").alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "f")))
    return first.groupBy("person").agg(F.array_join(F.transform(listed, lambda x: x["f"]), " + ").alias("text"), F.count("*").alias("fragments"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE '?' || o_orderstatus END || CASE WHEN o_orderpriority LIKE '%URGENT' THEN ' (urgent)' ELSE '' END AS label FROM orders")
def field_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label from several fields; unknown codes show themselves."""
    label = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise(F.concat(F.lit("?"), "o_orderstatus"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.concat(label, F.when(F.col("o_orderpriority").endswith("URGENT"), " (urgent)").otherwise("")).alias("label"))


@query("SELECT p_partkey, ' ' || p_type || ' ' AS raw, CASE WHEN p_type IN ('PROMO', 'SMALL', 'LARGE') THEN lower(p_type) WHEN p_type = 'ECONOMY' THEN 'small' ELSE '' END AS value, CASE WHEN p_type IN ('PROMO', 'SMALL', 'LARGE') THEN '' WHEN p_type = 'ECONOMY' THEN 'alias' ELSE 'unknown' END AS flags FROM part")
def vocabulary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw value, the vocabulary's value for it, and whether that came by an alias or not at all."""
    raw = F.concat(F.lit(" "), "p_type", F.lit(" "))
    told = text.in_vocabulary(raw, ["promo", "small", "large"], {"economy": "small"})
    return load(spark, sf_dir, "part").select("p_partkey", told.alias("v")).select("p_partkey", "v.*")


@query("SELECT p_partkey, regexp_matches(p_name, '^(red|blue)') AS is_event, p_type NOT IN ('STANDARD', 'MEDIUM') AS is_special, CASE WHEN regexp_matches(p_name, '^(red|blue)') THEN 'event' WHEN p_type NOT IN ('STANDARD', 'MEDIUM') THEN 'special' ELSE 'official' END AS section_class FROM part")
def section_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind a section is, by its name."""
    event, special = F.col("p_name").rlike("^(red|blue)"), ~F.col("p_type").isin("STANDARD", "MEDIUM")
    return load(spark, sf_dir, "part").select("p_partkey", event.alias("is_event"), special.alias("is_special"), classify.ladder([(event, "event"), (special, "special")], "official").alias("section_class"))


@query("SELECT o_orderkey, l_shipdate_day, CASE WHEN o_orderstatus = 'F' THEN 'away' WHEN k = n THEN 'last day' WHEN k > 1 THEN 'on the way' ELSE 'first day' END AS status, 'day ' || k || ' of ' || n AS text FROM (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) + CAST(x AS INTEGER) AS l_shipdate_day, x + 1 AS k, o_orderkey % 3 + 1 AS n FROM orders, (SELECT unnest(range(3)) AS x) WHERE x <= o_orderkey % 3)")
def day_k_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short status for each day of a span, and which day of how many it is."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("s"), (F.col("o_orderkey") % 3 + 1).alias("n"))
    rows = o.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).withColumn("k", F.col("x") + 1)
    status = classify.ladder([(F.col("o_orderstatus") == "F", "away"), (F.col("k") == F.col("n"), "last day"), (F.col("k") > 1, "on the way")], "first day")
    return rows.select("o_orderkey", F.date_add("s", F.col("x").cast("int")).alias("l_shipdate_day"), status.alias("status"), F.concat(F.lit("day "), "k", F.lit(" of "), "n").alias("text"))


@query(f"""WITH p AS (SELECT p_partkey AS k, p_brand, p_size, {_TOKENS} AS w FROM part), q AS (SELECT k, p_brand, p_size, w[1] AS a, w[-1] AS b FROM p),
t AS (SELECT k, p_brand, p_size, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM p),
x AS (SELECT q.k AS short, t.k AS long, min(CASE WHEN token = a THEN pos END) AS first_a, max(CASE WHEN token = a THEN pos END) AS last_a, min(CASE WHEN token = b THEN pos END) AS first_b, max(CASE WHEN token = b THEN pos END) AS last_b
  FROM q JOIN t ON q.p_brand = t.p_brand AND q.p_size = t.p_size AND q.k <> t.k GROUP BY 1, 2)
SELECT short, long, coalesce(first_a < last_b, false) AS ordered, coalesce(first_b < last_a, false) AS reversed FROM x""")
def token_subsequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two tokens of one name stand in another in the same order, or in the other one."""
    p = _part_tokens(spark, sf_dir)
    short = p.select(F.col("p_partkey").alias("a"), "p_brand", "p_size", F.array(F.element_at("tokens", 1), F.element_at("tokens", -1)).alias("x"))
    long = p.select(F.col("p_partkey").alias("b"), "p_brand", "p_size", F.col("tokens").alias("y"))
    told = lambda w, tokens: F.struct(text.ordered_subsequence(w, tokens).alias("ordered"), text.ordered_subsequence(F.reverse(w), tokens).alias("reversed"))
    return matching.scored_pairs(short, long, ["p_brand", "p_size"], told, ["ordered", "reversed"]).where("a <> b").withColumnsRenamed({"a": "short", "b": "long"})


@query(f"""WITH p AS (SELECT p_partkey AS k, p_brand, p_size, {_TOKENS} AS w FROM part), q AS (SELECT p_partkey AS k, p_brand, p_size, [substr(str_split(p_name, ' ')[1], 2), lower(p_type) || 'x'] AS w FROM part),
x AS (SELECT q.k AS short, p.k AS long, q.w AS a, p.w AS b FROM q JOIN p ON q.p_brand = p.p_brand AND q.p_size = p.p_size), t AS (SELECT short, long, a, b, unnest(range(1, len(b) + 1)) AS i FROM x),
h AS (SELECT short, long, min(CASE WHEN levenshtein(b[i], a[1]) <= 1 THEN i END) AS first, max(CASE WHEN levenshtein(b[i], a[2]) <= 1 THEN i END) AS last FROM t GROUP BY 1, 2)
SELECT short, long, coalesce(first < last, false) AS aligned FROM h""")
def fuzzy_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: tokens of one name in order against another's, each within one edit."""
    p = _part_tokens(spark, sf_dir)
    short = p.select(F.col("p_partkey").alias("a"), "p_brand", "p_size", F.array(F.expr("substr(tokens[0], 2)"), F.concat(F.element_at("tokens", -1), F.lit("x"))).alias("x"))
    long = p.select(F.col("p_partkey").alias("b"), "p_brand", "p_size", F.col("tokens").alias("y"))
    told = lambda w, tokens: F.struct(text.fuzzy_subsequence(w, tokens, 1).alias("aligned"))
    return matching.scored_pairs(short, long, ["p_brand", "p_size"], told, ["aligned"]).withColumnsRenamed({"a": "short", "b": "long"})


@query(f"""WITH p AS (SELECT p_partkey AS k, p_brand, p_size, p_type, str_split(p_name, ' ') AS w FROM part)
SELECT a.k AS a, b.k AS b, CAST(CASE WHEN a.w[1] = b.w[1] AND a.w[2] = b.w[2] THEN 2 WHEN a.w[1] = b.w[1] OR a.w[2] = b.w[2] OR a.w[1] = b.w[2] OR a.w[2] = b.w[1] THEN 1 ELSE 0 END AS INTEGER) AS common,
  CAST(round(100 * (0.30::DOUBLE * CASE WHEN a.w[1] = b.w[1] THEN 1 ELSE 0 END + 0.35::DOUBLE * CASE WHEN a.w[2] = b.w[2] THEN 1 ELSE 0 END + 0.25::DOUBLE * CASE WHEN a.w[1] = b.w[1] AND a.w[2] = b.w[2] THEN 2 WHEN a.w[1] = b.w[1] OR a.w[2] = b.w[2] OR a.w[1] = b.w[2] OR a.w[2] = b.w[1] THEN 1 ELSE 0 END / 2 + 0.10::DOUBLE * CASE WHEN a.p_type = b.p_type THEN 1 ELSE 0 END)) AS BIGINT) AS score
FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.k < b.k""")
def person_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain weighted score of two names: 0.30 first token, 0.35 last, 0.25 longest common subsequence, 0.10 code (C5 is person_matches)."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.struct(F.col("p_type").alias("t"), F.split("p_name", " ").alias("w")).alias("v"))
    yes = lambda c: c.cast("int").cast("double")

    def told(x: Column, y: Column) -> Column:
        common, wa, wb = text.common_subsequence(x["w"], y["w"]), x["w"], y["w"]
        parts = F.lit(0.30) * yes(F.element_at(wa, 1) == F.element_at(wb, 1)) + F.lit(0.35) * yes(F.element_at(wa, -1) == F.element_at(wb, -1)) + F.lit(0.25) * common / F.greatest(F.size(wa), F.size(wb)) + F.lit(0.10) * yes(x["t"] == y["t"])
        return F.struct(common.alias("common"), F.round(F.lit(100) * parts).cast("bigint").alias("score"))

    return matching.scored_pairs(p.toDF("a", "p_brand", "p_size", "x"), p.toDF("b", "p_brand", "p_size", "y"), ["p_brand", "p_size"], told, ["common", "score"]).where("a < b")


@query(f"""WITH p AS (SELECT p_partkey AS k, p_brand, p_size, list_distinct({_TOKENS} || [CAST(p_size % 4 AS VARCHAR)]) AS w, p_size % 4 AS number FROM part), x AS (SELECT a.k AS a, b.k AS b, 2.0::DOUBLE * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) AS f1, a.number <> b.number AS conflict FROM p a JOIN p b ON a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 1 AND a.k < b.k)
SELECT a, b, round(CASE WHEN conflict THEN least(f1, 0.55) ELSE f1 END, 6) AS score FROM x""")
def token_f1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of two names' tokens, at most 0.55 where their numbers differ (C6, with the ratio, is in aligned_services)."""
    p = _part_tokens(spark, sf_dir).select("p_partkey", "p_brand", "p_size", F.concat("tokens", F.array((F.col("p_size") % 4).cast("string"))).alias("w"))
    near = p.withColumn("at", F.explode(F.array(F.col("p_size") - 1, F.col("p_size"), F.col("p_size") + 1)))
    a, b = near.select(F.col("p_partkey").alias("a"), "p_brand", "at", F.col("w").alias("x")), p.select(F.col("p_partkey").alias("b"), "p_brand", F.col("p_size").alias("at"), F.col("w").alias("y"))
    return matching.scored_pairs(a, b, ["p_brand", "at"], lambda x, y: F.struct(F.round(text.token_f1(x, y, 0.55), 6).alias("score")), ["score"]).where("a < b")


@query("""WITH d AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 9 + 1 AS INTEGER) AS n FROM orders)
SELECT id, CASE WHEN id % 3 = 0 THEN day END AS s, CASE WHEN id % 3 = 0 THEN day + n END AS e, CASE WHEN id % 3 = 1 THEN 'rest' WHEN id % 3 = 2 THEN 'sick' ELSE '' END AS status, CAST(CASE WHEN id % 3 = 1 THEN least(n, 5) END AS INTEGER) AS k, CAST(CASE WHEN id % 3 = 1 THEN 5 END AS INTEGER) AS of_n FROM d""")
def leave_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals (with a roll-over of the year), counters k/n and statuses out of free text."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 9 + 1).cast("int").alias("n"))
    short = lambda c: F.date_format(c, "d/M")
    written = F.when(F.col("id") % 3 == 0, F.concat(F.lit("rest from "), short(F.col("day")), F.when(F.col("id") % 2 == 0, " to ").otherwise(" حتى "), short(F.date_add("day", F.col("n"))))).when(F.col("id") % 3 == 1, F.concat(F.lit("on rest ("), F.least("n", F.lit(5)).cast("string"), F.lit("/5)"))).otherwise("called in sick")
    told = text.leave_interval(written, F.year("day"))
    status = F.when(F.col("id") % 3 == 0, "").otherwise(text.by_keyword(written, [("sick", ["sick"]), ("rest", ["rest"])], ""))
    return o.select("id", told.alias("x"), status.alias("status")).select("id", "x.s", "x.e", "status", "x.k", "x.of_n")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') || ',' || strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') AS days, dayname(ts) AS weekday FROM events")
def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates of a text, whichever way they are written, and its weekday; marks of direction are dropped."""
    e = load(spark, sf_dir, "events")
    written = F.concat(F.lit("‏on "), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "EEEE")).otherwise(dates.weekday_name(F.col("ts").cast("date"))), F.lit(" "), F.date_format("ts", "d/M/yyyy"), F.lit("‎ until "), F.date_format(F.date_add(F.col("ts").cast("date"), 3), "yyyy-MM-dd"), F.lit(" 45/45/2020"))
    return e.select("event_id", F.array_join(text.dates_in(written), ",").alias("days"), text.weekday_in(written).alias("weekday"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name || ' ' || CAST(p_size AS VARCHAR) || ' fi' END AS clean FROM part")
def compatibility_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility characters and digits folded, placeholders blank."""
    p = load(spark, sf_dir, "part")
    wide = F.translate(F.col("p_size").cast("string"), "0123456789", "０１２３４５６７８９")
    raw = F.when(F.col("p_size") % 5 == 0, " --- ").otherwise(F.concat(F.col("p_name"), F.lit("  "), wide, F.lit(" ﬁ")))
    return p.select("p_partkey", text.compatible(raw).alias("clean"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Col' WHEN 1 THEN 'Maj' ELSE '' END AS rank, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || ':30' ELSE '' END AS time FROM customer")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank before a name and time behind it."""
    key = F.col("c_custkey")
    written = F.concat(F.when(key % 3 == 0, "Col / ").when(key % 3 == 1, "Maj/").otherwise(""), F.col("c_name"), F.when(key % 2 == 0, F.concat(F.lit(" ("), key % 24, F.lit(":30)"))).otherwise(""))
    return load(spark, sf_dir, "customer").select("c_custkey", text.name_parts(written, ["Col", "Maj"]).alias("x")).select("c_custkey", "x.*")


@query("""WITH n AS (SELECT p_name FROM part UNION SELECT p_name || 's' FROM part), w AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN substr(p_name, 1, 2) || 'z' || substr(p_name, 3) WHEN 1 THEN p_name || 'z' ELSE 'qq' || p_name END AS found FROM part), c AS (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_partkey) AS n FROM w JOIN n ON levenshtein(found, p_name) <= 1)
SELECT w.p_partkey, found, min(CASE WHEN n = 1 THEN p_name END) AS fixed, CASE WHEN coalesce(max(n), 0) = 1 THEN 'high' WHEN max(n) > 1 THEN 'medium' ELSE 'low' END AS confidence FROM w LEFT JOIN c USING (p_partkey) GROUP BY 1, 2""")
def spelling_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A misspelt name is mended if just one known name is a single edit away."""
    p = load(spark, sf_dir, "part")
    way = F.col("p_size") % 3
    misspelt = F.when(way == 0, F.concat(F.substring("p_name", 1, 2), F.lit("z"), F.expr("substr(p_name, 3)"))).when(way == 1, F.concat("p_name", F.lit("z"))).otherwise(F.concat(F.lit("qq"), "p_name"))
    written = p.select("p_partkey", misspelt.alias("found"))
    known = p.select("p_name").union(p.select(F.concat("p_name", F.lit("s"))))
    texts = written.select(F.col("found").alias("t"), F.lit(0).alias("known")).unionAll(known.select("p_name", F.lit(1))).distinct()
    keyed = texts.select(F.concat(F.col("known").cast("string"), "t").alias("k"), "t")
    pairs = matching.near_spellings(keyed, "k", "t").where("substr(a, 1, 1) <> substr(b, 1, 1)").select(F.expr("substr(a, 2)").alias("found"), F.expr("substr(b, 2)").alias("name"))
    best = pairs.groupBy("found").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    fixed, sure = F.when(F.col("n") == 1, F.col("name")), F.when(F.col("n") == 1, "high").when(F.col("n") > 1, "medium").otherwise("low")
    return written.join(best, "found", "left").select("p_partkey", "found", fixed.alias("fixed"), sure.alias("confidence"))


_PLATES = "known AS (SELECT s_suppkey % 40 AS number, min('S' || s_nationkey) AS series, count(*) AS n FROM supplier GROUP BY 1)"


@query(f"""WITH {_PLATES} SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'none' WHEN k.n IS NULL THEN 'unregistered' WHEN k.n > 1 AND p_size % 3 = 0 THEN 'ambiguous' WHEN p_size % 4 = 1 AND 'S' || p_size <> series THEN 'mismatch' ELSE 'ok' END AS verdict FROM part LEFT JOIN known k ON number = p_size""")
def plate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written plate against the registered ones: ok, none, unregistered, ambiguous or mismatch."""
    known = load(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 40).alias("number")).agg(F.min(F.concat(F.lit("S"), "s_nationkey")).alias("series"), F.count("*").alias("n"))
    rows = load(spark, sf_dir, "part").withColumn("number", F.col("p_size").cast("bigint")).join(known, "number", "left")
    size = F.col("p_size")
    rules = [(size % 10 == 0, "none"), (F.col("n").isNull(), "unregistered"), ((F.col("n") > 1) & (size % 3 == 0), "ambiguous"), ((size % 4 == 1) & (F.concat(F.lit("S"), "p_size") != F.col("series")), "mismatch")]
    return rows.select("p_partkey", classify.ladder(rules, "ok").alias("verdict"))


_SHORT = """c AS (SELECT q.p_partkey AS short, p.p_partkey AS long, abs(q.p_size - p.p_size) <= 1 AS near FROM part q JOIN part p ON str_split(q.p_name, ' ')[1] = str_split(p.p_name, ' ')[1] AND q.p_brand = p.p_brand AND q.p_type = p.p_type AND q.p_partkey <> p.p_partkey),
g AS (SELECT short, count(*) AS n, count(*) FILTER (near) AS m, min(long) AS one, min(CASE WHEN near THEN long END) AS narrowed FROM c GROUP BY 1)"""


@query(f"WITH {_SHORT} SELECT short, CASE WHEN n = 1 THEN one WHEN m = 1 THEN narrowed END AS long, CASE WHEN n = 1 THEN 'single' WHEN m = 1 THEN 'by rank' ELSE 'ambiguous' END AS how FROM g")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short name's person: the only one who begins so, else the only one of a near rank."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.substring_index("p_name", " ", 1).alias("first"))
    on = ["p_brand", "p_type", "first"]
    both = p.withColumnsRenamed({"p_partkey": "short", "p_size": "a"}).join(p.withColumnsRenamed({"p_partkey": "long", "p_size": "b"}), on).where("short <> long")
    near = F.abs(F.col("a") - F.col("b")) <= 1
    g = both.groupBy("short").agg(F.count("*").alias("n"), F.count_if(near).alias("m"), F.min("long").alias("one"), F.min(F.when(near, F.col("long"))).alias("narrowed"))
    long = F.when(F.col("n") == 1, F.col("one")).when(F.col("m") == 1, F.col("narrowed"))
    return g.select("short", long.alias("long"), F.when(F.col("n") == 1, "single").when(F.col("m") == 1, "by rank").otherwise("ambiguous").alias("how"))


@query("""WITH c AS (SELECT q.p_partkey AS k, p.p_partkey AS target, length(p.p_name) AS size FROM part q JOIN part p ON q.p_brand = p.p_brand AND str_split(q.p_name, ' ')[1] = str_split(p.p_name, ' ')[1] AND q.p_type = p.p_type), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY size DESC, target) AS n, count(*) OVER (PARTITION BY k) AS m FROM c) SELECT k, target, m AS candidates FROM r WHERE n = 1""")
def longest_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several compatible candidates the one with the longest name; what is kept is one struct for each key."""
    p = load(spark, sf_dir, "part").withColumn("first", F.substring_index("p_name", " ", 1))
    targets = p.groupBy("p_brand", "first", "p_type").agg(F.max_by(F.col("p_partkey"), F.struct(F.length("p_name"), -F.col("p_partkey"))).alias("target"), F.count("*").alias("candidates"))
    return p.join(targets, ["p_brand", "first", "p_type"]).select(F.col("p_partkey").alias("k"), "target", "candidates")


@query("""WITH r AS (SELECT p_brand AS list, p_partkey AS row, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, p_size FROM part), a AS (SELECT list, pos - p_size AS shift, count(*) AS n FROM r WHERE row % 2 = 0 GROUP BY 1, 2), x AS (SELECT list, arg_max(shift, struct_pack(n := n, s := -shift)) AS shift, max(n) AS votes, sum(n) AS anchors FROM a GROUP BY 1)
SELECT list, shift, votes, CAST(anchors AS BIGINT) AS anchors, CAST(round(100.0::DOUBLE * votes / anchors) AS BIGINT) AS confidence FROM x WHERE anchors >= 4""")
def order_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much two orders of a list differ: the most frequent offset of at least four given anchors (E10 is aligned_services)."""
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = load(spark, sf_dir, "part").select(F.col("p_brand").alias("list"), F.col("p_partkey").alias("row"), at.alias("at"), "p_size").where("row % 2 = 0")
    votes = rows.groupBy("list", (F.col("at") - F.col("p_size")).cast("bigint").alias("shift")).agg(F.count("*").alias("n"))
    best = votes.groupBy("list").agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"), F.max("n").alias("votes"), F.sum("n").alias("anchors")).where("anchors >= 4")
    return best.withColumn("confidence", F.round(F.lit(100.0) * F.col("votes") / F.col("anchors")).cast("bigint"))


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS day, user_id % 10 || ':' || event_type AS key, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id % 10, event_type ORDER BY event_id) AS occurrence FROM events), k AS (SELECT DISTINCT day, key || '#' || occurrence AS sig FROM s), n AS (SELECT day, count(*) AS n FROM k GROUP BY 1), c AS (SELECT a.day, count(*) AS shared FROM k a JOIN k b ON b.day = a.day - 1 AND a.sig = b.sig GROUP BY 1)
SELECT n.day, n.n, coalesce(shared, 0) AS shared, round(2.0::DOUBLE * coalesce(shared, 0) / (n.n + p.n), 6) AS ratio FROM n JOIN n p ON p.day = n.day - 1 LEFT JOIN c ON c.day = n.day""")
def day_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row signatures numbered by occurrence, and how alike each day is to the day before.

    Occurrences of a key are numbered 1 to n on each day, so what two days share of a key is the lesser of its counts.
    """
    e = load(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), (F.col("user_id") % 10).alias("k"), "event_type")
    counts = e.groupBy("day", "k", "event_type").agg(F.count("*").alias("n"))
    before = counts.select(F.date_add("day", 1).alias("day"), "k", "event_type", F.col("n").alias("m"))
    shared = counts.join(before, ["day", "k", "event_type"]).groupBy("day").agg(F.sum(F.least("n", "m")).alias("shared"))
    sums = counts.groupBy("day").agg(F.sum("n").alias("n"))
    both = sums.join(sums.select(F.date_add("day", 1).alias("day"), F.col("n").alias("p")), "day").join(shared, "day", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return both.select("day", "n", "shared", F.round(F.lit(2.0) * F.col("shared") / (F.col("n") + F.col("p")), 6).alias("ratio"))


@query("""SELECT p_brand, p_name, count(*) AS members, count(*) FILTER (p_size > 45) AS anchors, count(DISTINCT p_type) AS codes, max(p_size) - min(p_size) AS spread, count(*) FILTER (p_size > 45) <= 1 AND count(DISTINCT p_type) <= 1 AND max(p_size) - min(p_size) <= 10 AS may_merge FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def merge_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether groups of equal names may become one, as a report (E3, E5 are resolution_events and cluster_invariants)."""
    g = load(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("members"), F.count_if(F.col("p_size") > 45).alias("anchors"), F.countDistinct("p_type").alias("codes"), (F.max("p_size") - F.min("p_size")).alias("spread"))
    return g.where("members > 1").withColumn("may_merge", F.expr("anchors <= 1 AND codes <= 1 AND spread <= 10"))


@query("""WITH r AS (SELECT p_brand, p_name, p_type, min(p_partkey) AS first, max(p_size) AS most, count(*) AS n FROM part GROUP BY 1, 2, 3), m AS (SELECT p_brand, p_name, mode(p_type) AS any_type FROM part GROUP BY 1, 2)
SELECT p_brand, p_name, CAST(sum(n) AS BIGINT) AS n, arg_max(p_type, struct_pack(n := n, f := -first)) AS usual_type, string_agg(p_type, ',' ORDER BY p_type) AS types, max(most) AS most FROM r GROUP BY 1, 2""")
def derived_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue by name: the usual kind (of equally frequent ones the first seen), all kinds, the most."""
    r = load(spark, sf_dir, "part").groupBy("p_brand", "p_name", "p_type").agg(F.min("p_partkey").alias("first"), F.max("p_size").alias("most"), F.count("*").alias("n"))
    return r.groupBy("p_brand", "p_name").agg(F.sum("n").alias("n"), F.max_by("p_type", F.struct("n", -F.col("first"))).alias("usual_type"), F.array_join(F.array_sort(F.collect_list("p_type")), ",").alias("types"), F.max("most").alias("most"))


@query("SELECT event_id, CASE WHEN contains(props, '5') THEN 'sick' WHEN event_type = 'error' THEN 'absent' WHEN contains(props, '7') OR event_type = 'signup' THEN 'rest' WHEN event_type = 'view' THEN 'guard' ELSE 'work' END AS bucket FROM events")
def text_only_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's bucket from its text alone, in an order of its own."""
    props, kind = F.col("props"), F.col("event_type")
    rules = [(props.contains("5"), "sick"), (kind == "error", "absent"), (props.contains("7") | (kind == "signup"), "rest"), (kind == "view", "guard")]
    return load(spark, sf_dir, "events").select("event_id", classify.ladder(rules, "work").alias("bucket"))


@query("SELECT o_orderkey, CASE WHEN raw = '' THEN 'blank' WHEN try_cast(raw AS DATE) IS NULL THEN 'malformed' ELSE 'ok' END AS verdict FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-13-%d') ELSE 'soon' END AS raw FROM orders)")
def parameter_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank parameters are allowed, malformed ones are not."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(key % 4 == 0, "").when(key % 4 == 1, F.date_format(day, "yyyy-MM-dd")).when(key % 4 == 2, F.date_format(day, "yyyy-'13'-dd")).otherwise("soon")
    verdict = F.when(raw == "", "blank").when(F.try_to_date(raw, "yyyy-MM-dd").isNull(), "malformed").otherwise("ok")
    return load(spark, sf_dir, "orders").select("o_orderkey", verdict.alias("verdict"))
