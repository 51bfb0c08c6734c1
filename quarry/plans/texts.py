"""Scalar functions over whole columns of text and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dates, text
from quarry.plans.domain import load
from quarry.plans.registry import query

_FOLDED = "trim(regexp_replace(translate(regexp_replace(translate(lower(coalesce({0}, '')), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '[ً-ْٰـ]', '', 'g'), 'أإآٱىةؤئ', 'اااايهوي'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_FOLDED.format('text')} AS folded FROM documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts folded."""
    return load(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query(f"SELECT p_partkey, {_FOLDED.format('p_name')} AS name_key, {_FOLDED.format('p_brand')} AS brand_key, split_part(p_name, ' ', 1) AS first_unit FROM part")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of names."""
    return load(spark, sf_dir, "part").select("p_partkey", text.name_key(F.col("p_name")).alias("name_key"), text.name_key(F.col("p_brand")).alias("brand_key"), text.first_units(F.col("p_name"), 1).alias("first_unit"))


@query("""WITH s AS (SELECT p_partkey, list_sort(list_distinct(list_filter([trim(p_name), trim(lower(p_type)), CASE WHEN p_size % 2 = 0 THEN trim(p_name) ELSE 'other' END], lambda x: x <> ''))) AS a, list_sort([trim(p_name), trim(lower(p_type))]) AS b FROM part)
SELECT p_partkey, array_to_string(a, '+') AS parts, CASE WHEN a = b THEN 'exact' WHEN list_has_all(a, b) THEN 'superset' WHEN list_has_any(a, b) THEN 'overlap' ELSE 'different' END AS verdict FROM s""")
def service_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: sets of parts, and how two compare."""
    other = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("other")
    a = text.service_parts(F.concat_ws("+", "p_name", "p_type", other))
    b = text.service_parts(F.concat_ws("+", "p_name", "p_type"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(a, "+").alias("parts"), text.compare_parts(a, b).alias("verdict"))


@query("SELECT event_id, strftime(ts, '%H:%M') AS clock, hour(ts) * 60 + minute(ts) + CASE WHEN hour(ts) < 6 THEN 1440 ELSE 0 END AS place, CASE WHEN user_id % 12 BETWEEN 1 AND 6 THEN user_id % 12 + 12 ELSE user_id % 12 END * 60 AS bare FROM events")
def parse_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock times in text, and their place in a duty day."""
    e = load(spark, sf_dir, "events")
    said = F.concat(F.lit("from "), F.date_format("ts", "HH:mm"), F.lit(" on"))
    bare = F.concat(F.lit("at "), (F.col("user_id") % 12).cast("string"))
    return e.select("event_id", text.clock(said).alias("clock"), text.sort_minutes(said).cast("bigint").alias("place"), text.clock_minutes(bare).cast("bigint").alias("bare"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN '01' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS phone, CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n FROM customer")
def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers found in text, separators dropped, once each."""
    number = F.concat(F.lit("01"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    other = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" or 015"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))).otherwise("")
    said = F.concat(F.lit("call "), F.substring(number, 1, 4), F.lit("-"), F.substring(number, 5, 7), F.lit(" or "), number, other, F.lit(" not 0123"))
    said = F.when(F.col("c_custkey") % 5 == 0, "call 0123").otherwise(said)
    found = text.phones(said)
    return load(spark, sf_dir, "customer").select("c_custkey", F.get(found, F.lit(0)).alias("phone"), F.size(found).alias("n"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'AB ' || CAST(s_suppkey % 9000 + 100 AS VARCHAR) WHEN 1 THEN 'CD ' || CAST(s_suppkey % 9000 + 100 AS VARCHAR) ELSE CAST(s_suppkey % 9000 + 100 AS VARCHAR) END AS plate FROM supplier")
def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates in several forms."""
    n = (F.col("s_suppkey") % 9000 + 100).cast("string")
    said = F.when(F.col("s_suppkey") % 3 == 0, F.concat(n, F.lit("-ab"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("cd "), n)).otherwise(F.concat(F.lit("("), n, F.lit(")")))
    return load(spark, sf_dir, "supplier").select("s_suppkey", text.plate(said).alias("plate"))


@query("SELECT p_partkey, CAST(p_size + p_size % 4 AS INTEGER) AS total, CASE WHEN p_size % 4 = 0 THEN 'guards' ELSE 'drivers' END AS last_class FROM part")
def counted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of counts and classes in text."""
    said = F.concat(F.col("p_size").cast("string"), F.lit(" guards"), F.when(F.col("p_size") % 4 != 0, F.concat(F.lit(", "), (F.col("p_size") % 4).cast("string"), F.lit(" drivers"))).otherwise(""))
    found = text.counted_classes(said)
    return load(spark, sf_dir, "part").select("p_partkey", F.aggregate(found, F.lit(0), lambda n, x: n + x["n"]).alias("total"), F.element_at(found, -1)["class"].alias("last_class"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%bolt%' OR p_name LIKE '%nut%' THEN 'fastener' ELSE 'other' END AS class, 'Brand ' || split_part(p_brand, '#', 2) AS label, concat_ws(' - ', p_type, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END) AS caption FROM part")
def keyword_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword classes, labels, captions."""
    name = F.col("p_name")
    kind = F.when(name.contains("ring"), "ring").when(name.contains("bolt") | name.contains("nut"), "fastener").otherwise("other")
    size = F.when(F.col("p_size") > 10, F.col("p_size").cast("string"))
    return load(spark, sf_dir, "part").select("p_partkey", kind.alias("class"), F.concat(F.lit("Brand "), F.element_at(F.split("p_brand", "#"), 2)).alias("label"), F.concat_ws(" - ", "p_type", size).alias("caption"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE NULL END AS canonical, CAST((isodow(o_orderdate) + 1) % 7 AS INTEGER) AS weekday,
CAST(o_orderdate AS DATE) + CAST((o_orderkey % 7 - (isodow(o_orderdate) + 1) % 7 + 13) % 7 + 1 AS INTEGER) AS next_day, CAST(day(last_day(o_orderdate)) AS INTEGER) AS month_days FROM orders""")
def date_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT1-DT5: canonical days, weekdays, next weekday, days of a month."""
    o = load(spark, sf_dir, "orders")
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    said = F.when(key % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 4 == 1, F.date_format(day, " yyyyMMdd ")).when(key % 4 == 2, F.date_format(day, "yyyy-M-'x'")).otherwise("2024-02-31")
    return o.select("o_orderkey", dates.canonical_day(said).alias("canonical"), dates.weekday_index(day).alias("weekday"), dates.next_weekday(day, key % 7).alias("next_day"), F.size(dates.month_days(day)).alias("month_days"))


@query("""WITH p AS (SELECT event_id, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT event_id, CASE WHEN b IS NULL THEN 'unknown' ELSE 'minutes' END AS precision, CASE WHEN b IS NOT NULL THEN CAST(greatest(date_diff('microsecond', a, b) // 60000000, 0) AS BIGINT) END AS minutes, CASE WHEN b IS NOT NULL THEN CAST(b AS DATE) - CAST(a AS DATE) + 1 <= 2 END AS short FROM p""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT6-DT8: time to a person's next event, its precision, and whether a range is short."""
    from pyspark.sql import Window

    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = load(spark, sf_dir, "events").select("event_id", F.col("ts").alias("a"), nxt.alias("b"))
    d = dates.duration(F.col("a"), F.col("b"))
    return pairs.select("event_id", d["precision"].alias("precision"), F.when(F.col("b").isNotNull(), d["minutes"]).alias("minutes"), dates.valid_range(F.col("a").cast("date"), F.col("b").cast("date"), 2).alias("short"))


@query("WITH t AS (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT event_id, user_id, CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL 5 DAY ELSE ts END AS ts FROM events)) SELECT event_id FROM t WHERE ts < top")
def clock_moved_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT10: rows earlier than one that came before."""
    from pyspark.sql import Window

    moved = load(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 50 == 0, F.col("ts") - F.expr("INTERVAL '5' DAY")).otherwise(F.col("ts")).alias("ts"))
    top = F.max("ts").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return moved.withColumn("top", top).where("ts < top").select("event_id")


@query("SELECT c_custkey, c_name[1:8] AS a, split_part(c_name, '#', 2) AS b, split_part(c_name, '#', 2) AS c FROM customer")
def split_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists split and padded by their last part."""
    parts = text.split_padded(F.col("c_name"), "#", 3)
    return load(spark, sf_dir, "customer").select("c_custkey", parts[0].alias("a"), parts[1].alias("b"), parts[2].alias("c"))


@query("SELECT lang, list_sort(list(n_chars))[greatest(1, CAST(floor(count(*) * 0.9) AS BIGINT))] AS width FROM documents GROUP BY lang")
def discrete_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element at a share of a group's ordered values, found from counts of distinct values."""
    from pyspark.sql import Window

    counts = load(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang")
    placed = counts.withColumns({"upto": F.sum("n").over(by.orderBy("n_chars")), "at": F.greatest(F.lit(1), F.floor(F.sum("n").over(by) * F.lit(0.9)))})
    return placed.where("upto >= at").groupBy("lang").agg(F.min("n_chars").alias("width"))
