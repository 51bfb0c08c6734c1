"""Inherited sheets, days assembled from records, comparison of sheets, catalogues with aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import records
from quarry.plans.domain import load
from quarry.plans.registry import query

_SET = """e AS (SELECT user_id % 40 AS row, CAST(ts AS DATE) AS day, event_id, event_type FROM events),
s AS (SELECT row, day, max(CASE WHEN event_type = 'click' THEN 'v' || event_id % 50 WHEN event_type = 'error' AND event_id % 3 = 0 THEN '' END) AS vehicle, max(CASE WHEN event_type = 'purchase' THEN 'p' || event_id % 9 END) AS plate, max(CASE WHEN event_type = 'signup' THEN 'd' || event_id % 30 WHEN event_type = 'error' AND event_id % 3 = 1 THEN '' END) AS driver FROM e GROUP BY 1, 2)"""
_BACK = "(SELECT max(p.day) FROM s p WHERE p.row = s.row AND p.day <= s.day AND p.day >= s.day - 31 AND ({}))"


@query(f"""WITH {_SET}, g AS (SELECT s.row, s.day, {_BACK.format("p.vehicle IS NOT NULL OR p.plate IS NOT NULL")} AS car_day, {_BACK.format("p.driver IS NOT NULL")} AS driver_day FROM s),
v AS (SELECT g.row, g.day, nullif(c.vehicle, '') AS vehicle, nullif(c.plate, '') AS plate, nullif(d.driver, '') AS driver, car_day, g.driver_day AS dd FROM g LEFT JOIN s c ON c.row = g.row AND c.day = car_day LEFT JOIN s d ON d.row = g.row AND d.day = g.driver_day)
SELECT row, day, vehicle, CASE WHEN vehicle IS NOT NULL THEN car_day END AS vehicle_day, vehicle IS NOT NULL AND car_day < day AS vehicle_inherited, plate, CASE WHEN plate IS NOT NULL THEN car_day END AS plate_day, plate IS NOT NULL AND car_day < day AS plate_inherited,
  driver, CASE WHEN driver IS NOT NULL THEN dd END AS driver_day, driver IS NOT NULL AND dd < day AS driver_inherited FROM v""")
def inherited_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet whose fields come from the last day that set them; vehicle and plate are reset together, a blank ends a field."""
    kind, number = F.col("event_type"), F.col("event_id")
    text = lambda start, n: F.concat(F.lit(start), number % n)
    name = F.when(kind == "click", "vehicle").when(kind == "purchase", "plate").when(kind == "signup", "driver").when((kind == "error") & (number % 3 == 0), "vehicle").when((kind == "error") & (number % 3 == 1), "driver")
    value = F.when(kind == "click", text("v", 50)).when(kind == "purchase", text("p", 9)).when(kind == "signup", text("d", 30)).otherwise("")
    rows = load(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("row"), F.col("ts").cast("date").alias("day"), name.alias("name"), value.alias("value"))
    empty = F.create_map().cast("map<string,string>")
    return records.inherited(rows.withColumn("fields", F.when(F.col("name").isNull(), empty).otherwise(F.create_map(F.coalesce("name", F.lit("")), "value"))), ["row"], "day", [["vehicle", "plate"], ["driver"]])


_RECORDS = """r AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS day, l_suppkey AS entity, l_orderkey * 10 + l_linenumber AS record, CASE l_returnflag WHEN 'A' THEN 'roster' WHEN 'N' THEN 'board' ELSE 'duty' END AS role, l_shipdate AS stamp, l_linestatus AS status, CASE WHEN l_linenumber % 4 = 0 THEN ' ' ELSE 's' || l_linenumber % 3 END AS shift, CASE WHEN l_quantity > 25 THEN CAST(CAST(l_quantity AS BIGINT) % 5 AS VARCHAR) END AS people FROM lineitem),
f AS (SELECT day, entity, 'status' AS field, status AS value, record, role, stamp FROM r UNION ALL SELECT day, entity, 'shift', shift, record, role, stamp FROM r UNION ALL SELECT day, entity, 'people', people, record, role, stamp FROM r),
p(field, role, place, rule) AS (VALUES ('status', 'roster', 1, 'roster status'), ('status', 'board', 2, 'board status'), ('status', 'duty', 3, 'duty status'), ('shift', 'board', 1, 'board shift'), ('shift', 'roster', 2, 'roster shift'), ('people', 'duty', 1, 'counted'), ('people', 'board', 2, 'board count')),
k AS (SELECT f.*, place, rule FROM f JOIN p ON p.field = f.field AND p.role = f.role WHERE trim(value) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY day, entity, field ORDER BY place, stamp DESC, record, value) AS n FROM k),
b AS (SELECT day, entity, field, value, rule, record FROM o WHERE n = 1),
c AS (SELECT b.*, count(*) FILTER (k.value = b.value) AS agreeing, count(*) FILTER (k.value <> b.value) AS conflicting FROM b JOIN k USING (day, entity, field) GROUP BY ALL)"""


def _day_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line, number = F.col("l_linenumber"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    role = F.when(F.col("l_returnflag") == "A", "roster").when(F.col("l_returnflag") == "N", "board").otherwise("duty")
    shift = F.when(line % 4 == 0, " ").otherwise(F.concat(F.lit("s"), line % 3))
    people = F.when(F.col("l_quantity") > 25, (F.col("l_quantity").cast("bigint") % 5).cast("string"))
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in (("status", F.col("l_linestatus")), ("shift", shift), ("people", people))])).alias("c")
    rows = load(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "MM").alias("day"), F.col("l_suppkey").alias("entity"), number.alias("record"), role.alias("role"), F.col("l_shipdate").cast("timestamp").alias("at"), cells).select("day", "entity", "c.*", "record", "role", "at")
    places = [("status", "roster", 1, "roster status"), ("status", "board", 2, "board status"), ("status", "duty", 3, "duty status"), ("shift", "board", 1, "board shift"), ("shift", "roster", 2, "roster shift"), ("people", "duty", 1, "counted"), ("people", "board", 2, "board count")]
    return rows, spark.createDataFrame(places, "field string, role string, place int, rule string")


@query(f"WITH {_RECORDS} SELECT * FROM c")
def assembled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of a day with its value, rule, record, and how many records agree or conflict."""
    return records.assembled(*_day_records(spark, sf_dir))[0]


@query(f"""WITH {_RECORDS}, w AS (SELECT day, entity, max(CASE WHEN field = 'status' THEN value END) AS status, max(CASE WHEN field = 'status' THEN rule END) AS status_rule, max(CASE WHEN field = 'shift' THEN value END) AS shift, max(CASE WHEN field = 'people' THEN value END) AS people, sum(conflicting) AS conflicts FROM c GROUP BY 1, 2)
SELECT day, coalesce(status, '') AS status, count(*) AS entities, CAST(sum(CAST(coalesce(people, '0') AS BIGINT)) AS BIGINT) AS people, count(*) FILTER (shift IS NULL) AS without_shift, count(*) FILTER (status_rule <> 'roster status') AS derived, CAST(sum(conflicts) AS BIGINT) AS conflicts FROM w GROUP BY 1, 2""")
def assembled_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's counts by state from the assembled cells, with what was derived and what conflicted."""
    cells = records.assembled(*_day_records(spark, sf_dir))[0]
    wide = records.pivoted(cells, ["status", "shift", "people"]).join(cells.groupBy("day", "entity").agg(F.sum("conflicting").alias("conflicts")), ["day", "entity"])
    status = F.coalesce("status", F.lit("")).alias("status")
    return wide.groupBy("day", status).agg(F.count("*").alias("entities"), F.sum(F.coalesce("people", F.lit("0")).cast("bigint")).alias("people"), F.count_if(F.col("shift").isNull()).alias("without_shift"), F.count_if(F.col("status_rule") != "roster status").alias("derived"), F.sum("conflicts").alias("conflicts"))


@query(f"WITH {_RECORDS} SELECT day, field, role, count(*) AS n, count(*) FILTER (k.value = b.value) AS agreeing FROM k JOIN (SELECT day, entity, field, value FROM b) b USING (day, entity, field) GROUP BY ALL")
def cell_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records behind the cells, counted by day, field and role."""
    return records.assembled(*_day_records(spark, sf_dir))[1].groupBy("day", "field", "role").agg(F.count("*").alias("n"), F.count_if("agrees").alias("agreeing"))


def sheets_to_compare(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A day's orders as two sheets: in the second some are gone, new, changed, or stand elsewhere."""
    o = load(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "MM").alias("day"), F.col("o_orderkey").alias("k"), F.concat_ws(" ", F.col("o_orderpriority"), (F.col("o_custkey") % 40).cast("string")).alias("name"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 7).cast("int").alias("people"))
    archive = o.where("k % 17 > 0").withColumn("place", F.col("k"))
    changed = o.where("k % 13 > 0").withColumns({"place": F.when(F.col("k") % 11 == 0, F.col("k") + 900).otherwise(F.col("k")), "status": F.when(F.col("k") % 10 == 0, " ").otherwise(F.col("status")), "people": F.when(F.col("k") % 19 == 0, F.col("people") + 1).otherwise(F.col("people"))})
    return archive, changed


@query()
def sheet_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows missing and extra, contents that differ, and rows out of the order that both share; tested against loops."""
    archive, system = sheets_to_compare(spark, sf_dir)
    return records.compared(archive, system, ["day"], "name", "place", ["status", "people"])


@query("""WITH o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, o_orderkey AS k, o_orderpriority || ' ' || o_custkey % 300 AS item FROM orders), a AS (SELECT day, k // 4 AS row, k % 2 AS half, item FROM o WHERE k % 17 > 0), s AS (SELECT day, CASE WHEN k % 11 = 0 THEN k // 4 + 1 ELSE k // 4 END AS row, k % 2 AS half, item FROM o WHERE k % 13 > 0),
shared AS (SELECT DISTINCT day, item FROM a WHERE (day, item) IN (SELECT day, item FROM s)), pa AS (SELECT DISTINCT x.day, x.item AS left_item, y.item AS right_item FROM a x JOIN a y ON x.day = y.day AND x.row = y.row AND x.half = 0 AND y.half = 1), ps AS (SELECT DISTINCT x.day, x.item AS left_item, y.item AS right_item FROM s x JOIN s y ON x.day = y.day AND x.row = y.row AND x.half = 0 AND y.half = 1),
d AS (SELECT *, 'archive' AS side FROM (SELECT * FROM pa EXCEPT SELECT * FROM ps) UNION ALL SELECT *, 'system' FROM (SELECT * FROM ps EXCEPT SELECT * FROM pa)) SELECT * FROM d WHERE (day, left_item) IN (SELECT day, item FROM shared) AND (day, right_item) IN (SELECT day, item FROM shared)""")
def packing_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs printed in one row by one of two sheets only."""
    o = load(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "MM").alias("day"), F.col("o_orderkey").alias("k"), F.concat_ws(" ", "o_orderpriority", (F.col("o_custkey") % 300).cast("string")).alias("item"))
    row = F.expr("k div 4")
    archive = o.where("k % 17 > 0").select("day", row.alias("row"), (F.col("k") % 2).alias("half"), "item")
    system = o.where("k % 13 > 0").select("day", F.when(F.col("k") % 11 == 0, row + 1).otherwise(row).alias("row"), (F.col("k") % 2).alias("half"), "item")
    return records.packing(archive, system, ["day"], "row", "half", "item")


@query("""WITH RECURSIVE m AS (SELECT p_partkey AS id, p_name || CASE WHEN p_partkey % 5 = 0 THEN ' x' WHEN p_partkey % 7 = 0 THEN ' y' ELSE '' END AS name, CASE WHEN p_size % 6 = 0 THEN ' ' ELSE p_type END AS party, CASE WHEN p_size % 8 > 0 THEN (p_size % 8) || ':00' END AS time FROM part),
al AS (SELECT DISTINCT p_name || ' x' AS alias, p_name AS name FROM part WHERE p_partkey % 3 = 0 UNION SELECT DISTINCT p_name || ' y', p_name || ' x' FROM part WHERE p_partkey % 4 = 0),
ed AS (SELECT alias AS a, name AS b FROM al UNION SELECT name, alias FROM al), re AS (SELECT a AS node, a AS reach FROM ed UNION SELECT re.node, ed.b FROM re JOIN ed ON ed.a = re.reach), ro AS (SELECT node, min(reach) AS root FROM re GROUP BY 1),
k AS (SELECT m.*, coalesce(root, name) AS root FROM m LEFT JOIN ro ON node = name), n1 AS (SELECT root, name, count(*) AS n, min(id) AS f FROM k GROUP BY 1, 2), p1 AS (SELECT root, party, count(*) AS n, min(id) AS f FROM k WHERE trim(party) <> '' GROUP BY 1, 2), t1 AS (SELECT root, time, count(*) AS n, min(id) AS f FROM k WHERE time IS NOT NULL GROUP BY 1, 2),
ns AS (SELECT coalesce(root, name) AS root, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT name FROM m UNION SELECT alias FROM al UNION SELECT name FROM al) LEFT JOIN ro ON node = name GROUP BY 1),
bn AS (SELECT root, name FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, f) AS w FROM n1) WHERE w = 1), bp AS (SELECT root, party, n AS party_n FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, f) AS w FROM p1) WHERE w = 1), bt AS (SELECT root, time, n AS time_n FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, f) AS w FROM t1) WHERE w = 1),
s AS (SELECT root, count(*) AS n, min(id) AS first FROM k GROUP BY 1)
SELECT bn.name, ns.names, s.n, s.first, party, party_n, time, time_n FROM bn JOIN s USING (root) JOIN ns USING (root) LEFT JOIN bp USING (root) LEFT JOIN bt USING (root)""")
def alias_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of names with an alias index joined to its end, and modes with a fixed rule for ties."""
    p, k, size = load(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    end = F.when(k % 5 == 0, " x").when(k % 7 == 0, " y").otherwise("")
    mentions = p.select(k.alias("id"), F.concat("p_name", end).alias("name"), F.when(size % 6 == 0, " ").otherwise(F.col("p_type")).alias("party"), F.when(size % 8 > 0, F.concat(size % 8, F.lit(":00"))).alias("time"))
    x, y = F.concat("p_name", F.lit(" x")), F.concat("p_name", F.lit(" y"))
    aliases = p.where(k % 3 == 0).select(x.alias("alias"), F.col("p_name").alias("name")).union(p.where(k % 4 == 0).select(y, x)).distinct()
    return records.catalogue(mentions, aliases, ["party", "time"]).withColumn("names", F.array_join("names", ","))
