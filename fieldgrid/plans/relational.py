"""Filters, joins, lookups, set operations, sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational as R
from .registry import EVENTS_SQL, PIXELS_SQL, events, pixels, query, table


@query("""SELECT c_custkey, c_name, n_name, round(1.0 * c_acctbal / (SELECT sum(c_acctbal) FROM customer) * 100, 6) AS share
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 ORDER BY share DESC, c_custkey LIMIT 100""")
def left_join_percent(spark: SparkSession, sf: str) -> DataFrame:
    """Left join, computed percentage, order and limit."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    whole = c.agg(F.sum("c_acctbal").alias("whole"))
    joined = c.where("c_acctbal > 0").join(n, c.c_nationkey == n.n_nationkey, "left").crossJoin(F.broadcast(whole))
    return joined.select("c_custkey", "c_name", "n_name", F.round(1.0 * F.col("c_acctbal") / F.col("whole") * 100, 6).alias("share")).orderBy(F.desc("share"), "c_custkey").limit(100)


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag <> 'N' AND l_discount > 0.05")
def attr_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_quantity >= 45 AND l_returnflag <> 'N' AND l_discount > 0.05").select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT DISTINCT p_brand FROM part")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_brand").distinct()


@query("SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def left_join_right_where(spark: SparkSession, sf: str) -> DataFrame:
    """A condition on the right side makes the left join an inner one, which the optimiser sees."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").where("n_regionkey = 2").select("s_suppkey", "s_name", "n_name")


@query("SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region, upper(n_name) AS loud, n_nationkey * 10 AS tens FROM nation")
def project_rename(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"), F.upper("n_name").alias("loud"), (F.col("n_nationkey") * 10).alias("tens"))


@query(f"WITH {PIXELS_SQL} SELECT row, col, v FROM px WHERE row BETWEEN 3 AND 12 AND col BETWEEN 10 AND 20")
def bbox_filter(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).where(R.bbox(F.col("row"), F.col("col"), 3, 10, 12, 20)).select("row", "col", "v")


@query(f"WITH {PIXELS_SQL} SELECT count(*) AS n, CAST(min(row) AS BIGINT) AS y0, CAST(max(row) AS BIGINT) AS y1, CAST(min(col) AS BIGINT) AS x0, CAST(max(col) AS BIGINT) AS x1 FROM px WHERE NOT (row BETWEEN 0 AND 1 AND col BETWEEN 0 AND 20)")
def delete_box_extent(spark: SparkSession, sf: str) -> DataFrame:
    """Rows outside a rectangle, and the extent of what is left."""
    kept = pixels(spark, sf).where(~R.bbox(F.col("row"), F.col("col"), 0, 0, 1, 20))
    return kept.agg(F.count("*").alias("n"), F.min("row").alias("y0"), F.max("row").alias("y1"), F.min("col").alias("x0"), F.max("col").alias("x1"))


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS id FROM part WHERE p_size > 45")
def running_id(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers 1..n in key order, by counts of key ranges and ranks within them: no task orders all rows."""
    p = table(spark, sf, "part").where("p_size > 45").select("p_partkey")
    return R.numbered(p, [], ["p_partkey"], F.floor(F.col("p_partkey") / 4096), "i").select("p_partkey", (F.col("i") + 1).alias("id"))


@query(f"WITH {PIXELS_SQL} SELECT row, col FROM px WHERE blue + green + red + nir <> 0 AND blue > 500")
def nodata_filter(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).where((F.col("blue") + F.col("green") + F.col("red") + F.col("nir") != 0) & (F.col("blue") > 500)).select("row", "col")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_join_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that have a partner, once however many there are."""
    rich = table(spark, sf, "customer").where("c_acctbal > 5000")
    o = table(spark, sf, "orders")
    return o.join(rich, o.o_custkey == rich.c_custkey, "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def anti_join_unseen(spark: SparkSession, sf: str) -> DataFrame:
    return R.unseen(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1) ON o_custkey = c_custkey""")
def first_match_lookup(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return R.first_match(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", ["o_orderkey"])


@query(f"""WITH {EVENTS_SQL}, both_ AS (SELECT user_id, event_type, t AS version, round(value, 2) AS value, 0 AS fresh FROM ev WHERE event_id % 3 <> 0
  UNION ALL SELECT user_id, event_type, t, round(value * 2, 2), 1 FROM ev WHERE event_id % 3 = 0)
  SELECT user_id, event_type, version, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY version DESC, fresh DESC, value DESC) AS r FROM both_) WHERE r = 1""")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    of = lambda k: e.where(k).select("user_id", "event_type", F.col("t").alias("version"), "value")
    stored = of("event_id % 3 <> 0").withColumn("value", F.round("value", 2))
    fresh = of("event_id % 3 = 0").withColumn("value", F.round(F.col("value") * 2, 2))
    return R.upsert(stored, fresh, ["user_id", "event_type"], "version")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("SELECT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def intersect_pairs(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda flag: table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return of("R").intersectAll(of("A"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def except_keys(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda s: table(spark, sf, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").subtract(of("O"))


@query("""WITH s AS (SELECT l_linenumber AS day, l_returnflag AS kind, max(struct_pack(k := l_orderkey, p := l_partkey, v := l_extendedprice)).v AS v FROM lineitem GROUP BY 1, 2)
  SELECT day, max(v) FILTER (kind = 'A') AS "A", max(v) FILTER (kind = 'N') AS "N", max(v) FILTER (kind = 'R') AS "R" FROM s GROUP BY day""")
def pivot_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by day, a column for each kind, the last value in each cell."""
    li = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("day"), F.col("l_returnflag").alias("kind"), F.struct("l_orderkey", "l_partkey", "l_extendedprice").alias("o"), F.col("l_extendedprice").alias("v"))
    return R.pivot_last(li, "day", "kind", ["A", "N", "R"], "v", "o")


@query("SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY o_custkey")
def max_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3")
def topk_order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) WHERE r <= 3")
def smallest_per_group(spark: SparkSession, sf: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id"))
    return table(spark, sf, "events").withColumn("r", r).where("r <= 3").select("user_id", "event_id", "value")


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, count(*) AS n, min(l_quantity + 0.0) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag")
def layer_sums(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count("*").alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@query(f"""WITH {EVENTS_SQL}, pairs AS (SELECT p.event_id, p.user_id, p.t, abs(p.t - v.t) AS gap, v.t AS time, v.value FROM ev p JOIN ev v ON p.user_id = v.user_id AND abs(p.t - v.t) <= 86400
  WHERE p.event_type = 'purchase' AND v.event_type = 'view') SELECT event_id, gap, time, value FROM
  (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, time, value) AS r FROM pairs) WHERE r = 1""")
def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    return R.nearest_in_time(left, e.where("event_type = 'view'"), ["user_id"], "t", "t", "value", 86400).select("event_id", "gap", "time", "value")


@query("""WITH m AS (SELECT count(*) AS n, p_size % 4 AS cls FROM part GROUP BY 2), s AS (SELECT p_partkey, p_size % 4 AS cls, row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) - 1 AS i FROM part)
  SELECT s.cls, p_partkey, CAST(copy AS BIGINT) AS copy FROM s JOIN m USING (cls), range(0, 1000) r(copy) WHERE i + copy * n < (SELECT max(n) FROM m)""")
def balance_replicate(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4).alias("cls"))
    return R.balance(p, "cls", ["p_partkey"], F.floor(F.col("p_partkey") / 512)).select("cls", "p_partkey", F.col("copy").cast("long").alias("copy"))


@query(f"""WITH {PIXELS_SQL}, poly AS (SELECT k, 5 + 8 * k AS x0, 2 + k AS y0 FROM range(0, 5) t(k))
  SELECT row, col, CAST(k AS BIGINT) AS k FROM px, poly WHERE col + 0.5 - x0 > 0 AND row + 0.5 - y0 > 0 AND (col + 0.5 - x0) / 7.0 + (row + 0.5 - y0) / 9.0 < 1""")
def pip_join(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel centres in triangles: a grid-cell equi-join, then the exact test."""
    tri = [(k, [5 + 8 * k, 12 + 8 * k, 5 + 8 * k, 5 + 8 * k], [2 + k, 2 + k, 11 + k, 2 + k]) for k in range(5)]
    poly = spark.createDataFrame([(k, [float(x) for x in xs], [float(y) for y in ys]) for k, xs, ys in tri], "k long, xs array<double>, ys array<double>")
    p = pixels(spark, sf).select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    return R.points_in_polygons(p, poly, 4.0).select("row", "col", "k")


@query(f"WITH {PIXELS_SQL} SELECT a.row, a.col, b.row AS crow, b.col AS ccol FROM px a JOIN px b ON (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= 9 WHERE b.v = 50")
def within_buffers(spark: SparkSession, sf: str) -> DataFrame:
    """Points within buffers of points, one row for each pair."""
    p = pixels(spark, sf)
    c = p.where("v = 50").select(F.col("row").alias("crow"), F.col("col").alias("ccol"))
    return R.within_distance(p.select("row", "col"), c, 3, "col", "row", "ccol", "crow")


@query(f"""WITH {PIXELS_SQL}, a AS (SELECT row * 50 + col AS id, col AS x0, row AS y0, col + v % 7 + 1 AS x1, row + v % 5 + 1 AS y1 FROM px), b AS (SELECT id AS oid, x0 AS ox0, y0 AS oy0, x1 AS ox1, y1 AS oy1 FROM a)
  SELECT id, oid, greatest(x0, ox0) AS ix0, greatest(y0, oy0) AS iy0, least(x1, ox1) AS ix1, least(y1, oy1) AS iy1 FROM a JOIN b ON x0 < ox1 AND ox0 < x1 AND y0 < oy1 AND oy0 < y1 WHERE id < oid""")
def box_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping rectangles and their intersections: each pair meets in one grid cell."""
    p = pixels(spark, sf)
    a = p.select((F.col("row") * 50 + F.col("col")).alias("id"), F.col("col").alias("x0"), F.col("row").alias("y0"), (F.col("col") + F.col("v") % 7 + 1).alias("x1"), (F.col("row") + F.col("v") % 5 + 1).alias("y1"))
    b = a.toDF("oid", "ox0", "oy0", "ox1", "oy1")
    return R.overlapping(a, b, 8).where("id < oid").select("id", "oid", "ix0", "iy0", "ix1", "iy1")


@query(f"""WITH {PIXELS_SQL}, a AS (SELECT row * 50 + col AS id, cls, col AS x0, row AS y0, col + v % 7 + 1 AS x1, row + v % 5 + 1 AS y1 FROM px)
  SELECT a.id, string_agg(DISTINCT CAST(b.id AS VARCHAR), '/' ORDER BY CAST(b.id AS VARCHAR)) AS ids, string_agg(DISTINCT CAST(b.cls AS VARCHAR), '/' ORDER BY CAST(b.cls AS VARCHAR)) AS kinds
  FROM a JOIN a b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY a.id""")
def self_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """For each rectangle the ids and classes of those that it overlaps, sorted as text."""
    p = pixels(spark, sf)
    a = p.select((F.col("row") * 50 + F.col("col")).alias("id"), "cls", F.col("col").alias("x0"), F.col("row").alias("y0"), (F.col("col") + F.col("v") % 7 + 1).alias("x1"), (F.col("row") + F.col("v") % 5 + 1).alias("y1"))
    b = a.toDF("oid", "ocls", "ox0", "oy0", "ox1", "oy1")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "/")
    return R.overlapping(a, b, 8).groupBy("id").agg(joined("oid").alias("ids"), joined("ocls").alias("kinds"))


@query("""SELECT o_orderkey, c.name AS band FROM orders LEFT JOIN (VALUES ('low', 0.0, 50000.0), ('mid', 50000.0, 150000.0), ('high', 150000.0, 1e9)) c(name, lo, hi) ON o_totalprice >= lo AND o_totalprice < hi""")
def legend_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Half-open ranges of a small legend."""
    legend = spark.createDataFrame([("low", 0.0, 50000.0), ("mid", 50000.0, 150000.0), ("high", 150000.0, 1e9)], "band string, lo double, hi double")
    o = table(spark, sf, "orders")
    return o.join(F.broadcast(legend), (o.o_totalprice >= legend.lo) & (o.o_totalprice < legend.hi), "left").select("o_orderkey", "band")


@query("""WITH c(k, year, v) AS (VALUES (0, 2022, 1.5), (0, 2023, 1.7), (1, 2023, 2.5)), m AS (SELECT k, max(year) AS top FROM c GROUP BY k), a AS (SELECT n_nationkey, n_nationkey % 2 AS k, 2022 + n_nationkey % 4 AS year FROM nation)
  SELECT n_nationkey, CAST(v AS DOUBLE) AS v FROM (SELECT a.*, CASE WHEN a.year = top + 1 THEN top ELSE a.year END AS use FROM a JOIN m USING (k)) x LEFT JOIN c ON c.k = x.k AND c.year = use""")
def coefficient_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients by year; the year after the last one known falls back to it."""
    c = spark.createDataFrame([(0, 2022, 1.5), (0, 2023, 1.7), (1, 2023, 2.5)], "k int, year int, v double")
    a = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") % 2).alias("k"), (2022 + F.col("n_nationkey") % 4).alias("year"))
    m = c.groupBy("k").agg(F.max("year").alias("top"))
    used = a.join(F.broadcast(m), "k").withColumn("year", F.when(F.col("year") == F.col("top") + 1, F.col("top")).otherwise(F.col("year")))
    return used.join(F.broadcast(c), ["k", "year"], "left").select("n_nationkey", "v")


@query("SELECT doc_id, CAST(crc32 AS INTEGER) AS fold FROM (SELECT doc_id, doc_id * 7919 % 10 AS crc32 FROM documents) WHERE crc32 >= 8")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """The test part of a deterministic 80/20 split."""
    return table(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 7919 % 10).cast("int").alias("fold")).where("fold >= 8")


@query(f"WITH {PIXELS_SQL} SELECT row, col, band, val FROM (UNPIVOT px ON blue, green, red, nir INTO NAME band VALUE val)")
def unstack_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Bands as rows."""
    return pixels(spark, sf).unpivot(["row", "col"], ["blue", "green", "red", "nir"], "band", "val")


@query("SELECT key, n FROM (SELECT CAST(k AS BIGINT) AS key, count(p_size) AS n FROM range(1, 61) t(k) LEFT JOIN part ON p_size = k GROUP BY k)")
def frequency_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each value from 1 to 60, zeros too."""
    faces = spark.range(1, 61).select(F.col("id").alias("key"))
    n = table(spark, sf, "part").groupBy(F.col("p_size").cast("long").alias("key")).agg(F.count("*").alias("n"))
    return faces.join(n, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
