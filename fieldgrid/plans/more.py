"""Window vectors, points on rasters, proximity, overviews, reclassing, tables of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learning as L
from ..operators import neighbours as N
from ..operators import raster as R
from ..operators import regions as G
from ..operators import registration as M
from ..operators import zonal as Z
from .registry import PIXELS_SQL, pixels, query, table

W = f"WITH {PIXELS_SQL}"


@query(f"{W} SELECT a.row, a.col FROM px a JOIN px b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col HAVING min(b.v) > 5 AND count(*) = 9")
def patch_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels whose whole square is above a level."""
    f = R.focal(R.focal(pixels(spark, sf), "v", "least", "min"), "v", "m", "mean")
    return f.where("least > 5 AND m_n = 9").select("row", "col")


@query(f"{W}, o AS (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j)), f AS (SELECT a.row, a.col, list(coalesce(b.v, 0) ORDER BY i, j) AS fv, list(coalesce(b.cls, 0) ORDER BY i, j) AS fc FROM px a, o LEFT JOIN px b ON b.row = a.row + i AND b.col = a.col + j WHERE a.v > 0 GROUP BY 1, 2) SELECT row, col, array_to_string(list_concat(fv, fc), ',') AS features FROM f")
def window_vectors(spark: SparkSession, sf: str) -> DataFrame:
    w = R.window_vectors(pixels(spark, sf), ["v", "cls"], 1)
    return w.select("row", "col", F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("features"))


@query(f"{W}, p AS (SELECT c_custkey, 1000 + c_custkey * 7 % 1600 AS x, 5000 - c_custkey * 11 % 1300 AS y FROM customer) SELECT c_custkey, v FROM p LEFT JOIN px ON row = CAST(floor((5000 - y) / 30.0) AS BIGINT) AND col = CAST(floor((x - 1000) / 30.0) AS BIGINT)")
def raster_at_points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select("c_custkey", (1000 + k * 7 % 1600).alias("x"), (5000 - k * 11 % 1300).alias("y"))
    return R.at_points(pixels(spark, sf).select("row", "col", "v"), p, 1000.0, 30.0, 5000.0, -30.0).select("c_custkey", "v")


@query(f"{W}, b AS (SELECT row, col FROM px WHERE v = 50) SELECT a.row, a.col, round(sqrt(min(CASE WHEN (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= 36 THEN (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) END)), 6) AS d FROM px a LEFT JOIN b ON abs(a.row - b.row) <= 6 AND abs(a.col - b.col) <= 6 GROUP BY 1, 2")
def proximity(spark: SparkSession, sf: str) -> DataFrame:
    """Distance to the nearest pixel of one value."""
    return R.proximity(pixels(spark, sf).select("row", "col", "v"), F.col("v") == 50, "d", 6).select("row", "col", F.round("d", 6).alias("d"))


@query(f"{W} SELECT CAST(k AS INTEGER) AS level, row // CAST(pow(2, k) AS BIGINT) AS row, col // CAST(pow(2, k) AS BIGINT) AS col, round(avg(v), 6) AS mean FROM px, range(1, 4) t(k) GROUP BY 1, 2, 3, k")
def pyramid(spark: SparkSession, sf: str) -> DataFrame:
    return R.pyramid(pixels(spark, sf), "v", 3).withColumn("mean", F.round("mean", 6))


@query(f"{W} SELECT row, col, CASE cls WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 99 END AS cls FROM px")
def reclassify(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.createDataFrame([(0, 10), (1, 20)], "from long, to int")
    return R.reclassify(pixels(spark, sf).select("row", "col", "cls"), "cls", m, 99)


@query(f"{W} SELECT row, col, CAST(blue AS DOUBLE) AS blue, CAST(green AS DOUBLE) AS green FROM px")
def gs_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """Bands back from their orthogonal forms."""
    g = Z.gram_schmidt(pixels(spark, sf).select("row", "col", "nir", "blue", "green"), ["nir", "blue", "green"])
    b = Z.gram_schmidt_inverse(g, ["nir", "blue", "green"])
    return b.select("row", "col", F.round("back_blue", 4).alias("blue"), F.round("back_green", 4).alias("green"))


@query(f"{W} SELECT row, col, CASE WHEN blue >= 600 THEN CASE WHEN nir >= 2000 THEN 3 ELSE 2 END ELSE 1 END AS cls FROM px")
def tree_predict(spark: SparkSession, sf: str) -> DataFrame:
    nodes = [(0, "blue", 600.0, 1, 2, None), (1, None, None, None, None, 1), (2, "nir", 2000.0, 3, 4, None), (3, None, None, None, None, 2), (4, None, None, None, None, 3)]
    p = pixels(spark, sf)
    return p.select("row", "col", L.tree_predict(p, nodes).alias("cls"))


@query("""WITH e AS (SELECT label, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), m AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM e GROUP BY 1, 2), g AS (SELECT i, avg(v) AS g FROM e GROUP BY i)
  SELECT round((SELECT sum(n * (m - g) * (m - g)) FROM m JOIN g USING (i)) / (count(DISTINCT label) - 1) / (sum((v - m) * (v - m)) / (count(*) / 64 - count(DISTINCT label))), 6) AS score FROM e JOIN m USING (label, i)""")
def calinski_harabasz(spark: SparkSession, sf: str) -> DataFrame:
    return L.calinski_harabasz(table(spark, sf, "embeddings"), "label", "embedding").select(F.round("score", 6).alias("score"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_partkey AS id FROM part WHERE p_size > 25),
  n AS (SELECT a.id, o.id AS other FROM p a JOIN p o ON o.id <> a.id AND abs(o.row - a.row) <= 1 AND abs(o.col - a.col) <= 1),
  r(id, root) AS (SELECT id, id FROM p UNION SELECT n.other, r.root FROM r JOIN n ON n.id = r.id WHERE r.root < n.other),
  g AS (SELECT count(*) AS size FROM (SELECT id, min(root) AS root FROM r GROUP BY id) GROUP BY root HAVING count(*) > 3)
SELECT CAST(sum(CASE WHEN size > 30 THEN 2 ELSE 1 END) AS BIGINT) AS objects, min(size) AS least, max(size) AS most FROM g""")
def region_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of more than a few pixels; the large ones count twice."""
    p = pixels(spark, sf).select("row", "col", F.when(F.col("v") > 25, 1).otherwise(0).alias("b"))
    sizes = G.region_sizes(G.components(p, "b", width=50)).where("size > 3")
    return sizes.agg(F.sum(F.when(F.col("size") > 30, 2).otherwise(1)).alias("objects"), F.min("size").alias("least"), F.max("size").alias("most"))


@query("SELECT s_suppkey AS id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(100 + s_suppkey % 7 + i * ((1.0::DOUBLE + s_nationkey) / 4), 9) AS x, round(20 + s_suppkey % 5 + j * (0.5::DOUBLE / 2), 9) AS y FROM supplier, range(0, 5) a(i), range(0, 3) b(j)")
def grid_points(spark: SparkSession, sf: str) -> DataFrame:
    """A grid over each supplier's extent: evenly spaced points, both ends included."""
    k, steps = F.col("s_suppkey"), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    g = table(spark, sf, "supplier").select(k, (100 + k % 7).alias("x0"), (20 + k % 5).alias("y0"), (1.0 + F.col("s_nationkey")).alias("w")).withColumn("i", steps(4)).withColumn("j", steps(2))
    return g.select(k.alias("id"), "i", "j", F.round(F.col("x0") + F.col("i") * (F.col("w") / 4), 9).alias("x"), F.round(F.col("y0") + F.col("j") * (0.5 / 2), 9).alias("y"))


@query("SELECT p_partkey AS id, CAST(k AS INTEGER) AS tier, CAST(ceil((5000 + p_size * 100) / pow(2, k) / 256) AS BIGINT) AS columns, CAST(ceil((3000 + p_partkey % 500) / pow(2, k) / 256) AS BIGINT) AS rows FROM part, range(0, 6) t(k)")
def zoom_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of each tier of images, one for each part, that are halved until they fit one tile."""
    t = table(spark, sf, "part").withColumn("tier", F.explode(F.sequence(F.lit(0), F.lit(5))))
    many = lambda n: F.ceil(n / F.pow(F.lit(2.0), "tier") / 256)
    return t.select(F.col("p_partkey").alias("id"), "tier", many(5000 + F.col("p_size") * 100).alias("columns"), many(3000 + F.col("p_partkey") % 500).alias("rows"))


@query("SELECT c_custkey, 'seg' AS key, lower(c_mktsegment) AS value, CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) AS BIGINT) AS place FROM customer")
def maps_and_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Text to a map, a key out of it, and a place in a sorted list."""
    pairs = F.str_to_map(F.concat(F.lit("seg="), F.lower("c_mktsegment"), F.lit(";k="), F.col("c_custkey")), F.lit(";"), F.lit("="))
    names = F.sort_array(F.array(*map(F.lit, ["MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"])))
    place = F.nullif(F.array_position(names, F.col("c_mktsegment")), F.lit(0))
    return table(spark, sf, "customer").select("c_custkey", F.element_at(F.map_keys(pairs), 1).alias("key"), F.element_at(pairs, "seg").alias("value"), F.coalesce(place, F.lit(None).cast("long")).alias("place"))


@query("SELECT supplier.s_suppkey AS station, n.c_custkey AS cell, r FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS r FROM customer, supplier) n JOIN supplier USING (s_suppkey) WHERE r <= 3")
def nearest_stations(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest stations of each cell."""
    c, s = table(spark, sf, "customer").select("c_custkey", "c_acctbal"), table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    apart = F.abs(F.col("c_acctbal") - F.col("s_acctbal"))
    near = N.nearest(c, s, ["c_custkey"], [F.col("c_acctbal")], [F.col("s_acctbal")], apart, "s_suppkey", 3, decimals=None)
    return near.select(F.col("s_suppkey").alias("station"), F.col("c_custkey").alias("cell"), F.col("r").cast("long").alias("r"))


@query("""WITH c AS (SELECT c_custkey, c_acctbal AS x, c_custkey * 7919 % 20000 AS y FROM customer), s AS (SELECT s_suppkey, s_acctbal AS x, s_suppkey * 104729 % 15000 + s_nationkey AS y FROM supplier)
SELECT c_custkey, s_suppkey, round(d, 4) AS d, r FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(d, 6), s_suppkey) AS r FROM (SELECT c_custkey, s_suppkey, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS d FROM c, s)) WHERE r <= 4""")
def nearest_places(spark: SparkSession, sf: str) -> DataFrame:
    """The four nearest places in the plane; a quarter of the cells lie beyond all stations."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("cx"), (F.col("c_custkey") * 7919 % 20000).cast("double").alias("cy"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("sx"), (F.col("s_suppkey") * 104729 % 15000 + F.col("s_nationkey")).cast("double").alias("sy"))
    dx, dy = F.col("cx") - F.col("sx"), F.col("cy") - F.col("sy")
    near = N.nearest(c, s, ["c_custkey"], [F.col("cx"), F.col("cy")], [F.col("sx"), F.col("sy")], F.sqrt(dx * dx + dy * dy), "s_suppkey", 4)
    return near.select("c_custkey", "s_suppkey", F.round("distance", 4).alias("d"), F.col("r").cast("long").alias("r"))


@query("SELECT p_partkey AS id, round(l_x, 3) AS x, CAST(p_size % 9 + 3 AS INTEGER) AS dx FROM (SELECT *, (p_retailprice - 900) / 1100 * 255 AS l_x FROM part)")
def linear_rescale(spark: SparkSession, sf: str) -> DataFrame:
    """A height in one scale as a value in another, and an offset in a sample."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round((F.col("p_retailprice") - 900) / 1100 * 255, 3).alias("x"), (F.col("p_size") % 9 + 3).alias("dx"))




@query(f"{W} SELECT zone, round(abs(corr(blue, nir)), 6) AS ncc FROM px GROUP BY zone")
def window_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return M.correlation(pixels(spark, sf), "zone", "blue", "nir").select("zone", F.round("ncc", 6).alias("ncc"))


@query("SELECT 2.0::DOUBLE AS a, 0.5::DOUBLE AS b, -3.0::DOUBLE AS c, -0.25::DOUBLE AS d, 1.5::DOUBLE AS e, 7.0::DOUBLE AS f, count(*) AS inliers FROM part WHERE p_partkey % 4 <> 0")
def consensus_affine(spark: SparkSession, sf: str) -> DataFrame:
    """An affine map found among matches of which a quarter is wrong."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("id"), (k * 37 % 101).cast("double").alias("x"), (k * 53 % 97).cast("double").alias("y"))
    wrong = F.when(F.col("id") % 4 == 0, 500.0 + F.col("id") * 13 % 89).otherwise(0.0)
    m = p.select("id", "x", "y", (2 * F.col("x") + 0.5 * F.col("y") - 3 + wrong).alias("u"), (-0.25 * F.col("x") + 1.5 * F.col("y") + 7 - wrong).alias("v"))
    return M.consensus_affine(m, 64, 0.5).select(*[F.round(c, 6).alias(c) for c in "abcdef"], "inliers")


@query()
def soil_line(spark: SparkSession, sf: str) -> DataFrame:
    return M.soil_line(pixels(spark, sf).withColumn("level", F.floor(F.col("red") / 50)), "level", "nir", 3, 4, 3)


_NAMES = ["blue", "green", "red", "nir"]


@query()
def forest_regression(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf)
    return L.forest_regressor(p, _NAMES, "v", 5, 20).transform(p).select("row", "col", "v", F.round("prediction", 6).alias("prediction"))


@query()
def perceptron(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).withColumn("y", (F.col("v") > 25).cast("double"))
    return L.perceptron(p, _NAMES, "y", 8, 2, 20).transform(p).select("row", "col", "y", "prediction")
