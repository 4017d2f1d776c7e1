"""Polygons on rasters, rasters turned and rescaled, strips of columns, layers of a folder, objects in scripts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outlines as O
from ..operators import raster as R
from ..operators import shapes as S
from ..sources import files, web
from .registry import PIXELS_SQL, pixels, query, table

W = f"WITH {PIXELS_SQL}"
_TRIANGLES = "poly AS (SELECT k, 5 + 8 * k AS x0, 2 + k AS y0 FROM range(0, 5) t(k))"
_INSIDE = "col + 0.5 - x0 > 0 AND row + 0.5 - y0 > 0 AND (col + 0.5 - x0) / 7.0 + (row + 0.5 - y0) / 9.0 < 1"


def _triangles(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    ring = lambda *c: F.array(*[x.cast("double") for x in c])
    return spark.range(5).select(k.alias("k"), ring(5 + 8 * k, 12 + 8 * k, 5 + 8 * k, 5 + 8 * k).alias("xs"), ring(2 + k, 2 + k, 11 + k, 2 + k).alias("ys"))


@query(f"{W}, s AS (SELECT *, unnest(list_distinct([col // 9, CASE WHEN col >= 2 THEN (col - 2) // 9 ELSE col // 9 END, least(col + 2, 49) // 9])) AS strip FROM px) SELECT strip, count(*) AS n, count(*) FILTER (col // 9 = strip) AS core, CAST(sum(v) AS BIGINT) AS v FROM s GROUP BY strip")
def column_strips(spark: SparkSession, sf: str) -> DataFrame:
    s = R.strips(pixels(spark, sf), 9, 2, F.lit(49), "col")
    return s.groupBy("strip").agg(F.count("*").alias("n"), F.count_if("core").alias("core"), F.sum("v").alias("v"))


@query(f"{W}, {_TRIANGLES} SELECT k, row, col, CASE WHEN {_INSIDE} THEN v ELSE -1 END AS v FROM px JOIN poly ON col + 0.5 BETWEEN x0 AND x0 + 7 AND row + 0.5 BETWEEN y0 AND y0 + 9")
def clip_cutline(spark: SparkSession, sf: str) -> DataFrame:
    """The raster cut to each triangle's bounds, no data outside the triangle."""
    return S.clip_by_cutline(pixels(spark, sf), _triangles(spark), "k", "v", (0.0, 1.0, 0.0, 1.0), 4.0, -1)


@query(f"{W}, {_TRIANGLES} SELECT k, count(*) FILTER ({_INSIDE} AND cls = 0) AS n, round(count(*) FILTER ({_INSIDE} AND cls = 0) * 900.0::DOUBLE / 666.67, 4) AS area FROM poly, px GROUP BY k")
def class_area_in_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Area of class 0 in each triangle, pixels being 30 m wide."""
    metres = lambda c: F.transform(c, lambda x: x * 30)
    t = _triangles(spark).withColumns({"xs": metres("xs"), "ys": metres("ys")})
    return S.class_area_in_polygons(pixels(spark, sf), t, "k", "cls", 0, (0.0, 30.0, 0.0, 30.0), 120.0)


@query(f"""{W}, b AS (SELECT s_suppkey AS id, s_suppkey * 7 % 45 AS x0, s_suppkey * 11 % 30 AS y0, CASE WHEN s_suppkey % 5 = 0 THEN 40 ELSE 2 + s_suppkey % 4 END AS w FROM supplier)
  SELECT id, row, col FROM b JOIN px ON pow(greatest(x0 - col - 0.5, col + 0.5 - x0 - w, 0), 2) + pow(greatest(y0 - row - 0.5, row + 0.5 - y0 - 3, 0), 2) <= 6.25""")
def polygon_buffers(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel centres in rectangles, small and large, or within 2.5 of them."""
    k = F.col("s_suppkey")
    x, y, w = k * 7 % 45, k * 11 % 30, F.when(k % 5 == 0, 40).otherwise(2 + k % 4)
    ring = lambda *c: F.array(*[v.cast("double") for v in c])
    boxes = table(spark, sf, "supplier").select(k.alias("id"), ring(x, x + w, x + w, x, x).alias("xs"), ring(y, y, y + 3, y + 3, y).alias("ys"))
    p = pixels(spark, sf).select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    return S.near_polygons(p, boxes, 2.5, 2.0).select("id", "row", "col")


@query("""WITH l AS (SELECT p_partkey // 3 AS site, p_partkey % 3 AS x, p_partkey * 2 % 3 AS y, 2 + CAST(p_size AS BIGINT) % 8 AS w, 2 + p_partkey % 5 AS h FROM part),
  c AS (SELECT DISTINCT site, x + i AS x, y + j AS y FROM l, range(0, 10) a(i), range(0, 7) b(j) WHERE i < w AND j < h AND (i = 0 OR j = 0)),
  n AS (SELECT a.site, a.x, a.y, count(b.x) AS same FROM c a LEFT JOIN c b ON a.site = b.site AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2, 3)
  SELECT site, CAST(count(*) AS DOUBLE) AS area, CAST(sum(4 - same) AS BIGINT) AS perimeter FROM n GROUP BY site""")
def union_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Area and perimeter of the united outline of each site's L-shaped polygons; holes count as negative area."""
    k, x, y = F.col("p_partkey"), F.col("p_partkey") % 3, F.col("p_partkey") * 2 % 3
    w, h = 2 + F.col("p_size") % 8, 2 + F.col("p_partkey") % 5
    polygons = table(spark, sf, "part").select(F.floor(k / 3).alias("site"), F.array(x, x + w, x + w, x + 1, x + 1, x, x).alias("xs"), F.array(y, y, y + 1, y + 1, y + h, y + h, y).alias("ys"))
    rings = O.measured(S.united_outlines(polygons, "site", 16), "site")
    return rings.groupBy("site").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"))


@query(f"{W}, s AS (SELECT max(row) + 1 AS n FROM px) SELECT r AS row, c AS col, v FROM s, range(0, 75) b(c), range(0, (SELECT (3 * n + 1) // 2 + 1 FROM s)) a(r) JOIN px ON px.row = (2 * r + 1) * 2 // 6 AND px.col = (2 * c + 1) * 2 // 6")
def rescale(spark: SparkSession, sf: str) -> DataFrame:
    """A raster one and a half times as wide and high, by the nearest pixel."""
    return S.rescaled(pixels(spark, sf).select("row", "col", "v"), 3, 2)


@query(f"""{W}, s AS (SELECT max(row) / 2.0::DOUBLE AS cy, 24.5::DOUBLE AS cx FROM px), t AS (SELECT row, col, CAST(floor(round(cy + (col - cx) * {math.sin(math.radians(30))!r}::DOUBLE + (row - cy) * {math.cos(math.radians(30))!r}::DOUBLE, 9) + 0.5) AS BIGINT) AS r,
  CAST(floor(round(cx + (col - cx) * {math.cos(math.radians(30))!r}::DOUBLE - (row - cy) * {math.sin(math.radians(30))!r}::DOUBLE, 9) + 0.5) AS BIGINT) AS c FROM px, s) SELECT t.row, t.col, px.v FROM t LEFT JOIN px ON px.row = r AND px.col = c""")
def rotate_angle(spark: SparkSession, sf: str) -> DataFrame:
    """A raster turned by 30 degrees."""
    p = pixels(spark, sf).select("row", "col", "v")
    rows = (p.agg(F.max("row")).first()[0] or 0) + 1
    return S.turned(p, "v", 30.0, rows, 50)


_LAYERS = "region nation customer supplier part orders lineitem events".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS layer, (SELECT count(*) FROM {t}) AS rows, (SELECT count(*) FROM (DESCRIBE {t})) AS columns" for t in _LAYERS))
def layer_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of a folder, each with its number of rows and columns."""
    found = files.files(spark, sf, "*.parquet").where(F.col("name").isin([f"{t}.parquet" for t in _LAYERS]))
    paths = {r["name"].removesuffix(".parquet"): f"{sf}/{r['name']}" for r in found.select("name").collect()}  # a row for each layer
    return files.layers(spark, paths)


@query("SELECT c_custkey, c_custkey % 7 AS aqi, [c_custkey % 3, c_custkey % 5] AS hours, 'a};\nb' || c_custkey AS note FROM customer")
def script_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects that scripts of pages assign to a variable: nested, over line breaks, with ends of objects inside texts."""
    k = F.col("c_custkey")
    made = F.to_json(F.struct((k % 7).alias("aqi"), F.array(k % 3, k % 5).alias("hours"), F.struct(F.concat(F.lit("a};\nb"), k).alias("note")).alias("more")))
    html = F.concat(F.lit("<script>\nvar first = {\"aqi\": 1};\nvar data =\n"), F.replace(made, F.lit(","), F.lit(",\n")), F.lit(";\nvar last = {};\n</script>"))
    pages = table(spark, sf, "customer").select(k, html.alias("html"))
    return web.embedded_json(pages, "data", "aqi long, hours array<long>, more struct<note:string>").select("c_custkey", "data.aqi", "data.hours", "data.more.note")
