"""Outlines of regions, polygon coverage, patches, scale extrema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outlines as O
from ..operators import patches as P
from ..operators import regions as G
from .registry import PIXELS_SQL, pixels, query, table

W = f"WITH {PIXELS_SQL}"
_L = "l AS (SELECT p_partkey AS id, p_partkey // 3 AS site, p_partkey % 3 AS x, p_partkey * 2 % 3 AS y, 2 + CAST(p_size AS BIGINT) % 8 AS w, 2 + p_partkey % 5 AS h FROM part)"


@query(f"""{W}, q AS (SELECT *, v % 3 AS k FROM px), near AS (SELECT a.k, a.row, a.col, count(b.k) AS same FROM q a LEFT JOIN q b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND a.k = b.k GROUP BY 1, 2, 3)
  SELECT k, CAST(count(*) AS DOUBLE) AS area, CAST(sum(4 - same) AS BIGINT) AS perimeter FROM near GROUP BY k""")
def polygonise(spark: SparkSession, sf: str) -> DataFrame:
    """Area and perimeter of each class from the rings of its regions: holes count as negative area."""
    p = pixels(spark, sf).select("row", "col", (F.col("v") % 3).alias("k"))
    regions = G.components(p, "k", False, None)
    classes = regions.groupBy("component").agg(F.max("k").alias("k"))
    return O.measured(O.outlines(regions)).join(classes, "component").groupBy("k").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"))


@query(f"""WITH {_L}, cells AS (SELECT site, id, x + i AS x, y + j AS y FROM l, range(0, 10) a(i), range(0, 7) b(j) WHERE i < w AND j < h AND (i = 0 OR j = 0)), n AS (SELECT site, count(*) AS n FROM l GROUP BY 1),
  c AS (SELECT site, x, y, count(*) AS m FROM cells GROUP BY 1, 2, 3) SELECT site, n, CAST(count(*) AS DOUBLE) AS union_area, CAST(count(*) FILTER (m = n) AS DOUBLE) AS common_area, round(100.0 * count(*) FILTER (m = n) / count(*), 6) AS common_percent FROM c JOIN n USING (site) GROUP BY 1, 2""")
def union_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Areas that the L-shaped polygons of a site cover, any and all of them."""
    k, x, y = F.col("p_partkey"), F.col("p_partkey") % 3, F.col("p_partkey") * 2 % 3
    w, h = 2 + F.col("p_size") % 8, 2 + F.col("p_partkey") % 5
    polygons = table(spark, sf, "part").select(
        F.floor(k / 3).alias("site"), k.alias("id"), F.array(x, x + w, x + w, x + 1, x + 1, x, x).alias("xs"), F.array(y, y, y + 1, y + 1, y + h, y + h, y).alias("ys")
    )
    found = O.coverage(polygons, "site", 64.0)
    return found.select("site", "n", F.round("union_area", 6).alias("union_area"), F.round("common_area", 6).alias("common_area"), F.round(F.col("common_area") * 100 / F.col("union_area"), 6).alias("common_percent"))


@query(f"""{W}, p AS (SELECT s_suppkey AS patch, s_suppkey * 7 % 3 AS r0, s_suppkey * 11 % 46 AS c0, s_suppkey % 7 + 1 AS t FROM supplier), q AS (SELECT patch, t, row - r0 AS i, col - c0 AS j, v, cls FROM p JOIN px ON row - r0 BETWEEN 0 AND 3 AND col - c0 BETWEEN 0 AND 3)
  SELECT patch, CASE t WHEN 1 THEN 3 - i WHEN 2 THEN i WHEN 3 THEN j WHEN 4 THEN 3 - j WHEN 5 THEN 3 - i WHEN 6 THEN j ELSE i END AS row, CASE t WHEN 1 THEN j WHEN 2 THEN 3 - j WHEN 3 THEN i WHEN 4 THEN i WHEN 5 THEN 3 - j WHEN 6 THEN 3 - i ELSE j END AS col, v, cls FROM q""")
def train_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of four by four pixels, each moved by one of seven transforms, image and mask alike."""
    k = F.col("s_suppkey")
    places = table(spark, sf, "supplier").select(k.alias("patch"), (k * 7 % 3).alias("r0"), (k * 11 % 46).alias("c0"), (k % 7 + 1).alias("transform"))
    return P.cut_patches(pixels(spark, sf), places, 4, ["v", "cls"])


@query()
def scale_extrema(spark: SparkSession, sf: str) -> DataFrame:
    """Extrema among differences of Gaussians over blobs: part as a raster of 14 columns, a blob every 16 rows."""
    k = F.col("p_partkey")
    row, col = F.floor(k / 14), k % 14
    blob = F.exp(-(F.pow(row % 16 - 8, F.lit(2)) + F.pow(col - 7, F.lit(2))) / 8)
    p = table(spark, sf, "part").select(row.alias("row"), col.alias("col"), (blob * 100 + F.col("p_size") * 0.1).alias("v"))
    return P.scale_extrema(p, "v", [0.6, 1.2, 2.0, 3.2, 5.0], 1.0).withColumn("response", F.round("response", 6))
