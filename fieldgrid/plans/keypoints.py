"""Key points of a raster and matches of two images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keypoints as K
from .registry import query, table

_MATCHES = "m AS (SELECT p_partkey AS id, p_partkey * 37 % 997 + p_size * 0.01::DOUBLE AS x, p_partkey * 91 % 883 + 0.5::DOUBLE AS y, 2.0::DOUBLE AS k FROM part), q AS (SELECT id, x, y, x * 1.02 - y * 0.03 + 5 + CASE WHEN id % 7 = 0 THEN 40 + id % 90 ELSE 0 END AS u, x * 0.03 + y * 0.99 - 2 - CASE WHEN id % 7 = 0 THEN 25 + id % 60 ELSE 0 END AS v FROM m)"


@query(f"""WITH {_MATCHES}, n AS (SELECT * FROM (SELECT a.id, a.x, a.y, a.u, a.v, b.x AS x2, b.y AS y2, b.u AS u2, b.v AS v2, row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6), b.id) AS r FROM q a, q b WHERE a.id <> b.id) WHERE r <= 6),
  s AS (SELECT j.id, sqrt(pow(j.x - j.x2, 2) + pow(j.y - j.y2, 2)) AS a1, sqrt(pow(j.x - k.x2, 2) + pow(j.y - k.y2, 2)) AS b1, sqrt(pow(j.x2 - k.x2, 2) + pow(j.y2 - k.y2, 2)) AS c1,
    sqrt(pow(j.u - j.u2, 2) + pow(j.v - j.v2, 2)) AS a2, sqrt(pow(j.u - k.u2, 2) + pow(j.v - k.v2, 2)) AS b2, sqrt(pow(j.u2 - k.u2, 2) + pow(j.v2 - k.v2, 2)) AS c2 FROM n j JOIN n k ON k.id = j.id AND k.r > j.r),
  t AS (SELECT *, sqrt(greatest(0, (a1 + b1 + c1) * (b1 + c1 - a1) * (a1 + c1 - b1) * (a1 + b1 - c1))) / 4 AS s1, sqrt(greatest(0, (a2 + b2 + c2) * (b2 + c2 - a2) * (a2 + c2 - b2) * (a2 + b2 - c2))) / 4 AS s2 FROM s)
SELECT DISTINCT id FROM t WHERE a2 > 0 AND b2 > 0 AND c2 > 0 AND pow(1 - a1 / a2, 2) + pow(1 - b1 / b2, 2) + pow(1 - c1 / c2, 2) < 0.02 AND NOT (s1 < 0.1 AND s2 < 0.1)""")
def similar_triangles(spark: SparkSession, sf: str) -> DataFrame:
    """Matches, every seventh of them false, that triangles with near ones confirm."""
    k = F.col("p_partkey")
    m = table(spark, sf, "part").select(k.alias("id"), (k * 37 % 997 + F.col("p_size") * 0.01).alias("x"), (k * 91 % 883 + 0.5).alias("y"))
    off = lambda n: F.when(F.col("id") % 7 == 0, n).otherwise(0)
    x, y, i = F.col("x"), F.col("y"), F.col("id")
    m = m.withColumns({"u": x * 1.02 - y * 0.03 + 5 + off(40 + i % 90), "v": x * 0.03 + y * 0.99 - 2 - off(25 + i % 60)})
    return K.similar_triangles(m, 6, 0.02).select("id")


@query()
def descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """Directions and descriptors of places of a raster: part as a raster of 50 columns, a place every seventh row and fifth column."""
    k = F.col("p_partkey")
    raster = table(spark, sf, "part").select(F.floor(k / 50).alias("row"), (k % 50).alias("col"), (F.col("p_size") + k % 50 * 2).cast("double").alias("v"))
    points = raster.where("row % 7 = 3 AND col % 5 = 2").select((F.col("row") * 50 + F.col("col")).alias("id"), "row", "col")
    g = K.gradients(raster, "v")
    found = K.descriptors(K.orientations(points, g, "id", 1.6), g, ["id", "angle"], 1.6)
    return found.select("id", F.round("angle", 6).alias("angle"), F.transform("descriptor", lambda x: F.round(x, 6)).alias("descriptor"))
