"""Overlays and buffers of slanted polygons as geometry.

Diamonds are squares in turned coordinates u = x + y, v = x - y, so the SQL counts unit cells of these: each has half a unit of area,
and a side between a covered and an uncovered one is the root of a half long.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overlay as V
from .registry import query, table

_DIAMONDS = "d AS (SELECT p_partkey // 4 AS site, p_partkey % 2 AS layer, 8 + p_partkey % 7 AS x, 8 + p_partkey * 3 % 5 AS y, 1 + CAST(p_size AS BIGINT) % 3 AS r FROM part), u AS (SELECT DISTINCT site, layer, x + y - r + i AS a, x - y - r + j AS b FROM d, range(0, 6) p(i), range(0, 6) q(j) WHERE i < 2 * r AND j < 2 * r)"


def _measured(covered: str) -> str:
    return f"""WITH {_DIAMONDS}, c AS ({covered}), n AS (SELECT c.site, c.a, c.b, count(o.a) AS same FROM c LEFT JOIN c o ON o.site = c.site AND abs(o.a - c.a) + abs(o.b - c.b) = 1 GROUP BY 1, 2, 3)
SELECT site, round(count(*) / 2.0::DOUBLE, 6) AS area, round(sum(4 - same) * sqrt(0.5::DOUBLE), 6) AS perimeter FROM n GROUP BY site"""


def _overlaid(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y, r = 8 + k % 7, 8 + k * 3 % 5, 1 + F.col("p_size") % 3
    ring = lambda *c: F.array(*[v.cast("double") for v in c])
    diamonds = table(spark, sf, "part").select(F.floor(k / 4).alias("site"), k.alias("id"), (k % 2).alias("layer"), ring(x + r, x, x - r, x, x + r).alias("xs"), ring(y, y + r, y, y - r, y).alias("ys"))
    rings = V.measured(V.overlay(diamonds, "site", 8.0, kind), "site")
    return rings.groupBy("site").agg(F.round(F.sum("area"), 6).alias("area"), F.round(F.sum("perimeter"), 6).alias("perimeter"))


@query(_measured("SELECT DISTINCT site, a, b FROM u"))
def overlay_union(spark: SparkSession, sf: str) -> DataFrame:
    """Area and perimeter of what each site's diamonds cover."""
    return _overlaid(spark, sf, "union")


@query(_measured("SELECT site, a, b FROM u GROUP BY 1, 2, 3 HAVING count(*) = 2"))
def overlay_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """What diamonds of both layers cover."""
    return _overlaid(spark, sf, "intersection")


@query(_measured("SELECT site, a, b FROM u GROUP BY 1, 2, 3 HAVING max(layer) = 0"))
def overlay_difference(spark: SparkSession, sf: str) -> DataFrame:
    """What diamonds of the first layer cover and those of the second don't."""
    return _overlaid(spark, sf, "difference")


#: Area of a regular polygon of 32 corners on a circle of radius 2.5, and its perimeter.
_DISC, _ROUND = 16 * 2.5**2 * math.sin(math.pi / 16), 64 * 2.5 * math.sin(math.pi / 32)


@query(f"SELECT s_suppkey AS id, round(w * h + 5 * (w + h) + {_DISC!r}::DOUBLE, 5) AS area, round(2 * (w + h) + {_ROUND!r}::DOUBLE, 5) AS perimeter FROM (SELECT s_suppkey, 3.0::DOUBLE + s_suppkey % 4 AS w, 2.0::DOUBLE + s_suppkey % 5 AS h FROM supplier)")
def buffer_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Area and perimeter of rectangles widened by 2.5, with round corners."""
    k = F.col("s_suppkey")
    w, h, x = 3 + k % 4, 2 + k % 5, 5 + k % 3
    ring = lambda *c: F.array(*[v.cast("double") for v in c])
    boxes = table(spark, sf, "supplier").select(k.alias("id"), ring(x, x + w, x + w, x, x).alias("xs"), ring(x, x, x + h, x + h, x).alias("ys"))
    return V.measured(V.buffers(boxes.withColumnRenamed("id", "key"), "key", 2.5, 16.0), "key").select(F.col("key").alias("id"), F.round("area", 5).alias("area"), F.round("perimeter", 5).alias("perimeter"))
