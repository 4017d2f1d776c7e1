"""Vector layers written as shapefiles and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_root
from ..sources import vectors as V
from .registry import query, table


def _polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles, each with a hole where its part's key is even."""
    k, w = F.col("p_partkey"), F.col("p_size").cast("double")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = (k % 100).cast("double"), F.floor(k / 100).cast("double")
    outer = F.array(point(x, y), point(x, y + w), point(x + w, y + w), point(x + w, y), point(x, y))
    hole = F.array(point(x + 0.25, y + 0.25), point(x + 0.5, y + 0.25), point(x + 0.5, y + 0.5), point(x + 0.25, y + 0.5), point(x + 0.25, y + 0.25))
    parts = F.when(k % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return table(spark, sf, "part").select(k.alias("id"), F.col("p_brand").alias("brand"), F.col("p_retailprice").cast("double").alias("price"), F.struct(F.lit("POLYGON").alias("kind"), parts.alias("parts")).alias("geometry"))


@query("""SELECT p_partkey AS id, p_brand AS brand, CAST(p_retailprice AS DOUBLE) AS price, CAST(2 - p_partkey % 2 AS INTEGER) AS rings, CAST(p_size AS DOUBLE) * p_size - CASE WHEN p_partkey % 2 = 0 THEN 0.0625 ELSE 0 END AS area
FROM part WHERE p_brand = 'Brand#13' AND p_partkey > 50 AND p_partkey % 100 <= 60 AND p_partkey % 100 + p_size >= 20""")
def layer_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Polygons with holes through shapefiles: one brand, in a box."""
    path = f"{shared_root(spark)}/layer-{uuid.uuid4().hex}"
    V.write_layer(_polygons(spark, sf), path)
    back = V.read_layer(spark, path, (20, -1e9, 60, 1e9)).where((F.col("brand") == "Brand#13") & (F.col("id") > 50))
    signed = lambda r: F.aggregate(F.zip_with(r, F.slice(r, 2, F.size(r)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    area = F.aggregate(F.transform("geometry.parts", signed), F.lit(0.0), lambda s, v: s + v) / -2  # outer rings run clockwise
    return back.select("id", "brand", "price", F.size("geometry.parts").alias("rings"), F.round(area, 6).alias("area"))


@query("SELECT p_partkey AS id, printf('POINT (%d.5 %d.25)', p_partkey % 100, p_partkey // 100) AS wkt, 21 AS bytes, CAST(p_partkey % 100 AS DOUBLE) + 0.5 AS x, CAST(p_partkey // 100 AS DOUBLE) + 0.25 AS y FROM part")
def geometry_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Points as text and bytes, and from these back."""
    k = F.col("p_partkey")
    p = F.array(F.array(F.struct((k % 100 + 0.5).cast("double").alias("x"), (F.floor(k / 100) + 0.25).cast("double").alias("y"))))
    df = table(spark, sf, "part").select(k.alias("id"), F.struct(F.lit("POINT").alias("kind"), p.alias("parts")).alias("g"))
    df = df.select("id", V.to_wkt(F.col("g")).alias("wkt"), V.to_wkb(F.col("g")).alias("wkb"))
    back, text = V.from_wkb(F.col("wkb"))["parts"][0][0], V.from_wkt(F.col("wkt"))["parts"][0][0]
    return df.select("id", "wkt", F.length("wkb").alias("bytes"), back["x"].alias("x"), text["y"].alias("y"))
