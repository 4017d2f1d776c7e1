"""Map projections and warps, beside their closed formulas in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projections as P
from ..operators import stacks as S
from .registry import PIXELS_SQL, pixels, query, table

_LONLAT = "SELECT p_partkey AS id, 24 + p_partkey % 47 * 0.5::DOUBLE AS lat, -120 + p_partkey % 61 * 0.9::DOUBLE AS lon FROM part"


def _places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), (24 + k % 47 * 0.5).alias("lat"), (-120 + k % 61 * 0.9).alias("lon"))


_ELLIPSOID = "6378137.0::DOUBLE AS a, (1 / 298.257222101::DOUBLE) * (2 - 1 / 298.257222101::DOUBLE) AS e2"


def _m(lat: str) -> str:
    return f"(cos(radians({lat})) / sqrt(1 - e2 * sin(radians({lat})) * sin(radians({lat}))))"


def _t(lat: str) -> str:
    return f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - sqrt(e2) * sin(radians({lat}))) / (1 + sqrt(e2) * sin(radians({lat}))), sqrt(e2) / 2))"


def _q(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"((1 - e2) * ({s} / (1 - e2 * {s} * {s}) - ln((1 - sqrt(e2) * {s}) / (1 + sqrt(e2) * {s})) / (2 * sqrt(e2))))"


@query(f"""WITH p AS (SELECT *, {_ELLIPSOID} FROM ({_LONLAT})), n AS (SELECT *, (ln({_m('33')}) - ln({_m('45')})) / (ln({_t('33')}) - ln({_t('45')})) AS n FROM p), f AS (SELECT *, {_m('33')} / (n * pow({_t('33')}, n)) AS f FROM n)
SELECT id, round(400000 + a * f * pow({_t('lat')}, n) * sin(n * radians(lon + 96)), 3) AS x, round(a * f * pow({_t('39')}, n) - a * f * pow({_t('lat')}, n) * cos(n * radians(lon + 96)), 3) AS y FROM f""")
def lambert(spark: SparkSession, sf: str) -> DataFrame:
    """Lambert's conformal cone of two parallels."""
    p = P.parse("+proj=lcc +lat_1=33 +lat_2=45 +lat_0=39 +lon_0=-96 +x_0=400000 +y_0=0 +ellps=GRS80")
    out = P.transformed(_places(spark, sf), "lon", "lat", P.from_code(4269), p)
    return out.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"""WITH p AS (SELECT *, {_ELLIPSOID} FROM ({_LONLAT})), n AS (SELECT *, (pow({_m('29.5')}, 2) - pow({_m('45.5')}, 2)) / ({_q('45.5')} - {_q('29.5')}) AS n FROM p), c AS (SELECT *, pow({_m('29.5')}, 2) + n * {_q('29.5')} AS c FROM n)
SELECT id, round(a * sqrt(c - n * {_q('lat')}) / n * sin(n * radians(lon + 96)), 3) AS x, round(a * sqrt(c - n * {_q('23')}) / n - a * sqrt(c - n * {_q('lat')}) / n * cos(n * radians(lon + 96)), 3) AS y FROM c""")
def albers(spark: SparkSession, sf: str) -> DataFrame:
    """Albers' equal-area cone."""
    p = P.parse("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +x_0=0 +y_0=0 +datum=NAD83")
    out = P.transformed(_places(spark, sf), "lon", "lat", P.from_code(4269), p)
    return out.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"SELECT id, way, round(lon, 8) AS lon, round(lat, 8) AS lat FROM ({_LONLAT}), (VALUES ('aea'), ('cea'), ('lcc'), ('merc'), ('utm')) w(way)")
def projected_and_back(spark: SparkSession, sf: str) -> DataFrame:
    """Places through each projection and back."""
    ways = {"aea": "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96", "cea": "+proj=cea +lat_ts=45", "lcc": "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=39 +lon_0=-96", "merc": "+proj=merc", "utm": "+proj=utm +zone=15 +south"}
    degrees, out = P.from_code(4326), None
    for way, text in ways.items():
        there = P.transformed(_places(spark, sf).select("id", "lon", "lat"), "lon", "lat", degrees, P.parse(text))
        back = P.transformed(there, "x", "y", P.parse(text), degrees, ("lon", "lat"))
        one = back.select("id", F.lit(way).alias("way"), F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {PIXELS_SQL}, s AS (SELECT greatest(2, max(row) + 1) AS n FROM px), g AS (SELECT r AS row, c AS col, 100.002::DOUBLE + (c + 0.5::DOUBLE) * 0.013 AS lon, 39.99::DOUBLE - (r + 0.5::DOUBLE) * 0.011 AS lat FROM s, range(0, 40) b(c), range(0, n) a(r)),
  q AS (SELECT row, col, (4865942 - 6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2))) / 1500 - 0.5 AS y, (6378137.0::DOUBLE * radians(lon) - 11131950) / 1300 - 0.5 AS x FROM g)
  SELECT q.row, q.col, round(CASE WHEN count(p.v) = 4 THEN sum((1 - abs(y - p.row)) * (1 - abs(x - p.col)) * p.v) END, 5) AS v
  FROM q LEFT JOIN px p ON p.row BETWEEN floor(y) AND floor(y) + 1 AND p.col BETWEEN floor(x) AND floor(x) + 1 GROUP BY 1, 2""")
def warp_to_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """A raster of web Mercator metres on a grid of degrees."""
    p = pixels(spark, sf).select("row", "col", "v")
    rows = max(2, (p.agg(F.max("row")).first()[0] or 0) + 1)
    out = S.warped(p, "v", P.from_code(3857), (11131950.0, 1300.0, 4865942.0, -1500.0), P.from_code(4326), (100.002, 0.013, 39.99, -0.011), 40, rows)
    return out.withColumn("v", F.round("v", 5))
