"""Coordinates, tiles, polygons, interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as C
from ..operators import geometry as G
from .registry import PIXELS_SQL, pixels, query, table

_LL = "ll AS (SELECT p_partkey AS id, p_partkey * 37 % 160 - 79.5::DOUBLE AS lat, p_partkey * 53 % 350 - 174.5::DOUBLE AS lon FROM part)"
_MERC = f"{_LL}, m AS (SELECT *, lon * 20037508.342789244 / 180 AS mx, ln(tan((90 + lat) * pi() / 360)) / (pi() / 180) * 20037508.342789244 / 180 AS my FROM ll)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), (k * 37 % 160 - 79.5).alias("lat"), (k * 53 % 350 - 174.5).alias("lon"))


@query(f"WITH {_MERC} SELECT id, CAST(ceil((mx + 20037508.342789244) / (40075016.685578488 / 1024)) - 1 AS INTEGER) AS tx, CAST(ceil((my + 20037508.342789244) / (40075016.685578488 / 1024)) - 1 AS INTEGER) AS ty FROM m")
def tile_xy(spark: SparkSession, sf: str) -> DataFrame:
    tx, ty = C.tile_of(*C.to_mercator(F.col("lat"), F.col("lon")), 10)
    return _points(spark, sf).select("id", tx.alias("tx"), ty.alias("ty"))


@query(f"""WITH {_MERC}, t AS (SELECT id, CAST(ceil((mx + 20037508.342789244) / (40075016.685578488 / 64)) - 1 AS INTEGER) AS tx, 63 - CAST(ceil((my + 20037508.342789244) / (40075016.685578488 / 64)) - 1 AS INTEGER) AS ty FROM m)
  SELECT id, {" || ".join(f"CAST(((tx >> {6 - i}) & 1) + 2 * ((ty >> {6 - i}) & 1) AS VARCHAR)" for i in range(1, 7))} AS quadkey FROM t""")
def quadkey(spark: SparkSession, sf: str) -> DataFrame:
    tx, ty = C.tile_of(*C.to_mercator(F.col("lat"), F.col("lon")), 6)
    return _points(spark, sf).select("id", C.quadkey(tx, ty, 6).alias("quadkey"))


@query(f"WITH {_MERC} SELECT id, round(mx, 3) AS mx, round(my, 3) AS my, round(lat, 6) AS lat, round(lon, 6) AS lon FROM m")
def merc_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """To metres and back: latitude and longitude must return."""
    p = _points(spark, sf)
    mx, my = C.to_mercator(F.col("lat"), F.col("lon"))
    m = p.select("id", mx.alias("mx"), my.alias("my"))
    lat, lon = C.from_mercator(F.col("mx"), F.col("my"))
    return m.select("id", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"WITH {_LL} SELECT id, CAST(ceil((lon + 180) / (180.0 / 32)) - 1 AS INTEGER) AS tx, CAST(ceil((lat + 90) / (180.0 / 32)) - 1 AS INTEGER) AS ty FROM ll")
def geodetic_tile(spark: SparkSession, sf: str) -> DataFrame:
    tx, ty = C.geodetic_tile(F.col("lat"), F.col("lon"), 5)
    return _points(spark, sf).select("id", tx.alias("tx"), ty.alias("ty"))


@query("SELECT p_partkey AS id, CAST(x AS INTEGER) AS tx, CAST(y AS INTEGER) AS ty, round(x * s - 20037508.342789244, 3) AS x0, round((y + 1) * s - 20037508.342789244, 3) AS y1 FROM (SELECT p_partkey, p_partkey % 8 AS x, p_partkey // 8 % 8 AS y, 40075016.685578488 / 8 AS s FROM part)")
def tile_bounds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    t = table(spark, sf, "part").select(k.alias("id"), (k % 8).cast("int").alias("tx"), (F.floor(k / 8) % 8).cast("int").alias("ty"))
    x0, _, _, y1 = C.tile_bounds(F.col("tx"), F.col("ty"), 3)
    return t.select("id", "tx", "ty", F.round(x0, 3).alias("x0"), F.round(y1, 3).alias("y1"))


@query(f"WITH {PIXELS_SQL}, m AS (SELECT row, col, 500000 + col * 30.0 AS x, 4000000 - row * 30.0 AS y FROM px) SELECT row, col, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(floor((x + 15 - 500000) / 30) AS BIGINT) AS c, CAST(floor((y - 15 - 4000000) / -30) AS BIGINT) AS r FROM m")
def affine_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    x, y = C.affine(F.col("col"), F.col("row"), 500000.0, 30.0, 4000000.0, -30.0)
    m = pixels(spark, sf).select("row", "col", x.alias("x"), y.alias("y"))
    c, r = C.affine_inverse(F.col("x") + 15, F.col("y") - 15, 500000.0, 30.0, 4000000.0, -30.0)
    return m.select("row", "col", "x", "y", c.alias("c"), r.alias("r"))


@query(f"WITH {_LL} SELECT a.id, b.id AS other, round(2 * 6372.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 4) AS km FROM ll a JOIN ll b ON b.id = a.id + 1")
def haversine(spark: SparkSession, sf: str) -> DataFrame:
    a = _points(spark, sf)
    b = a.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "id").select("id", "other", F.round(C.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 4).alias("km"))


@query("SELECT p_partkey AS id, CAST(p_size * (p_partkey % 7 + 1) AS DOUBLE) AS area, p_partkey % 2 = 0 AS clockwise FROM part")
def poly_area(spark: SparkSession, sf: str) -> DataFrame:
    """Signed areas of rectangles whose rings turn either way."""
    w, h = F.col("p_size").cast("double"), (F.col("p_partkey") % 7 + 1).cast("double")
    left, zero = F.array(F.lit(0.0), w, w, F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), h, h, F.lit(0.0))
    even = F.col("p_partkey") % 2 == 0
    signed = C.shoelace(F.when(even, F.reverse(left)).otherwise(left), F.when(even, F.reverse(zero)).otherwise(zero))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.abs(signed).alias("area"), (signed < 0).alias("clockwise"))


@query("SELECT p_partkey AS id, CAST(i AS INTEGER) AS i, CAST(p_size * i AS BIGINT) AS x, CAST(i * i AS BIGINT) AS y FROM part, range(0, 4) t(i)")
def line_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices of lines as rows."""
    xs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((F.col("p_size") * i).cast("long").alias("x"), (i * i).cast("long").alias("y")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.posexplode(xs).alias("i", "p")).select("id", "i", "p.x", "p.y")


@query(f"""WITH {PIXELS_SQL}, c AS (SELECT row, col, row * 0.1 + 20 AS la, col * 0.1 + 100 AS lo FROM px), s AS (SELECT s_suppkey AS k, 20 + s_suppkey % 11 * 0.2 AS lat, 100 + s_suppkey % 13 * 0.2 AS lon, s_acctbal AS value FROM supplier),
  d AS (SELECT row, col, k, value, 2 * 6372.8 * asin(sqrt(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2))) + 1e-6 AS d FROM c, s),
  r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY round(d, 6), k) AS r FROM d) SELECT row, col, round(sum(value / (d * d)) / sum(1 / (d * d)), 2) AS value FROM r WHERE r <= 5 GROUP BY 1, 2""")
def idw(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    stations = table(spark, sf, "supplier").select(k.alias("station"), (20 + k % 11 * 0.2).alias("lat"), (100 + k % 13 * 0.2).alias("lon"), F.col("s_acctbal").alias("value"))
    cells = pixels(spark, sf).select("row", "col", (F.col("row") * 0.1 + 20).alias("clat"), (F.col("col") * 0.1 + 100).alias("clon"))
    return G.idw(cells, stations, ["row", "col"], 5, 2.0).withColumn("value", F.round("value", 2))


@query(f"""WITH {PIXELS_SQL}, c AS (SELECT zone, CAST(row AS DOUBLE) AS y, CAST(min(col) AS DOUBLE) AS x FROM px GROUP BY zone, row UNION SELECT zone, row, max(col) FROM px GROUP BY zone, row),
  e AS (SELECT p.zone, p.x, p.y, q.x AS x2, q.y AS y2 FROM c p JOIN c q ON p.zone = q.zone AND (p.x <> q.x OR p.y <> q.y)),
  h AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.zone = e.zone AND ((x2 - e.x) * (o.y - e.y) < (y2 - e.y) * (o.x - e.x)
    OR (x2 - e.x) * (o.y - e.y) = (y2 - e.y) * (o.x - e.x) AND (o.x - e.x) * (o.x - x2) + (o.y - e.y) * (o.y - y2) > 0)))
SELECT zone, CAST(count(*) + 1 AS INTEGER) AS corners, round(sum(x * y2 - x2 * y) / 2, 3) AS area FROM h GROUP BY zone""")
def convex_hull(spark: SparkSession, sf: str) -> DataFrame:
    """Hulls of the pixels of each zone."""
    p = pixels(spark, sf).select("zone", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    return G.convex_hulls(p, "zone").select("zone", F.size("xs").alias("corners"), F.round("area", 3).alias("area"))


@query("SELECT p_partkey AS id, CAST(greatest(0, least(p_size, 10 + p_partkey % 20) - greatest(0, p_partkey % 20)) * greatest(0, least(8, 12) - greatest(0, 3)) AS DOUBLE) AS clipped_area FROM part")
def polygon_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Area of the intersection of two rectangles by clipping."""
    w, s = F.col("p_size").cast("double"), (F.col("p_partkey") % 20).cast("double")
    z = F.lit(0.0)
    box = lambda x0, y0, x1, y1: (F.array(x0, x1, x1, x0, x0), F.array(y0, y0, y1, y1, y0))
    (xs, ys), (cxs, cys) = box(z, z, w, F.lit(8.0)), box(s, F.lit(3.0), s + 10, F.lit(12.0))
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), xs.alias("xs"), ys.alias("ys"), cxs.alias("cxs"), cys.alias("cys"))
    return G.clip_convex(df).select("id", F.round("clipped_area", 6).alias("clipped_area"))


@query(f"WITH {PIXELS_SQL} SELECT zone, CAST(min(col) AS BIGINT) AS x0, CAST(max(col) AS BIGINT) AS x1, CAST(min(row) AS BIGINT) AS y0, CAST(max(row) AS BIGINT) AS y1 FROM px GROUP BY zone")
def zone_extent(spark: SparkSession, sf: str) -> DataFrame:
    return G.extent(pixels(spark, sf), ["zone"], "col", "row").select("zone", "x0", "x1", "y0", "y1")


@query("""WITH p AS (SELECT p_partkey AS id, radians(40 + p_partkey % 20 * 0.5::DOUBLE) AS phi, (0.5 + p_partkey % 50 * 0.1::DOUBLE - 3) AS dl FROM part), k AS (SELECT *, 0.0066943799901413165::DOUBLE AS e FROM p),
  q AS (SELECT *, e / (1 - e) AS ep, radians(dl) * cos(phi) AS a, 6378137.0 / sqrt(1 - e * sin(phi) * sin(phi)) AS n, tan(phi) * tan(phi) AS t FROM k), r AS (SELECT *, ep * cos(phi) * cos(phi) AS c, 6378137.0 * ((1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256) * phi - (3 * e / 8 + 3 * e * e / 32 + 45 * e * e * e / 1024) * sin(2 * phi) + (15 * e * e / 256 + 45 * e * e * e / 1024) * sin(4 * phi) - 35 * e * e * e / 3072 * sin(6 * phi)) AS arc FROM q)
  SELECT id, round(0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(a, 5) / 120) + 500000, 2) AS x, round(0.9996 * (arc + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(a, 6) / 720)), 2) AS y FROM r""")
def utm(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates in UTM zone 31."""
    k = F.col("p_partkey")
    x, y = C.to_utm(40 + k % 20 * 0.5, 0.5 + k % 50 * 0.1, 31)
    return table(spark, sf, "part").select(k.alias("id"), F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))
