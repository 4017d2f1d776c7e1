"""Catalogues, stacks, projections, textures of windows, spectra, least squares, trees, fractals at full size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as C
from ..operators import forests as T
from ..operators import learning as L
from ..operators import spectra as E
from ..operators import stacks as S
from .models import drawn_pi
from .registry import PIXELS_SQL, pixels, query, table

W = f"WITH {PIXELS_SQL}"


@query(f"""{W} SELECT cls, 1000 + min(col) * 30.0::DOUBLE AS x0, 5000 - (max(row) + 1) * 30.0::DOUBLE AS y0, 1000 + (max(col) + 1) * 30.0::DOUBLE AS x1, 5000 - min(row) * 30.0::DOUBLE AS y1,
  max(col) - min(col) + 1 AS columns, max(row) - min(row) + 1 AS rows, 'bigint' AS type, count(DISTINCT v) AS levels, count(DISTINCT v) <= 256 AS legend FROM px GROUP BY cls""")
def raster_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return S.catalogue(pixels(spark, sf), "cls", "v", 1000.0, 30.0, 5000.0, -30.0)


@query(f"{W} SELECT row, col, blue, CASE WHEN col < 40 THEN green ELSE -999 END AS green, CASE WHEN row % 2 = 0 THEN nir ELSE -999 END AS nir FROM px")
def stack_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Three rasters that don't cover the same pixels as bands of one."""
    p = pixels(spark, sf)
    one = lambda c, where: p.where(where).select("row", "col", F.col(c).cast("long").alias("v"))
    return S.stack({"blue": one("blue", "true"), "green": one("green", "col < 40"), "nir": one("nir", "row % 2 = 0")}, "v", -999)


@query(f"""{W}, s AS (SELECT greatest(2, max(row) + 1) AS n FROM px), g AS (SELECT r AS row, c AS col, 11131950 + (c + 0.5::DOUBLE) * 1300 AS mx, 4865942 - (r + 0.5::DOUBLE) * 1500 AS my FROM s, range(0, 43) b(c), range(0, n) a(r)),
  q AS (SELECT row, col, (40 - degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2)) / 0.01 - 0.5 AS y, (degrees(mx / 6378137.0) - 100) / 0.01 - 0.5 AS x FROM g)
  SELECT q.row, q.col, round(CASE WHEN count(p.v) = 4 THEN sum((1 - abs(y - p.row)) * (1 - abs(x - p.col)) * p.v) END, 5) AS v
  FROM q LEFT JOIN px p ON p.row BETWEEN floor(y) AND floor(y) + 1 AND p.col BETWEEN floor(x) AND floor(x) + 1 GROUP BY 1, 2""")
def reproject(spark: SparkSession, sf: str) -> DataFrame:
    """A raster of hundredths of degrees on a grid of web Mercator metres."""
    p = pixels(spark, sf).select("row", "col", "v")
    rows = max(2, (p.agg(F.max("row")).first()[0] or 0) + 1)
    out = S.to_mercator_grid(p, "v", (100.0, 0.01, 40.0, -0.01), (11131950.0, 1300.0, 4865942.0, -1500.0), 43, rows)
    return out.withColumn("v", F.round("v", 5))


_TEXTURE = f"""{W}, g AS (SELECT row, col, v % 8 AS g FROM px), a(angle, dc, dr) AS (VALUES (0, 1, 0), (45, 1, 1), (90, 0, 1), (135, -1, 1)), o AS (SELECT i, j FROM range(-1, 2) x(i), range(-1, 2) y(j)),
  w AS (SELECT c.row, c.col FROM g c, o JOIN g b ON b.row = c.row + o.i AND b.col = c.col + o.j GROUP BY 1, 2 HAVING count(*) = 9),
  p AS (SELECT angle, w.row, w.col, b.g AS i, e.g AS j FROM w, a, o JOIN g b ON b.row = w.row + o.i AND b.col = w.col + o.j JOIN g e ON e.row = b.row + dr AND e.col = b.col + dc AND abs(e.row - w.row) <= 1 AND abs(e.col - w.col) <= 1),
  n AS (SELECT angle, row, col, i, j, count(*) AS n FROM p GROUP BY ALL), q AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY angle, row, col) AS DOUBLE) AS p FROM n),
  m AS (SELECT *, sum(i * p) OVER (PARTITION BY angle, row, col) AS mi, sum(j * p) OVER (PARTITION BY angle, row, col) AS mj FROM q),
  s AS (SELECT *, sqrt(sum((i - mi) * (i - mi) * p) OVER (PARTITION BY angle, row, col)) AS si, sqrt(sum((j - mj) * (j - mj) * p) OVER (PARTITION BY angle, row, col)) AS sj FROM m)
  SELECT angle, row, col, CAST(floor(round(any_value((mi + mj) / 2), 6)) AS BIGINT) AS mean, CAST(floor(round(any_value((si + sj) / 2), 6)) AS BIGINT) AS deviation, CAST(floor(round(sum(p * p) * 100000, 6)) AS BIGINT) AS asm,
  CAST(floor(round(sum((i - j) * (i - j) * p), 6)) AS BIGINT) AS contrast, CAST(trunc(round(sum((i - mi) * (j - mj) * p) / any_value(si * sj + 1e-6) * 10000, 6)) AS BIGINT) AS correlation,
  CAST(floor(round(sum(p / (1 + abs(i - j))) * 10000, 6)) AS BIGINT) AS homogeneity, CAST(floor(round(-sum(p * log2(p)) * 100, 6)) AS BIGINT) AS entropy FROM s GROUP BY angle, row, col"""


@query(_TEXTURE)
def glcm_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Texture of squares of three by three pixels at four angles."""
    p = pixels(spark, sf).select("row", "col", (F.col("v") % 8).alias("g"))
    out = None
    for angle in S.ANGLES:
        one = S.window_texture(p, "g", angle).withColumn("angle", F.lit(angle))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT n_nationkey AS band, 400 + 2.5::DOUBLE * k AS wavelength, CASE WHEN 2.5 * k <= 60 THEN round(n_nationkey + 0.5::DOUBLE * k - 0.01::DOUBLE * k * k, 6) END AS response FROM nation, range(0, 29) t(k)""")
def spectral_response(spark: SparkSession, sf: str) -> DataFrame:
    """Responses that lie on a parabola, sampled each 10 nm, at steps of 2.5 nm: the spline gives the parabola back."""
    k = F.explode(F.sequence(F.lit(0), F.lit(6)))
    s = table(spark, sf, "nation").select(F.col("n_nationkey").alias("band"), k.alias("k"))
    s = s.select("band", (400 + F.col("k") * 10.0).alias("wavelength"), (F.col("band") + 2.0 * F.col("k") - 0.16 * F.col("k") * F.col("k")).alias("response"))
    return E.at_even_steps(s, "band", 400.0, 470.0).withColumn("response", F.round("response", 6))


@query(f"""{W}, s AS (SELECT count(*) AS n, avg(blue) AS mx, avg(green) AS my, avg(nir) AS mz, covar_pop(blue, blue) AS xx, covar_pop(green, green) AS yy, covar_pop(blue, green) AS xy, covar_pop(blue, nir) AS xz, covar_pop(green, nir) AS yz FROM px),
  b AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS bx, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS by_ FROM s)
  SELECT unnest(['const', 'blue', 'green']) AS term, unnest([round(mz - bx * mx - by_ * my, 5), round(bx, 5), round(by_, 5)]) AS coefficient FROM b""")
def least_squares(spark: SparkSession, sf: str) -> DataFrame:
    return S.normal_equations(pixels(spark, sf), ["blue", "green"], "nir").withColumn("coefficient", F.round("coefficient", 5))


@query("SELECT p_partkey AS id FROM part WHERE greatest(abs(p_partkey * 37 % 101 - p_partkey * 37 % 101 - p_size % 15), abs(p_partkey % 13 - 6)) < 5")
def small_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that move by less than five pixels in each direction."""
    k, x = F.col("p_partkey"), F.col("p_partkey") * 37 % 101
    m = table(spark, sf, "part").select(k.alias("id"), x.alias("x"), F.lit(6).alias("y"), (x + F.col("p_size") % 15).alias("u"), (k % 13).alias("v"))
    return S.small_shifts(m, 5).select("id")


@query("SELECT count(*) AS n, count(*) AS ids FROM orders")
def random_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Random ids are as many as rows."""
    ids = table(spark, sf, "orders").select(F.uuid().alias("id"))
    return ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query(f"{W} SELECT row, col, CAST((blue * 9 + green * 9 + red * 9 + 32768) % 65536 - 32768 AS BIGINT) AS vi4 FROM px")
def vi4_in_16_bits(spark: SparkSession, sf: str) -> DataFrame:
    """The sum of three bands as 16-bit numbers give it: beyond 32767 it goes on at -32768."""
    p = pixels(spark, sf)
    return p.select("row", "col", C.wrapped16(9 * F.col("blue") + 9 * F.col("green") + 9 * F.col("red")).alias("vi4"))


@query("""WITH RECURSIVE z AS (SELECT l_orderkey, l_linenumber, -1.8::DOUBLE + (l_orderkey * 37 + l_linenumber) % 1000 * 3.6::DOUBLE / 1000 AS x, 1.8::DOUBLE - (l_orderkey * 91 + l_linenumber * 13) % 997 * 3.6::DOUBLE / 997 AS y, 0 AS n FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, x * x - y * y + -0.62772::DOUBLE, 2 * x * y + -0.42193::DOUBLE, n + 1 FROM z WHERE x * x + y * y < 4 AND n < 300) SELECT l_orderkey, l_linenumber, CAST(max(n) AS INTEGER) AS steps FROM z GROUP BY l_orderkey, l_linenumber""")
def julia_full(spark: SparkSession, sf: str) -> DataFrame:
    """Escape steps of a place for each number of a line of an order, three hundred at most."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    p = table(spark, sf, "lineitem").select(k, n, (-1.8 + (k * 37 + n) % 1000 * 3.6 / 1000).alias("x"), (1.8 - (k * 91 + n * 13) % 997 * 3.6 / 997).alias("y"))
    return C.with_julia_steps(p.distinct(), "x", "y", -0.62772, -0.42193, 300).select("l_orderkey", "l_linenumber", "steps")


@query("SELECT 4 * count(*) FILTER (x * x + y * y <= 1) / count(*)::DOUBLE AS pi, count(*) AS n FROM (SELECT (l_orderkey * 48271 + l_linenumber * 7919) % 65537 / 65537.0::DOUBLE AS x, (l_orderkey * 69621 + l_partkey * 104729) % 65521 / 65521.0::DOUBLE AS y FROM lineitem)")
def monte_carlo_pi_full(spark: SparkSession, sf: str) -> DataFrame:
    """A place for each line of an order."""
    k = F.col("l_orderkey")
    return drawn_pi(table(spark, sf, "lineitem"), (k * 48271 + F.col("l_linenumber") * 7919) % 65537 / 65537.0, (k * 69621 + F.col("l_partkey") * 104729) % 65521 / 65521.0)


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_extendedprice AS s FROM lineitem")
def vector_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Two vectors added, element by element."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + F.col("l_extendedprice")).alias("s"))


@query(f"{W} SELECT row, col, k, k AS cls FROM (SELECT row, col, CASE WHEN blue + green > 1600 THEN 1 WHEN red > 900 THEN 2 ELSE 3 END AS k FROM px)")
def cart_predict(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of exhaustive splits, applied to the pixels that it learnt from: grown until pure, it knows them all."""
    p = pixels(spark, sf).withColumn("k", F.when(F.col("blue") + F.col("green") > 1600, 1).otherwise(F.when(F.col("red") > 900, 2).otherwise(3)))
    tree = L.cart(p, ["blue", "green", "red", "nir"], "k")
    return T.predict(p, [tree], "cls").select("row", "col", "k", "cls")


@query()
def cart_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Ten trees grown until pure on weights of their own, and what most of them say."""
    p = pixels(spark, sf).withColumn("k", F.when(F.col("blue") > 600, 1).otherwise(2))
    trees = L.cart_forest(p, ["blue", "green", "red", "nir"], "k", 10)
    return T.predict(p, trees, "cls").select("row", "col", F.col("cls").alias("k"))


@query("""SELECT n_nationkey AS id, CAST(r AS INTEGER) AS row, [n_name, CAST(n_regionkey * 10 + r AS VARCHAR)] AS cells FROM nation, range(0, 3) t(r)""")
def page_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of tables in pages, with markup inside and over line breaks."""
    from ..sources import web

    n = table(spark, sf, "nation")
    line = lambda r: F.concat(F.lit("<TR class='a'>\n<td><b>"), F.col("n_name"), F.lit("</b></td>\n<th x=1> "), (F.col("n_regionkey") * 10 + r).cast("string"), F.lit(" </th></TR>\n"))
    pages = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("<p>x</p><table>\n"), *[line(r) for r in range(3)], F.lit("</table>")).alias("html"))
    return web.table_cells(pages)
