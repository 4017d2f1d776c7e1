"""Histograms, stretches, zonal statistics, focal operators, texture, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import histogram as H
from ..operators import raster as R
from ..operators import regions as G
from ..operators import zonal as Z
from .registry import PIXELS_SQL, pixels, query, table

W = f"WITH {PIXELS_SQL}"


@query(f"{W} SELECT v AS level, count(*) AS n FROM px WHERE v <> 0 GROUP BY v")
def hist_unit(spark: SparkSession, sf: str) -> DataFrame:
    return H.counts(pixels(spark, sf), "v")


@query(f"{W}, e AS (SELECT min(v) AS a, max(v) AS b FROM px) SELECT CAST(CASE WHEN v = b THEN ceil((b - a + 3 - 1) / 3.0) ELSE floor((v - a) / 3.0) END AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (v = 0) AS zeros FROM px, e GROUP BY 1")
def hist_step(spark: SparkSession, sf: str) -> DataFrame:
    return H.step_histogram(pixels(spark, sf), "v", 3)


@query(f"{W}, h AS (SELECT v AS level, count(*) AS n FROM px WHERE v <> 0 GROUP BY v) SELECT level, round(sum(n) OVER (ORDER BY level) / CAST(sum(n) OVER () AS DOUBLE), 9) AS share FROM h")
def cdf_nozero(spark: SparkSession, sf: str) -> DataFrame:
    return H.cdf(pixels(spark, sf), "v").select("level", F.round("share", 9).alias("share"))


_CLIP = """h AS (SELECT v AS level, count(*) AS n FROM px WHERE v <> 0 GROUP BY v), c AS (SELECT level, sum(n) OVER (ORDER BY level) / CAST(sum(n) OVER () AS DOUBLE) AS share FROM h),
 k AS (SELECT (SELECT level FROM c ORDER BY abs(share - 0.02), level LIMIT 1) AS low, (SELECT level FROM c ORDER BY abs(share - 0.98), level LIMIT 1) AS high)"""


@query(f"{W}, {_CLIP} SELECT low, high FROM k")
def pct_clip(spark: SparkSession, sf: str) -> DataFrame:
    return H.clip_points(pixels(spark, sf), "v", 2)


@query(f"{W}, {_CLIP} SELECT row, col, CASE WHEN v = (SELECT v FROM px WHERE row = 0 AND col = 0) THEN 0 WHEN v <= low THEN 1 WHEN v >= high THEN 255 ELSE CAST(trunc(1 + 254.0 * (v - low) / (high - low)) AS BIGINT) END AS out FROM px, k")
def linear_stretch2(spark: SparkSession, sf: str) -> DataFrame:
    """Two-percent stretch to 1..255; the value of the first pixel is the background."""
    p = pixels(spark, sf)
    first = p.where("row = 0 AND col = 0").agg(F.max("v").alias("bg"))  # one row, null without that pixel
    out = F.when(F.col("v") == F.col("bg"), 0).otherwise(F.floor(H.linear_stretch(F.col("v"), F.col("low"), F.col("high"))))
    return p.crossJoin(F.broadcast(H.clip_points(p, "v", 2))).crossJoin(F.broadcast(first)).select("row", "col", out.cast("long").alias("out"))


@query(f"{W}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM px) SELECT row, col, round(least(greatest(v, m - 2 * s), m + 2 * s) / (4 * s), 6) AS out FROM px, s")
def std_stretch(spark: SparkSession, sf: str) -> DataFrame:
    return H.std_stretch(pixels(spark, sf), "v", "out").select("row", "col", F.round("out", 6).alias("out"))


@query(f"{W} SELECT row, col, CAST(floor((SELECT min(cls) + 10 FROM px) + ((SELECT max(cls) + 200 FROM px) - (SELECT min(cls) + 10 FROM px)) * ((v - (SELECT min(v) FROM px)) / CAST((SELECT max(v) - min(v) FROM px) AS DOUBLE))) AS BIGINT) AS out FROM px")
def min_max_stretch(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf)
    ref = p.select(F.explode(F.array(F.col("cls") + 10, F.col("cls") + 200)).alias("r"))
    return H.min_max_stretch(p, "v", ref, "r", "out").select("row", "col", "out")


@query(f"""{W}, a AS (SELECT level, sum(n) OVER (ORDER BY level) / CAST(sum(n) OVER () AS DOUBLE) AS s FROM (SELECT v AS level, count(*) AS n FROM px WHERE v <> 0 GROUP BY v)),
  b AS (SELECT level, sum(n) OVER (ORDER BY level) / CAST(sum(n) OVER () AS DOUBLE) AS s FROM (SELECT v * v // 20 AS level, count(*) AS n FROM px WHERE v * v // 20 <> 0 GROUP BY 1))
  SELECT level, matched FROM (SELECT a.level, b.level AS matched, row_number() OVER (PARTITION BY a.level ORDER BY round(abs(a.s - b.s), 12), b.level) AS r FROM a, b) WHERE r = 1""")
def hist_match(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf)
    return H.match(p, "v", p.select(F.floor(F.col("v") * F.col("v") / 20).alias("w")), "w")


@query(f"""{W}, h AS (SELECT v, count(*) AS n FROM px GROUP BY v), c AS (SELECT v, sum(n) OVER w AS cn, sum(n * v) OVER w AS cm, sum(n) OVER () AS t, sum(n * v) OVER () AS m FROM h WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT v, round(CAST(cn AS DOUBLE) / t * (1 - CAST(cn AS DOUBLE) / t) * pow(cm / CAST(cn AS DOUBLE) - (m - cm) / CAST(t - cn AS DOUBLE), 2), 6) AS b FROM c WHERE cn < t) SELECT v AS threshold, b AS between_ FROM d ORDER BY b DESC, v LIMIT 1""")
def otsu(spark: SparkSession, sf: str) -> DataFrame:
    return H.otsu(pixels(spark, sf), "v").select("threshold", F.round("between", 6).alias("between_"))


@query(f"{W}, s AS (SELECT avg(blue) AS m1, stddev_pop(blue) AS s1, avg(nir) AS m3, stddev_pop(nir) AS s3 FROM px) SELECT row, col, round(blue * (s3 / s1) + m3 - s3 / s1 * m1, 4) AS out FROM px, s")
def gain_bias(spark: SparkSession, sf: str) -> DataFrame:
    return H.statistics_match(pixels(spark, sf), "blue", "nir", "out").select("row", "col", F.round("out", 4).alias("out"))


@query(f"""{W}, a AS (SELECT row, col, (blue + green + red + nir) / 4.0::DOUBLE AS g0, blue, green FROM px), b AS (SELECT *, blue - avg(blue) OVER () - (SELECT covar_pop(blue, g0) / var_pop(g0) FROM a) * g0 AS g1 FROM a),
  c AS (SELECT *, green - avg(green) OVER () - (SELECT covar_pop(green, g0) / var_pop(g0) FROM b) * g0 - (SELECT covar_pop(green, g1) / var_pop(g1) FROM b) * g1 AS g2 FROM b) SELECT row, col, round(g0, 3) AS g0, round(g1, 3) AS g1, round(g2, 3) AS g2 FROM c""")
def gs_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Orthogonal bands after a simulated panchromatic one, the mean of all."""
    p = pixels(spark, sf).withColumn("pan", (F.col("blue") + F.col("green") + F.col("red") + F.col("nir")) / 4)
    g = Z.gram_schmidt(p.select("row", "col", "pan", "blue", "green"), ["pan", "blue", "green"])
    return g.select("row", "col", F.round("gs_pan", 3).alias("g0"), F.round("gs_blue", 3).alias("g1"), F.round("gs_green", 3).alias("g2"))


@query(f"{W} SELECT zone, round(avg(CASE WHEN cls <> 0 THEN v END), 4) AS mean, round(var_pop(v), 6) AS variance, round(covar_pop(v, nir), 4) AS cov FROM px GROUP BY zone")
def zonal_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).withColumn("w", F.when(F.col("cls") != 0, F.col("v")).otherwise(0))
    return Z.zonal(p, "zone", mean=Z.mean_not_zero("w"), variance=F.round(F.var_pop("v"), 6), cov=F.round(F.covar_pop("v", "nir"), 4))


@query(f"{W}, l(id, lo, hi) AS (VALUES (1, 1, 11), (2, 11, 31), (3, 31, 46)), t AS (SELECT zone, count(*) AS t FROM px WHERE v <> 0 GROUP BY 1) SELECT zone, CAST(id AS INTEGER) AS id, round(count(*) / CAST(any_value(t) AS DOUBLE), 3) AS share FROM px JOIN l ON v >= lo AND v < hi JOIN t USING (zone) WHERE v <> 0 GROUP BY zone, id")
def class_share(spark: SparkSession, sf: str) -> DataFrame:
    legend = spark.createDataFrame([(1, 1, 11), (2, 11, 31), (3, 31, 46)], "id int, min long, max long")
    return Z.class_shares(pixels(spark, sf), "zone", "v", legend)


@query(f"{W}, n AS (SELECT zone, cls, count(*) AS n FROM px WHERE v > 10 GROUP BY 1, 2) SELECT zone, cls AS mode, round(n / CAST(t AS DOUBLE), 2) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY zone) AS t, row_number() OVER (PARTITION BY zone ORDER BY n DESC, cls) AS r FROM n) WHERE r = 1")
def zonal_mode(spark: SparkSession, sf: str) -> DataFrame:
    return Z.zonal_mode(pixels(spark, sf).where("v > 10"), "zone", "cls")


@query(f"""{W}, n AS (SELECT zone, cls, count(*) AS n FROM px WHERE cls IN (3, 1, 2) AND v > 20 GROUP BY 1, 2), b AS (SELECT *, sum(n) OVER (PARTITION BY zone) AS t, row_number() OVER (PARTITION BY zone ORDER BY n DESC, list_position([3, 1, 2], cls)) AS r FROM n)
  SELECT z.zone, CAST(coalesce(CASE WHEN n / CAST(t AS DOUBLE) >= 0.35 THEN cls END, 240) AS BIGINT) AS flag FROM (SELECT DISTINCT zone FROM px WHERE v > 20) z LEFT JOIN b ON b.zone = z.zone AND r = 1""")
def zonal_majority(spark: SparkSession, sf: str) -> DataFrame:
    return Z.zonal_majority(pixels(spark, sf).where("v > 20"), "zone", "cls", [3, 1, 2], 0.35, 240)


@query(f"{W} SELECT cls, round(count(*) * 16.0::DOUBLE / 666.7, 4) AS area FROM px WHERE cls <> 4 GROUP BY cls")
def class_area(spark: SparkSession, sf: str) -> DataFrame:
    return Z.class_areas(pixels(spark, sf), "cls", 4, -4, drop=4)


@query(f"{W} SELECT zone, count(*) FILTER (cls = 0) AS \"0\", count(*) FILTER (cls = 1) AS \"1\", count(*) FILTER (cls = 2) AS \"2\" FROM px GROUP BY zone")
def cross_hist(spark: SparkSession, sf: str) -> DataFrame:
    return Z.cross_counts(pixels(spark, sf), "zone", "cls", [0, 1, 2])


@query(f"{W} SELECT zone, round(count(*) FILTER (cls = 3) / nullif(CAST(count(*) FILTER (cls <> 0) AS DOUBLE), 0), 3) AS fraction FROM px GROUP BY zone")
def cloud_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return Z.cloud_fraction(pixels(spark, sf), "zone", "cls")


@query("SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return Z.confusion(table(spark, sf, "labels"), "quality", "toxic")


@query("""WITH a AS (SELECT avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END) AS po, (sum(quality) * sum(toxic) + sum(1 - quality) * sum(1 - toxic)) / CAST(count(*) * count(*) AS DOUBLE) AS pe FROM labels) SELECT round(po, 9) AS accuracy, round((po - pe) / (1 - pe), 9) AS kappa FROM a""")
def kappa(spark: SparkSession, sf: str) -> DataFrame:
    return Z.accuracy(table(spark, sf, "labels"), "quality", "toxic").select(F.round("accuracy", 9).alias("accuracy"), F.round("kappa", 9).alias("kappa"))


@query("""WITH l AS (SELECT k AS label, count(*) FILTER (quality = k AND toxic = k) AS tp, count(*) FILTER (quality <> k AND toxic = k) AS fp, count(*) FILTER (quality = k AND toxic <> k) AS fn, count(*) FILTER (quality <> k AND toxic <> k) AS tn FROM labels, (VALUES (0), (1)) v(k) GROUP BY k)
  SELECT label, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 9) AS "precision", round(tp / CAST(tp + fn AS DOUBLE), 9) AS sensitivity, round(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 9) AS specificity, round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 9) AS f1 FROM l WHERE tp + fn > 0""")
def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = Z.class_scores(table(spark, sf, "labels"), "quality", "toxic")
    return s.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "sensitivity", "specificity", "f1")])


_LONG = f"{PIXELS_SQL}, lg AS (SELECT cls, row * 50 + col AS id, band, CAST(val AS DOUBLE) AS val FROM (UNPIVOT (SELECT row, col, cls, blue, v * v * v AS cube FROM px) ON blue, cube INTO NAME band VALUE val))"


def _iqr_sql(how: str) -> str:
    return f"""WITH {_LONG}, q AS (SELECT cls, band, quantile_cont(val, 0.25) AS q1, quantile_cont(val, 0.75) AS q3 FROM lg GROUP BY 1, 2), k AS (SELECT lg.cls, id FROM lg JOIN q USING (cls, band) GROUP BY 1, 2 HAVING {how}(val >= q1 - 1.5 * (q3 - q1) AND val <= q3 + 1.5 * (q3 - q1)))
  SELECT cls, band, round(avg(val), 4) AS mean, min(val) AS least, max(val) AS most, count(*) AS n FROM lg JOIN k USING (cls, id) GROUP BY 1, 2"""


def _iqr(spark: SparkSession, sf: str, any_band: bool) -> DataFrame:
    long = pixels(spark, sf).select("cls", (F.col("row") * 50 + F.col("col")).alias("id"), "blue", (F.col("v") * F.col("v") * F.col("v")).alias("cube")).unpivot(["cls", "id"], ["blue", "cube"], "band", "val").withColumn("val", F.col("val").cast("double"))
    return Z.iqr_mean(long, "cls", "id", "band", "val", any_band).withColumn("mean", F.round("mean", 4))


@query(_iqr_sql("bool_and"))
def iqr_filter_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _iqr(spark, sf, False)


@query(_iqr_sql("bool_or"))
def iqr_filter_any(spark: SparkSession, sf: str) -> DataFrame:
    return _iqr(spark, sf, True)


def _square(k: int, f: str) -> str:
    return f"SELECT a.row, a.col, {f}(b.v) AS out FROM px a JOIN px b ON abs(a.row - b.row) <= {k} AND abs(a.col - b.col) <= {k} GROUP BY a.row, a.col"


@query(f"{W} SELECT a.row, a.col, round(avg(b.v), 6) AS out FROM px a JOIN px b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col HAVING count(*) = 9")
def focal_mean(spark: SparkSession, sf: str) -> DataFrame:
    return R.focal_mean(pixels(spark, sf), "v", "out").select("row", "col", F.round("out", 6).alias("out"))


@query(f"{W} {_square(1, 'min')}")
def erode(spark: SparkSession, sf: str) -> DataFrame:
    return R.erode(pixels(spark, sf), "v", "out").select("row", "col", "out")


@query(f"{W} {_square(2, 'max')}")
def dilate(spark: SparkSession, sf: str) -> DataFrame:
    return R.dilate(pixels(spark, sf), "v", "out", 2).select("row", "col", "out")


def _twice(f: str, g: str) -> str:
    return f"{W}, m AS (SELECT row, col, out AS v FROM ({_square(1, f)})) SELECT a.row, a.col, {g}(b.v) AS out FROM m a JOIN m b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col"


@query(_twice("min", "max"))
def opening(spark: SparkSession, sf: str) -> DataFrame:
    return R.opening(pixels(spark, sf), "v", "out").select("row", "col", "out")


@query(_twice("max", "min"))
def closing(spark: SparkSession, sf: str) -> DataFrame:
    return R.closing(pixels(spark, sf), "v", "out").select("row", "col", "out")


@query(f"WITH x AS ({_twice('min', 'max')}), y AS ({_twice('max', 'min')}), {PIXELS_SQL} SELECT row, col, px.v - x.out AS top, y.out - px.v AS bottom FROM px JOIN x USING (row, col) JOIN y USING (row, col)")
def tophat(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).select("row", "col", "v")
    return R.bottom_hat(R.top_hat(p, "v", "top"), "v", "bottom").select("row", "col", "top", "bottom")


@query(f"""{W}, n AS (SELECT a.row, a.col, sum(CASE WHEN b.col = a.col + 1 THEN (CASE WHEN b.row = a.row THEN 2 ELSE 1 END) * b.v WHEN b.col = a.col - 1 THEN -(CASE WHEN b.row = a.row THEN 2 ELSE 1 END) * b.v ELSE 0 END) / 80.0::DOUBLE AS dx,
  sum(CASE WHEN b.row = a.row + 1 THEN (CASE WHEN b.col = a.col THEN 2 ELSE 1 END) * b.v WHEN b.row = a.row - 1 THEN -(CASE WHEN b.col = a.col THEN 2 ELSE 1 END) * b.v ELSE 0 END) / 80.0::DOUBLE AS dy FROM px a JOIN px b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2 HAVING count(*) = 9)
  SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope FROM n""")
def slope(spark: SparkSession, sf: str) -> DataFrame:
    return R.slope(pixels(spark, sf), "v", "slope", 10).select("row", "col", F.round("slope", 6).alias("slope"))


@query(f"""{W}, k AS (SELECT d, exp(-(d * d) / 2.0::DOUBLE) AS w FROM range(-4, 5) t(d) WHERE abs(d) <= 3), kn AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k),
  h AS (SELECT a.row, a.col, sum(b.v * w) AS v FROM px a JOIN kn ON true JOIN px b ON b.row = a.row AND b.col = a.col + d GROUP BY 1, 2) SELECT a.row, a.col, round(sum(b.v * w), 6) AS out FROM h a JOIN kn ON true JOIN h b ON b.col = a.col AND b.row = a.row + d GROUP BY 1, 2""")
def gauss_sep(spark: SparkSession, sf: str) -> DataFrame:
    return R.gaussian(pixels(spark, sf), "v", "out", 1.0).select("row", "col", F.round("out", 6).alias("out"))


@query(f"{W} SELECT row // 4 AS row, col // 4 AS col, round(avg(v), 6) AS out FROM px GROUP BY 1, 2")
def resample_block(spark: SparkSession, sf: str) -> DataFrame:
    return R.block_mean(pixels(spark, sf), "v", "out", 4).withColumn("out", F.round("out", 6))


@query(f"{W} SELECT row * 2 + i AS row, col * 2 + j AS col, v FROM px, range(0, 2) a(i), range(0, 2) b(j)")
def resample_repeat(spark: SparkSession, sf: str) -> DataFrame:
    return R.repeat_pixels(pixels(spark, sf).select("row", "col", "v"), 2)


@query(f"""{W}, q AS (SELECT row * 50 + col AS id, CAST(row + 0.25 + (v % 3) * 0.125 AS DOUBLE) AS y, CAST(col + 0.5 AS DOUBLE) AS x FROM px WHERE v % 4 = 0) SELECT id, round(CASE WHEN count(p.v) = 4 THEN sum((1 - abs(y - p.row)) * (1 - abs(x - p.col)) * p.v) END, 6) AS v
  FROM q LEFT JOIN px p ON p.row BETWEEN floor(y) AND floor(y) + 1 AND p.col BETWEEN floor(x) AND floor(x) + 1 GROUP BY id""")
def bilinear(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf)
    q = p.where("v % 4 = 0").select((F.col("row") * 50 + F.col("col")).alias("id"), (F.col("row") + 0.25 + F.col("v") % 3 * 0.125).alias("y"), (F.col("col") + 0.5).alias("x"))
    return R.bilinear(p, "v", q).select("id", F.round("v", 6).alias("v"))


@query(f"{W}, r AS (SELECT row, col, v, 1 AS o FROM px UNION ALL SELECT row, col, CASE WHEN v % 3 = 0 THEN 0 ELSE v + 100 END, 2 FROM px WHERE col > 20) SELECT row, col, CAST(coalesce(v, 0) AS BIGINT) AS v FROM (SELECT row, col, max(o) AS o FROM r WHERE v <> 0 GROUP BY 1, 2) JOIN r USING (row, col, o)")
def mosaic_nodata(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).select("row", "col", "v")
    second = p.where("col > 20").withColumn("v", F.when(F.col("v") % 3 == 0, 0).otherwise(F.col("v") + 100))
    return R.mosaic(p.withColumn("o", F.lit(1)).unionByName(second.withColumn("o", F.lit(2))), "v", "o", 0)


@query(f"{W} SELECT a.row, a.col, round(avg(b.v), 6) AS v FROM px a JOIN px b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 WHERE a.v = 25 GROUP BY 1, 2")
def point_window_mean(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf)
    return R.window_mean(p, "v", p.where("v = 25").select("row", "col"), 2).select("row", "col", F.round("v", 6).alias("v"))


@query(f"{W} SELECT p.row, p.col, CAST(CASE WHEN p.v > 30 THEN p.cls ELSE 200 END AS BIGINT) AS cls FROM px p")
def classes_to_raster(spark: SparkSession, sf: str) -> DataFrame:
    """Classified pixels on the whole grid, 200 where there are none."""
    p = pixels(spark, sf)
    return R.on_grid(p.where("v > 30").select("row", "col", "cls"), p.select("row", "col"), "cls", 200)


@query(f"{W} SELECT strip, count(*) AS n, count(*) FILTER (row // 7 = strip) AS core, CAST(sum(v) AS BIGINT) AS v FROM (SELECT *, unnest(list_distinct([row // 7, CASE WHEN row >= 2 THEN (row - 2) // 7 ELSE row // 7 END, least((row + 2), (SELECT max(row) FROM px)) // 7])) AS strip FROM px) GROUP BY strip")
def strips_with_halo(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf)
    last = p.agg(F.max("row").alias("last"))
    s = R.strips(p.crossJoin(F.broadcast(last)), 7, 2, F.col("last"))
    return s.groupBy("strip").agg(F.count("*").alias("n"), F.count_if("core").alias("core"), F.sum("v").alias("v"))


@query(f"""{W}, n AS (SELECT a.v % 8 AS i, b.v % 8 AS j, count(*) AS n FROM px a JOIN px b ON b.row = a.row AND b.col = a.col + 1 GROUP BY 1, 2), p AS (SELECT i, j, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM n), m AS (SELECT sum(i * p) AS mr, sum(j * p) AS mc FROM p), s AS (SELECT sqrt(sum((i - mr) * (i - mr) * p)) AS sr, sqrt(sum((j - mc) * (j - mc) * p)) AS sc FROM p, m)
  SELECT round(any_value((mr + mc) / 2), 6) AS mean, round(any_value((sr + sc) / 2), 6) AS deviation, round(sum(p * p), 6) AS asm, round(sum((i - j) * (i - j) * p), 6) AS contrast, round(sum((i - mr) * (j - mc) * p / (sr * sc + 1e-6)), 6) AS correlation, round(sum(p / (1 + abs(i - j))), 6) AS homogeneity, round(-sum(p * log2(p)), 6) AS entropy FROM p, m, s""")
def glcm(spark: SparkSession, sf: str) -> DataFrame:
    g = R.glcm(pixels(spark, sf).withColumn("g", F.col("v") % 8), "g", 0, 1)
    return g.select(*[F.round(c, 6).alias(c) for c in g.columns])


@query(f"""{W} SELECT row, col, CASE WHEN v < 10 THEN 'low' WHEN v < 30 THEN 'mid' ELSE 'high' END AS colour, CAST(round((v - 1) / 49.0 * 255, 0) AS INTEGER) AS grey FROM px""")
def color_map(spark: SparkSession, sf: str) -> DataFrame:
    """Segmented colours by a legend, and a linear ramp."""
    legend = spark.createDataFrame([(0, 10, "low"), (10, 30, "mid"), (30, 1000, "high")], "lo long, hi long, colour string")
    p = pixels(spark, sf)
    return p.join(F.broadcast(legend), (p.v >= legend.lo) & (p.v < legend.hi)).select("row", "col", "colour", F.round((F.col("v") - 1) / 49.0 * 255).cast("int").alias("grey"))


@query(f"""WITH RECURSIVE {PIXELS_SQL}, b AS MATERIALIZED (SELECT row, col, row * 50 + col AS id FROM px WHERE v % 3 = 0), e AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM b x JOIN b y ON abs(x.row - y.row) <= 1 AND abs(x.col - y.col) <= 1),
  r(id, root) AS (SELECT id, id FROM b UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE e.b > r.root) SELECT row, col, min(root) AS component FROM r JOIN b USING (id) GROUP BY row, col""")
def conn_components(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of touching pixels, each named by its smallest pixel number."""
    p = pixels(spark, sf).select("row", "col", F.when(F.col("v") % 3 == 0, 1).otherwise(0).alias("b"))
    c = G.components(p, "b", eight=True, width=50)
    return c.select("row", "col", "component")


@query()
def sieve(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).select("row", "col", F.when(F.col("v") > 15, 1).otherwise(2).alias("b"))
    return G.sieve(p, "b", 6)


@query(f"{W} SELECT 49 - col AS row, row AS col, v, (SELECT max(row) FROM px) - row AS flip FROM px")
def rotate_flip(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter turn, and a vertical flip, as permutations of coordinates."""
    p = pixels(spark, sf)
    return p.crossJoin(F.broadcast(p.agg(F.max("row").alias("last")))).select((49 - F.col("col")).alias("row"), F.col("row").alias("col"), "v", (F.col("last") - F.col("row")).alias("flip"))
