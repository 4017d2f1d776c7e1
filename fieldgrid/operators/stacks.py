"""Several rasters at once: their catalogue, stacks of bands, another projection, texture of moving windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from ..functions.projections import Projection, transformed
from .raster import bilinear

#: Column and row steps of a pair of pixels by the angle of a texture.
ANGLES = {0: (1, 0), 45: (1, 1), 90: (0, 1), 135: (-1, 1)}


def catalogue(rasters: DataFrame, name: str, value: str, x0: float, dx: float, y0: float, dy: float) -> DataFrame:
    """A row for each raster: bounds in map units, columns and rows, type, number of values, whether it is a legend of 256 at most."""
    a = rasters.groupBy(name).agg(F.min("col").alias("_c0"), F.max("col").alias("_c1"), F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.count_distinct(value).alias("levels"))
    left, right, top, bottom = x0 + F.col("_c0") * dx, x0 + (F.col("_c1") + 1) * dx, y0 + F.col("_r0") * dy, y0 + (F.col("_r1") + 1) * dy
    return a.select(
        name, left.alias("x0"), bottom.alias("y0"), right.alias("x1"), top.alias("y1"), (F.col("_c1") - F.col("_c0") + 1).alias("columns"), (F.col("_r1") - F.col("_r0") + 1).alias("rows"),
        F.lit(dict(rasters.dtypes)[value]).alias("type"), "levels", (F.col("levels") <= 256).alias("legend"),
    )


def stack(bands: Mapping[str, DataFrame], value: str, nodata: float) -> DataFrame:
    """(row, col, a column for each band): one-band rasters on one grid, ``nodata`` where a band has no pixel.

    Bands come together in one aggregation by pixel, however many there are.
    """
    kind = dict(next(iter(bands.values())).dtypes)[value]
    rows = reduce(DataFrame.unionByName, (df.select("row", "col", F.lit(name).alias("_b"), F.col(value).cast(kind).alias("_v")) for name, df in bands.items()))
    of = lambda name: F.coalesce(F.max(F.when(F.col("_b") == name, F.col("_v"))), F.lit(nodata).cast(kind)).alias(name)
    return rows.groupBy("row", "col").agg(*[of(name) for name in bands])


def to_mercator_grid(df: DataFrame, value: str, source: Sequence[float], target: Sequence[float], columns: int, rows: int) -> DataFrame:
    """(row, col, value) of a raster in degrees on a grid of web Mercator metres, interpolated between four pixel centres; null beyond its edges.

    ``source`` and ``target``: (x of the left edge, pixel width, y of the top edge, pixel height, negative).
    """
    x0, dx, y0, dy = target
    grid = df.sparkSession.range(rows * columns).select(F.floor(F.col("id") / columns).alias("trow"), (F.col("id") % columns).alias("tcol"))
    lat, lon = scalar.from_mercator(x0 + (F.col("tcol") + 0.5) * dx, y0 + (F.col("trow") + 0.5) * dy)
    at = grid.select("trow", "tcol", ((lat - source[2]) / source[3] - 0.5).alias("y"), ((lon - source[0]) / source[1] - 0.5).alias("x"))
    return bilinear(df, value, at).select(F.col("trow").alias("row"), F.col("tcol").alias("col"), value)


def warped(df: DataFrame, value: str, source: Projection, source_grid: Sequence[float], target: Projection, target_grid: Sequence[float], columns: int, rows: int) -> DataFrame:
    """(row, col, value) of a raster of one projection on a grid of another, interpolated between four pixel centres; null beyond its edges.

    Each pixel of the target is mapped back to the source. Grids: (x of the left edge, pixel width, y of the top edge, pixel height, negative).
    """
    x0, dx, y0, dy = target_grid
    grid = df.sparkSession.range(rows * columns).select(F.floor(F.col("id") / columns).alias("trow"), (F.col("id") % columns).alias("tcol"))
    at = transformed(grid.withColumns({"x": x0 + (F.col("tcol") + 0.5) * dx, "y": y0 + (F.col("trow") + 0.5) * dy}), "x", "y", target, source)
    at = at.select("trow", "tcol", ((F.col("y") - source_grid[2]) / source_grid[3] - 0.5).alias("y"), ((F.col("x") - source_grid[0]) / source_grid[1] - 0.5).alias("x"))
    return bilinear(df, value, at).select(F.col("trow").alias("row"), F.col("tcol").alias("col"), value)


def window_texture(df: DataFrame, value: str, angle: int, k: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Texture of the square around each pixel that lies in the raster as a whole: seven measures as whole numbers.

    mean, deviation and contrast are cut to whole numbers; asm is in 1/100000, correlation and homogeneity in 1/10000,
    entropy in 1/100. Two range windows gather a square's values; the pairs at the angle are an array of the row.
    """
    dc, dr = ANGLES[angle]
    d, n = range(-k, k + 1), 2 * k + 1
    line = F.array(*[F.first(value).over(Window.partitionBy(*by, "row").orderBy("col").rangeBetween(j, j)) for j in d])
    lines = df.withColumn("_l", line)
    none = F.array(*[F.lit(None).cast(dict(df.dtypes)[value])] * n)
    square = F.flatten(F.array(*[F.coalesce(F.first("_l").over(Window.partitionBy(*by, "col").orderBy("row").rangeBetween(i, i)), none) for i in d]))
    whole = lines.withColumn("_w", square).where(~F.exists("_w", lambda x: x.isNull()))
    at = lambda r, c: F.element_at("_w", r * n + c + 1).cast("double")
    pairs = [(r, c, r + dr, c + dc) for r in range(n) for c in range(n) if 0 <= r + dr < n and 0 <= c + dc < n]
    paired = whole.withColumn("_p", F.array(*[F.struct(at(a, b).alias("i"), at(c, e).alias("j")) for a, b, c, e in pairs]))
    m = float(len(pairs))
    total = lambda f: F.aggregate("_p", F.lit(0.0), lambda s, p: s + f(p)) / m
    paired = paired.withColumns({"_mi": total(lambda p: p["i"]), "_mj": total(lambda p: p["j"])})
    paired = paired.withColumns({"_si": F.sqrt(total(lambda p: (p["i"] - F.col("_mi")) * (p["i"] - F.col("_mi")))), "_sj": F.sqrt(total(lambda p: (p["j"] - F.col("_mj")) * (p["j"] - F.col("_mj"))))})
    same = F.transform("_p", lambda p: F.size(F.filter("_p", lambda q: q == p)).cast("double"))
    paired = paired.withColumn("_n", same)
    over = lambda f: F.aggregate("_n", F.lit(0.0), lambda s, x: s + f(x))
    cut = lambda c, by=1: F.floor(F.round(c * by, 6)).cast("long")
    toward_zero = lambda c: F.when(c < 0, -F.floor(-c)).otherwise(F.floor(c)).cast("long")
    correlation = total(lambda p: (p["i"] - F.col("_mi")) * (p["j"] - F.col("_mj"))) / (F.col("_si") * F.col("_sj") + 1e-6)
    return paired.select(
        *by, "row", "col", cut((F.col("_mi") + F.col("_mj")) / 2).alias("mean"), cut((F.col("_si") + F.col("_sj")) / 2).alias("deviation"), cut(over(lambda x: x / (m * m)), 100_000).alias("asm"),
        cut(total(lambda p: (p["i"] - p["j"]) * (p["i"] - p["j"]))).alias("contrast"), toward_zero(F.round(correlation * 10_000, 6)).alias("correlation"),
        cut(total(lambda p: 1 / (1 + F.abs(p["i"] - p["j"]))), 10_000).alias("homogeneity"), cut(over(lambda x: -F.log2(x / m) / m), 100).alias("entropy"),
    )


def normal_equations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(term, coefficient): least squares of the target by all features and a constant, from one row of sums of products."""
    import numpy as np

    terms: dict[str, Column] = {"const": F.lit(1.0)} | {f: F.col(f).cast("double") for f in features}
    rows = df.dropna(subset=[*features, target])
    names = list(terms)
    products = [F.sum(terms[a] * terms[b]) for i, a in enumerate(names) for b in names[i:]] + [F.sum(terms[a] * F.col(target).cast("double")) for a in names]
    sums = list(rows.agg(*products).first())
    if sums[0] is None:
        return df.sparkSession.createDataFrame([], "term string, coefficient double")
    n = len(names)
    x, it = np.zeros((n, n)), iter(sums)
    for i in range(n):
        for j in range(i, n):
            x[i, j] = x[j, i] = next(it)
    solved = np.linalg.lstsq(x, np.array(list(it)), rcond=None)[0]
    return df.sparkSession.createDataFrame(list(zip(names, map(float, solved), strict=True)), "term string, coefficient double")


def small_shifts(matches: DataFrame, most: float) -> DataFrame:
    """Matches (x, y, u, v) whose larger coordinate shift is below ``most``."""
    return matches.where(F.greatest(F.abs(F.col("x") - F.col("u")), F.abs(F.col("y") - F.col("v"))) < most)
