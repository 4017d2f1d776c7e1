"""Focal operators, resampling, mosaics and blocks of pixel tables (row, col, value ...).

Neighbourhoods are two range windows, one along rows and one along columns: two shuffles for any size of the square,
and no copies of pixels. A raster id in ``by`` keeps rasters apart.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _along(axis: str, k: int, by: Sequence[str]) -> Window:
    other = "col" if axis == "row" else "row"
    return Window.partitionBy(*by, other).orderBy(axis).rangeBetween(-k, k)


def focal(df: DataFrame, value: str, out: str, kind: str, k: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, maximum or mean of the square of 2k + 1 pixels around each pixel; pixels that aren't there are left out."""
    if kind in ("min", "max"):
        f = getattr(F, kind)
        return df.withColumn("_h", f(value).over(_along("col", k, by))).withColumn(out, f("_h").over(_along("row", k, by))).drop("_h")
    sums = df.withColumn("_s", F.sum(value).over(_along("col", k, by))).withColumn("_n", F.count(value).over(_along("col", k, by)))
    total, n = F.sum("_s").over(_along("row", k, by)), F.sum("_n").over(_along("row", k, by))
    return sums.withColumn("_count", n).withColumn(out, total / n).withColumnRenamed("_count", f"{out}_n").drop("_s", "_n")


def focal_mean(df: DataFrame, value: str, out: str, k: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the square around each pixel whose square is whole."""
    return focal(df, value, out, "mean", k, by).where(F.col(f"{out}_n") == (2 * k + 1) ** 2).drop(f"{out}_n")


def erode(df: DataFrame, value: str, out: str, k: int = 1, by: Sequence[str] = ()) -> DataFrame:
    return focal(df, value, out, "min", k, by)


def dilate(df: DataFrame, value: str, out: str, k: int = 1, by: Sequence[str] = ()) -> DataFrame:
    return focal(df, value, out, "max", k, by)


def opening(df: DataFrame, value: str, out: str, k: int = 1, times: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Eroded as often as asked for, then dilated as often."""
    return _repeated(df, value, out, k, by, ["min"] * times + ["max"] * times)


def closing(df: DataFrame, value: str, out: str, k: int = 1, times: int = 1, by: Sequence[str] = ()) -> DataFrame:
    return _repeated(df, value, out, k, by, ["max"] * times + ["min"] * times)


def _repeated(df: DataFrame, value: str, out: str, k: int, by: Sequence[str], kinds: list[str]) -> DataFrame:
    now = value
    for i, kind in enumerate(kinds):
        df = focal(df, now, f"_f{i}", kind, k, by)
        df = df if now == value else df.drop(now)
        now = f"_f{i}"
    return df.withColumnRenamed(now, out)


def top_hat(df: DataFrame, value: str, out: str, k: int = 1, by: Sequence[str] = ()) -> DataFrame:
    return opening(df, value, "_o", k, by=by).withColumn(out, F.col(value) - F.col("_o")).drop("_o")


def bottom_hat(df: DataFrame, value: str, out: str, k: int = 1, by: Sequence[str] = ()) -> DataFrame:
    return closing(df, value, "_o", k, by=by).withColumn(out, F.col("_o") - F.col(value)).drop("_o")


def with_neighbours(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` and the eight neighbours as nw, n, ne, w, e, sw, s, se; null where there is none."""
    beside = lambda axis, d, c: F.first(c).over(Window.partitionBy(*by, "col" if axis == "row" else "row").orderBy(axis).rangeBetween(d, d))
    across = df.withColumn("w", beside("col", -1, value)).withColumn("e", beside("col", 1, value))
    names = {"nw": ("w", -1), "n": (value, -1), "ne": ("e", -1), "sw": ("w", 1), "s": (value, 1), "se": ("e", 1)}
    return across.withColumns({k: beside("row", d, c) for k, (c, d) in names.items()})


def slope(df: DataFrame, value: str, out: str, size: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Slope in degrees (Horn) of the pixels that have all eight neighbours."""
    nb = with_neighbours(df, value, by)
    c = {k: F.col(k) for k in ("nw", "n", "ne", "w", "e", "sw", "s", "se")}
    dx = ((c["ne"] + 2 * c["e"] + c["se"]) - (c["nw"] + 2 * c["w"] + c["sw"])) / (8 * size)
    dy = ((c["sw"] + 2 * c["s"] + c["se"]) - (c["nw"] + 2 * c["n"] + c["ne"])) / (8 * size)
    steep = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    return nb.withColumn(out, steep).where(F.col(out).isNotNull()).drop(*c)


def gaussian(df: DataFrame, value: str, out: str, sigma: float, by: Sequence[str] = ()) -> DataFrame:
    """Separable Gaussian; the kernel has ceil(2 * round(3 sigma) + 1) taps, and pixels outside count as zero."""
    k = math.ceil(2 * round(3 * sigma) + 1) // 2
    taps = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-k, k + 1)]
    taps = [t / sum(taps) for t in taps]

    def pass_(axis: str, c: str) -> Column:
        w = Window.partitionBy(*by, "col" if axis == "row" else "row").orderBy(axis)
        terms = [F.coalesce(F.first(c).over(w.rangeBetween(d, d)), F.lit(0.0)) * t for d, t in zip(range(-k, k + 1), taps, strict=True)]
        return sum(terms[1:], terms[0])

    return df.withColumn("_g", pass_("col", value)).withColumn(out, pass_("row", "_g")).drop("_g")


def block_mean(df: DataFrame, value: str, out: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean of blocks of n by n pixels."""
    return df.groupBy(*by, F.floor(F.col("row") / n).alias("row"), F.floor(F.col("col") / n).alias("col")).agg(F.avg(value).alias(out))


def repeat_pixels(df: DataFrame, n: int) -> DataFrame:
    """Each pixel as n by n pixels."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    wide = df.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return wide.withColumn("row", F.col("row") * n + F.col("_i")).withColumn("col", F.col("col") * n + F.col("_j")).drop("_i", "_j")


def bilinear(df: DataFrame, value: str, points: DataFrame) -> DataFrame:
    """``points`` (y, x in pixels) with the value interpolated between the four pixels around; null at the edges.

    A point asks for four pixels by an equi-join; the weighted sum is pre-aggregated.
    """
    y0, x0 = F.floor("y"), F.floor("x")
    fy, fx = F.col("y") - y0, F.col("x") - x0
    corners = [(0, 0, (1 - fy) * (1 - fx)), (0, 1, (1 - fy) * fx), (1, 0, fy * (1 - fx)), (1, 1, fy * fx)]
    asks = F.explode(F.array(*[F.struct((y0 + i).alias("row"), (x0 + j).alias("col"), w.alias("w")) for i, j, w in corners])).alias("_a")
    met = points.select(*points.columns, asks).select(*points.columns, "_a.*").join(df.select("row", "col", value), ["row", "col"], "left")
    whole = F.count(value) == 4
    return met.groupBy(*points.columns).agg(F.when(whole, F.sum(F.col("w") * F.col(value))).alias(value))


def window_mean(df: DataFrame, value: str, points: DataFrame, k: int, positive: bool = False) -> DataFrame:
    """``points`` (row, col) with the mean of the square around, as far as it is in the raster."""
    steps = F.sequence(F.lit(-k), F.lit(k))
    asked = points.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    asked = asked.select(*[F.col(c).alias(f"_p{c}") if c in ("row", "col") else F.col(c) for c in points.columns], (F.col("row") + F.col("_i")).alias("row"), (F.col("col") + F.col("_j")).alias("col"))
    v = F.when(F.col(value) > 0, F.col(value)) if positive else F.col(value)
    keys = [f"_p{c}" if c in ("row", "col") else c for c in points.columns]
    out = asked.join(df.select("row", "col", value), ["row", "col"]).groupBy(*keys).agg(F.avg(v).alias(value))
    return out.withColumnRenamed("_prow", "row").withColumnRenamed("_pcol", "col")


def mosaic(rasters: DataFrame, value: str, order: str, nodata: float) -> DataFrame:
    """For each pixel the value of the last raster that has data there."""
    return rasters.groupBy("row", "col").agg(F.max_by(value, F.when(F.col(value) != nodata, F.col(order))).alias("_v"), F.max(F.when(F.col(value) != nodata, 1)).alias("_has")).select("row", "col", F.when(F.col("_has") == 1, F.col("_v")).otherwise(F.lit(nodata)).alias(value))


def on_grid(values: DataFrame, grid: DataFrame, value: str, default: float) -> DataFrame:
    """Every pixel of ``grid``; the default where ``values`` has none."""
    return grid.join(values, ["row", "col"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def strips(df: DataFrame, lines: int, halo: int, last: Column, axis: str = "row") -> DataFrame:
    """Pixels by strip of ``lines`` rows (or columns), with those of the neighbouring strips that are within the halo (``core`` is false there)."""
    own = F.floor(F.col(axis) / lines)
    around = F.array_distinct(F.array(own, F.floor((F.col(axis) - halo) / lines), F.floor((F.col(axis) + halo) / lines)))
    inside = F.filter(around, lambda s: (s >= 0) & (s <= F.floor(last / lines)))
    return df.withColumn("strip", F.explode(inside)).withColumn("core", F.col("strip") == own)


def glcm(df: DataFrame, value: str, drow: int, dcol: int, by: Sequence[str] = ()) -> DataFrame:
    """Texture of each raster or tile in ``by`` from the pairs of levels at an offset: seven measures, before scaling.

    Pairs are counted by levels (a pre-aggregated shuffle); the measures are aggregates over the counts.
    """
    at = df.select(*by, "row", "col", F.col(value).alias("i"))
    there = at.select(*by, (F.col("row") - drow).alias("row"), (F.col("col") - dcol).alias("col"), F.col("i").alias("j"))
    n = at.join(there, [*by, "row", "col"]).groupBy(*by, "i", "j").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    w = Window.partitionBy(*by)
    p = p.withColumn("mr", F.sum(F.col("i") * F.col("p")).over(w)).withColumn("mc", F.sum(F.col("j") * F.col("p")).over(w))
    di, dj = F.col("i") - F.col("mr"), F.col("j") - F.col("mc")
    p = p.withColumn("sr", F.sqrt(F.sum(di * di * F.col("p")).over(w))).withColumn("sc", F.sqrt(F.sum(dj * dj * F.col("p")).over(w)))
    d = (F.col("i") - F.col("j")).cast("double")
    return p.groupBy(*by).agg(
        F.max((F.col("mr") + F.col("mc")) / 2).alias("mean"), F.max((F.col("sr") + F.col("sc")) / 2).alias("deviation"), F.sum(F.col("p") * F.col("p")).alias("asm"),
        F.sum(d * d * F.col("p")).alias("contrast"), F.sum(di * dj * F.col("p") / (F.col("sr") * F.col("sc") + 1e-6)).alias("correlation"),
        F.sum(F.col("p") / (1 + F.abs(d))).alias("homogeneity"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"),
    )


def window_vectors(df: DataFrame, bands: Sequence[str], k: int, default: float = 0, by: Sequence[str] = ()) -> DataFrame:
    """(row, col, features): the values of each band in the square around a pixel whose first band is positive, band by band, row by row.

    Pixels that aren't there count as the default. Two range windows gather the values; nothing is copied to neighbours.
    """
    names = []
    for b in bands:
        across = Window.partitionBy(*by, "row").orderBy("col")
        down = Window.partitionBy(*by, "col").orderBy("row")
        d = range(-k, k + 1)
        line = F.array(*[F.first(b).over(across.rangeBetween(j, j)) for j in d])
        df = df.withColumn(f"_l_{b}", line)
        none = F.array(*[F.lit(None).cast(dict(df.dtypes)[b])] * len(d))
        whole = F.array(*[F.coalesce(F.first(f"_l_{b}").over(down.rangeBetween(i, i)), none) for i in d])
        df = df.withColumn(f"_w_{b}", F.transform(F.flatten(whole), lambda x: F.coalesce(x, F.lit(default))))
        names.append(f"_w_{b}")
    return df.where(F.col(bands[0]) > 0).select(*by, "row", "col", F.concat(*names).alias("features"))


def at_points(df: DataFrame, points: DataFrame, x0: float, dx: float, y0: float, dy: float) -> DataFrame:
    """``points`` (x, y in map units) with the pixel that holds each."""
    placed = points.withColumn("col", F.floor((F.col("x") - x0) / dx)).withColumn("row", F.floor((F.col("y") - y0) / dy))
    return placed.join(df, ["row", "col"], "left")


def proximity(df: DataFrame, burned: Column, out: str, most: int) -> DataFrame:
    """Distance in pixels to the nearest burned pixel within ``most``; null beyond.

    A distance transform by axes in two windows: the nearest burned pixel along each row, then the least sum of squares
    over the rows in reach of each column. No pixel is copied, but places that the raster lacks next to a pixel, and
    that have a burned one in reach along their row, are filled in between.
    """
    line, col = Window.partitionBy("row").orderBy("col"), F.col("col")
    here = F.when(burned, col)
    marks = {
        "_l": F.last(here, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "_r": F.first(here, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing)),
        "_l2": F.last(here, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)), "_r2": F.first(here, ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)),
        "_prev": F.lag("col").over(line), "_next": F.lead("col").over(line),
    }
    cell = lambda c, left, right, real: F.struct(c.cast("long").alias("c"), F.least(c - F.col(left), F.col(right) - c).alias("d"), F.lit(real).alias("real"))

    def gap(low: Column, high: Column, left: str, right: str) -> Column:
        places = F.when(high >= low, F.sequence(low, high))
        return F.filter(F.transform(places, lambda c: cell(c, left, right, False)), lambda x: x["d"] <= most)

    before = gap(F.greatest(F.col("_prev") + 1, col - most), col - 1, "_l2", "_r")
    after = gap(col + 1, F.least(F.col("_next") - 1, col + most), "_l", "_r2")
    none = F.array().cast("array<struct<c:bigint,d:bigint,real:boolean>>")
    cells = F.concat(F.array(cell(col, "_l", "_r", True)), F.coalesce(before, none), F.coalesce(after, none))
    flat = df.withColumns(marks).withColumn("_cell", F.explode(cells)).drop(*marks)
    near = F.when(F.col("_cell.d") <= most, F.struct(F.col("row").alias("r"), F.col("_cell.d").alias("d")))
    met = F.collect_list(near).over(Window.partitionBy("_cell.c").orderBy("row").rangeBetween(-most, most))
    best = F.array_min(F.transform("_n", lambda n: n["d"] * n["d"] + (n["r"] - F.col("row")) * (n["r"] - F.col("row"))))
    found = flat.withColumn("_n", met).where("_cell.real").withColumn("_s", best)
    return found.withColumn(out, F.when(F.col("_s") <= most * most, F.sqrt("_s"))).drop("_cell", "_n", "_s")


def pyramid(df: DataFrame, value: str, levels: int) -> DataFrame:
    """(level, row, col, mean): overviews by halves, each mean from the sums of the level before."""
    at = df.select("row", "col", F.col(value).cast("double").alias("s"), F.lit(1).alias("n"))
    out = None
    for level in range(1, levels + 1):
        at = at.groupBy(F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        here = at.select(F.lit(level).alias("level"), "row", "col", (F.col("s") / F.col("n")).alias("mean"))
        out = here if out is None else out.unionByName(here)
    return out


def reclassify(df: DataFrame, value: str, mapping: DataFrame, default: float | None = None) -> DataFrame:
    """Values by a table (from, to), which is as small as a legend; others get the default, or stay."""
    met = df.join(F.broadcast(mapping), df[value] == mapping["from"], "left")
    other = df[value] if default is None else F.lit(default)
    return met.select(*[df[c] for c in df.columns if c != value], F.coalesce(mapping["to"], other).alias(value))
