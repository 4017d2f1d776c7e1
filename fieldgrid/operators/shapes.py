"""Polygons on rasters: cutlines, surroundings, class areas and united outlines; rasters turned and rescaled."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from .outlines import outlines
from .regions import components
from .relational import points_in_boxes


def _placed(pixels: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Pixels with the map place (_x, _y) of their centres; ``grid``: (left edge, pixel width, top edge, pixel height)."""
    x0, dx, y0, dy = grid
    return pixels.withColumns({"_x": x0 + (F.col("col") + 0.5) * dx, "_y": y0 + (F.col("row") + 0.5) * dy})


def clip_by_cutline(pixels: DataFrame, polygons: DataFrame, key: str, value: str, grid: Sequence[float], cell: float, nodata: float | None = None) -> DataFrame:
    """(key, row, col, value): for each polygon the pixels in its bounds, ``nodata`` where a centre is outside it."""
    met = points_in_boxes(_placed(pixels.select("row", "col", value), grid), polygons.select(key, "xs", "ys"), cell, "_x", "_y")
    inside = scalar.in_ring(F.col("_x"), F.col("_y"), F.col("xs"), F.col("ys"))
    return met.select(key, "row", "col", F.when(inside, F.col(value)).otherwise(F.lit(nodata)).alias(value))


def class_area_in_polygons(pixels: DataFrame, polygons: DataFrame, key: str, value: str, wanted: float, grid: Sequence[float], cell: float, unit: float = 666.67) -> DataFrame:
    """(key, n, area): pixels of one class whose centres are in each polygon, and their area in units; polygons without any have 0."""
    clipped = clip_by_cutline(pixels, polygons, key, value, grid, cell)
    n = clipped.groupBy(key).agg(F.count_if(F.col(value) == wanted).alias("n"))
    out = polygons.select(key).join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("area", F.round(F.col("n") * abs(grid[1] * grid[3]) / unit, 4))


def _rings(x: pa.Array, y: pa.Array, xs: pa.Array, ys: pa.Array) -> tuple[np.ndarray, ...]:
    """Points beside the sides of their rings: (row, x, y, x1, y1, x2, y2)."""
    a, b = (c.to_numpy(zero_copy_only=False).astype(float) for c in (xs.flatten(), ys.flatten()))
    row = np.repeat(np.arange(len(xs)), xs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = np.flatnonzero(row[1:] == row[:-1])
    x, y = (c.to_numpy(zero_copy_only=False).astype(float)[row[at]] for c in (x, y))
    return row[at], x, y, a[at], b[at], a[at + 1], b[at + 1]


def _holds(n: int, sides: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether rings hold their points: ``scalar.in_ring`` of many rows at a time."""
    row, x, y, x1, y1, x2, y2 = sides
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return np.bincount(row[crosses], minlength=n) % 2 == 1


def inside(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """``scalar.in_ring`` on arrays of a batch of rows, for many rows."""

    @F.arrow_udf("boolean")
    def held(x: pa.Array, y: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array(_holds(len(x), _rings(x, y, xs, ys)))

    return held(x.cast("double"), y.cast("double"), xs.cast("array<double>"), ys.cast("array<double>"))


def inside_or_near(x: Column, y: Column, xs: Column, ys: Column, reach: float) -> Column:
    """Whether a closed ring holds a point or has a side within ``reach`` of it, on arrays of a batch of rows."""

    @F.arrow_udf("boolean")
    def held(x: pa.Array, y: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        sides = _rings(x, y, xs, ys)
        row, px, py, x1, y1, x2, y2 = sides
        dx, dy = x2 - x1, y2 - y1
        with np.errstate(divide="ignore", invalid="ignore"):
            along = ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)
        t = np.clip(np.where((dx == 0) & (dy == 0), 0.0, along), 0.0, 1.0)
        ex, ey = px - x1 - t * dx, py - y1 - t * dy
        near = np.bincount(row[ex * ex + ey * ey <= reach * reach], minlength=len(x)) > 0
        return pa.array(_holds(len(x), sides) | near)

    return held(x.cast("double"), y.cast("double"), xs.cast("array<double>"), ys.cast("array<double>"))


def near_polygons(points: DataFrame, polygons: DataFrame, reach: float, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of points and the polygons (closed rings ``xs``, ``ys``) that hold them or have a side within ``reach``."""
    padded = lambda c: F.array(F.array_min(c) - reach, F.array_max(c) + reach)
    boxes = polygons.withColumns({"_bx": padded(F.col("xs")), "_by": padded(F.col("ys"))})
    near = inside_or_near(F.col(x), F.col(y), F.col("xs"), F.col("ys"), reach)
    return points_in_boxes(points, boxes, cell, x, y, "_bx", "_by").where(near).drop("_bx", "_by")


def united_outlines(polygons: DataFrame, by: str, rows: int) -> DataFrame:
    """(by, component, ring, i, x, y): corners of the rings around what the polygons of a group cover together.

    Coordinates are in cells of a unit grid: a cell is covered if its centre is in a polygon, so outlines are exact for
    sides on grid lines and else follow the cells. ``by`` and coordinates are whole numbers from 0; ``rows`` is more
    than the largest y. A group's cells lie in a band of rows of its own. Rings as ``operators.outlines.outlines`` gives them.
    """
    band = rows + 1
    over = lambda c: F.explode(F.sequence(F.floor(F.array_min(c)), F.ceil(F.array_max(c)) - 1))
    dealt = polygons.select(by, "xs", "ys").where(F.size("xs") > 3).repartition(by, "xs", "ys")  # small files are few tasks
    cells = dealt.withColumn("row", over("ys")).withColumn("col", over("xs"))
    covered = cells.where(inside(F.col("col") + 0.5, F.col("row") + 0.5, F.col("xs"), F.col("ys"))).select(by, (F.col(by) * band + F.col("row")).alias("row"), "col").distinct()
    corners = outlines(components(covered, by, False, None))
    group = F.floor(F.col("component") / (F.lit(1 << 31) * band))
    return corners.select(group.alias(by), "component", "ring", "i", "x", (F.col("y") - group * band).alias("y"))


def _nearest_source(at: Column, num: int, den: int) -> tuple[Column, Column]:
    """First and last place of an axis scaled by num / den whose nearest source place is ``at``."""
    edge = lambda s: F.ceil((2 * s * num - den) / (2.0 * den)).cast("long")
    return edge(at), edge(at + 1) - 1


def rescaled(df: DataFrame, num: int, den: int) -> DataFrame:
    """Pixels of a raster whose sides are num / den as long: each takes its nearest pixel. No join and no shuffle."""
    out = df
    for axis in ("row", "col"):
        low, high = _nearest_source(F.col(axis), num, den)
        places = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))
        out = out.withColumn(axis, F.explode(places))
    return out


def turned(df: DataFrame, value: str, degrees: float, rows: int, cols: int) -> DataFrame:
    """(row, col, value): a raster turned about its centre, anticlockwise on the screen; each pixel takes its nearest, null beyond the edges."""
    a, cy, cx = math.radians(degrees), (rows - 1) / 2, (cols - 1) / 2
    y, x = F.col("row") - cy, F.col("col") - cx
    nearest = lambda c: F.floor(F.round(c, 9) + 0.5)
    source = df.select("row", "col", nearest(cy + x * math.sin(a) + y * math.cos(a)).alias("_r"), nearest(cx + x * math.cos(a) - y * math.sin(a)).alias("_c"))
    there = df.select(F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    return source.join(there, ["_r", "_c"], "left").select("row", "col", value)
