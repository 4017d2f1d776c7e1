"""Text, date, number and geometry helpers as Columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RAD = math.pi / 180
EARTH_KM = 6372.8
# Radius and half circumference of the spherical Mercator projection, in metres.
MERCATOR_RADIUS = 6378137.0
MERCATOR_EDGE = math.pi * MERCATOR_RADIUS
TILE = 256


def name_field(name: Column, token: int, sep: str = "_") -> Column:
    """A token (from 1, or from -1 at the end) of a file name without its extension; null if it has fewer."""
    return F.try_element_at(F.split(F.regexp_replace(name, r"\.[^.]*$", ""), sep), F.lit(token))


def number_with_unit(text: Column) -> Column:
    """The number that a text such as '3.2mm' starts with; null if none."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"^\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")), F.lit("S999999999.999999")).cast("double")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != F.lit("")))


def url_parts(url: Column) -> Column:
    """The parts of an address behind its scheme."""
    return F.split(F.regexp_replace(url, "^[a-z]+://", ""), "/")


def rounded_time(ts: Column, minutes: int) -> Column:
    """Epoch seconds of the nearest multiple of ``minutes``, halves up."""
    step = minutes * 60
    return F.floor((F.unix_timestamp(ts.cast("timestamp")) + step // 2) / step) * step


def weekday_number(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(day) + 1


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def is_prime(n: Column) -> Column:
    tried = F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(F.sqrt(n.cast("double"))).cast("int")))
    return (n > 1) & ~F.exists(tried, lambda d: (n % d == 0) & (d < n))


def julia_steps(zx: Column, zy: Column, cx: float, cy: float, most: int) -> Column:
    """Steps of z -> z * z + c until |z| >= 2, ``most`` at most."""
    start = F.struct(zx.cast("double").alias("x"), zy.cast("double").alias("y"), F.lit(0).alias("n"))

    def step(s: Column, _: Column) -> Column:
        go = s["x"] * s["x"] + s["y"] * s["y"] < 4
        return F.when(go, F.struct((s["x"] * s["x"] - s["y"] * s["y"] + cx).alias("x"), (2 * s["x"] * s["y"] + cy).alias("y"), (s["n"] + 1).alias("n"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["n"])


def with_julia_steps(grid: DataFrame, x: str, y: str, cx: float, cy: float, most: int, out: str = "steps") -> DataFrame:
    """``grid`` with the steps of ``julia_steps``, in batches of which only what goes on is computed further.

    Squares are made as a product of complex numbers is, so steps are those of complex arithmetic.
    """

    @F.pandas_udf("int")
    def steps(xs: pd.Series, ys: pd.Series) -> pd.Series:
        re, im = xs.to_numpy(float), ys.to_numpy(float)
        n, at = np.zeros(len(re), np.int32), np.arange(len(re))
        for _ in range(most):
            go = np.hypot(re, im) < 2
            re, im, at = re[go], im[go], at[go]
            if not len(at):
                break
            n[at] += 1
            re, im = re * re - im * im + cx, re * im + im * re + cy
        return pd.Series(n)

    return grid.withColumn(out, steps(x, y))


def wrapped16(c: Column) -> Column:
    """A whole number as signed 16 bits hold it."""
    return F.pmod(c + 32768, F.lit(65536)) - 32768


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays, summed in their order."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda x: F.sin(x * _RAD / 2) * F.sin(x * _RAD / 2)
    a = half(lat2 - lat1) + F.cos(lat1 * _RAD) * F.cos(lat2 * _RAD) * half(lon2 - lon1)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def affine(col: Column, row: Column, x0: float, dx: float, y0: float, dy: float) -> tuple[Column, Column]:
    """Map coordinates of a pixel's corner."""
    return x0 + col * dx, y0 + row * dy


def affine_inverse(x: Column, y: Column, x0: float, dx: float, y0: float, dy: float) -> tuple[Column, Column]:
    """(col, row) of the pixel that holds a map coordinate."""
    return F.floor((x - x0) / dx), F.floor((y - y0) / dy)


def to_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    y = F.log(F.tan((90 + lat) * math.pi / 360)) / _RAD
    return lon * MERCATOR_EDGE / 180.0, y * MERCATOR_EDGE / 180.0


def from_mercator(mx: Column, my: Column) -> tuple[Column, Column]:
    """(lat, lon)."""
    lat = 180 / math.pi * (2 * F.atan(F.exp(my / MERCATOR_EDGE * 180.0 * _RAD)) - math.pi / 2)
    return lat, mx / MERCATOR_EDGE * 180.0


def resolution(zoom: int) -> float:
    return 2 * MERCATOR_EDGE / TILE / 2**zoom


def tile_of(mx: Column, my: Column, zoom: int) -> tuple[Column, Column]:
    """Tile numbers from the lower left."""
    size = resolution(zoom) * TILE
    number = lambda m: F.ceil((m + MERCATOR_EDGE) / size).cast("int") - 1
    return number(mx), number(my)


def tile_bounds(tx: Column, ty: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    size = resolution(zoom) * TILE
    return tx * size - MERCATOR_EDGE, ty * size - MERCATOR_EDGE, (tx + 1) * size - MERCATOR_EDGE, (ty + 1) * size - MERCATOR_EDGE


def quadkey(tx: Column, ty: Column, zoom: int) -> Column:
    """Digits from the coarsest level to the finest; rows are counted from the top there."""
    top = F.lit(2**zoom - 1) - ty
    bit = lambda v, i: F.shiftright(v, zoom - i).bitwiseAND(F.lit(1))
    return F.concat(*[(bit(tx, i) + 2 * bit(top, i)).cast("string") for i in range(1, zoom + 1)])


def geodetic_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Tile numbers in the geodetic profile, whose level 0 is two tiles wide."""
    size = 180.0 / 2**zoom
    return F.ceil((lon + 180) / size).cast("int") - 1, F.ceil((lat + 90) / size).cast("int") - 1


def shoelace(xs: Column, ys: Column) -> Column:
    """Signed area of a closed ring (first point repeated at the end): positive if counterclockwise."""
    i = F.sequence(F.lit(1), F.size(xs) - 1)
    cross = F.transform(i, lambda k: F.element_at(xs, k) * F.element_at(ys, k + 1) - F.element_at(xs, k + 1) * F.element_at(ys, k))
    return F.aggregate(cross, F.lit(0.0), lambda s, x: s + x) / 2


def in_ring(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Whether a point is inside a closed ring, by the number of edges that a ray crosses."""
    i = F.sequence(F.lit(1), F.size(xs) - 1)

    def crosses(k: Column) -> Column:
        x1, y1, x2, y2 = F.element_at(xs, k), F.element_at(ys, k), F.element_at(xs, k + 1), F.element_at(ys, k + 1)
        spans = (y1 > y) != (y2 > y)
        return F.when(spans & (x < F.try_divide((x2 - x1) * (y - y1), y2 - y1) + x1), 1).otherwise(0)

    return F.aggregate(F.transform(i, crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def squared_distance_to_ring(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Squared distance from a point to the nearest side of a closed ring."""

    def side(k: Column) -> Column:
        x1, y1 = F.element_at(xs, k), F.element_at(ys, k)
        dx, dy = F.element_at(xs, k + 1) - x1, F.element_at(ys, k + 1) - y1
        along = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        ex, ey = x - x1 - t * dx, y - y1 - t * dy
        return ex * ex + ey * ey

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(xs) - 1), side))


# The WGS 84 ellipsoid, and the scale of a UTM zone's central meridian.
WGS84_A, WGS84_E2, UTM_SCALE = 6378137.0, 0.0066943799901413165, 0.9996


def to_utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern form) in metres, by the series in the difference of longitude; within a zone exact to millimetres."""
    e2 = WGS84_E2
    ep2 = e2 / (1 - e2)
    phi, a = lat * _RAD, (lon - (6 * zone - 183)) * _RAD * F.cos(lat * _RAD)
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    t, c = F.tan(phi) * F.tan(phi), ep2 * F.cos(phi) * F.cos(phi)
    arc = WGS84_A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    a2 = a * a
    east = UTM_SCALE * n * (a + (1 - t + c) * a * a2 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a * a2 * a2 / 120) + 500000
    north = UTM_SCALE * (arc + n * F.tan(phi) * (a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a2 * a2 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a2 * a2 * a2 / 720))
    return east, north
