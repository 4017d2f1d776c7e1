"""Geometry aggregates: hulls, boxes, interpolation between points."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from .neighbours import nearest, on_globe


def extent(df: DataFrame, by: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counterclockwise, by monotone chain."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ps: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def convex_hulls(df: DataFrame, by: str, x: str = "x", y: str = "y", salts: int = 32) -> DataFrame:
    """(by, xs, ys, area): the hull of each group as a closed ring.

    In two rounds: hulls of ``salts`` parts of each group, then the hull of their corners, so that no task holds all
    points of a large group.
    """
    kind = dict(df.dtypes)[by]

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)))
        return pd.DataFrame({by: pdf[by].iloc[0], "x": [p[0] for p in h], "y": [p[1] for p in h]})

    def ring(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "xs": [[p[0] for p in h] + [h[0][0]]], "ys": [[p[1] for p in h] + [h[0][1]]]})

    points = df.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    part = F.pmod(F.xxhash64("x", "y"), F.lit(salts)).alias("salt")
    first = points.select(by, "x", "y", part).groupBy(by, "salt").applyInPandas(corners, f"`{by}` {kind}, x double, y double")
    rings = first.groupBy(by).applyInPandas(ring, f"`{by}` {kind}, xs array<double>, ys array<double>")
    return rings.withColumn("area", F.when(F.size("xs") > 3, F.abs(scalar.shoelace(F.col("xs"), F.col("ys")))).otherwise(0.0))


def clip_convex(df: DataFrame, out: str = "clipped_area") -> DataFrame:
    """Area of the intersection of two convex rings (xs, ys) and (cxs, cys) in each row."""

    @F.pandas_udf("double")
    def area(xs: pd.Series, ys: pd.Series, cxs: pd.Series, cys: pd.Series) -> pd.Series:
        return pd.Series([_clipped(list(zip(a, b, strict=True)), list(zip(c, d, strict=True))) for a, b, c, d in zip(xs, ys, cxs, cys, strict=True)], dtype=float)

    return df.withColumn(out, area("xs", "ys", "cxs", "cys"))


def _signed(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def _clipped(ring: list[tuple[float, float]], clip: list[tuple[float, float]]) -> float:
    now, edges = ring[:-1], clip if _signed(clip[:-1]) > 0 else clip[::-1]
    for (x1, y1), (x2, y2) in zip(edges, edges[1:], strict=False):
        side = lambda p: (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)  # noqa: E731, B023
        out = []
        for p, q in zip(now, now[1:] + now[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        now = out
        if not now:
            return 0.0
    return abs(_signed(now))


def idw(cells: DataFrame, stations: DataFrame, cell_key: Sequence[str], k: int, power: float = 1.0) -> DataFrame:
    """Inverse-distance mean of the k nearest stations (lat, lon, value) at each cell (clat, clon)."""
    d = scalar.haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon")) + 1e-6
    near = nearest(cells, stations, cell_key, on_globe(F.col("clat"), F.col("clon")), on_globe(F.col("lat"), F.col("lon")), d, "station", k, slack=1e-9)
    w = 1 / F.pow("distance", F.lit(power))
    return near.groupBy(*cell_key).agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"))
