"""Overlays of polygons of any direction as geometry: unions, intersections, differences and buffers.

Rings are dealt to square cells that their boxes meet. In a cell, sides are cut where they cross, where a corner lies on
them, and at the cell's borders; cuts are snapped to a fine grid, alike in every cell that sees them. For each piece in
the cell it is told which polygons lie on its two sides; pieces with the overlay on one side only are its boundary. A
window around each corner gives the side that follows, and rings are closed over all cells by pointer doubling (in tasks
for groups of few sides), so no task holds a large ring of the result or all polygons of a large group. A task arranges
many small cells at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .geometry import hull_of
from .outlines import ranked
from .tables import written

#: Whether a place belongs to an overlay, from whether polygons of the first and the second layer hold it.
KINDS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "symmetric_difference": lambda a, b: a ^ b,
}
#: Cells that a task arranges at a time, and pairs of their sides.
_CELLS, _PAIRS = 256, 1 << 19


def _pairs(of: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of ``of`` with the places from its start to its stop, some of them at a time."""
    n = stop - start
    part = np.cumsum(n) // _PAIRS
    for at in np.split(np.arange(len(of)), np.flatnonzero(np.diff(part)) + 1):
        m = n[at]
        within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(of[at], m), np.repeat(start[at], m) + within


def _sides(rings: pa.Array, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sides (x1, y1, x2, y2) of all rings, the smaller end first, by cell and polygon; their cells, polygons and these's layers."""
    ids, layer, xs, ys = (rings.field(k) for k in range(4))
    code = pc.dictionary_encode(ids).indices.to_numpy().astype(np.int64)
    _, polygon = np.unique(cell * (code.max(initial=0) + 1) + code, return_inverse=True)
    layers = np.zeros(polygon.max(initial=-1) + 1, int)
    layers[polygon] = layer.to_numpy()
    ring = np.repeat(np.arange(len(rings)), pc.list_value_length(xs).to_numpy())
    x, y = xs.flatten().to_numpy(), ys.flatten().to_numpy()
    one = np.flatnonzero(ring[:-1] == ring[1:])
    e = np.stack([x[one], y[one], x[one + 1], y[one + 1]], axis=1)
    swap = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    e[swap] = e[swap][:, [2, 3, 0, 1]]
    kept = np.flatnonzero((e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3]))
    kept = kept[np.argsort(polygon[ring[one[kept]]], kind="stable")]  # polygons are numbered by cell
    at = ring[one[kept]]
    return e[kept], cell[at], polygon[at], layers


def _cuts(e: np.ndarray, of: np.ndarray, box: np.ndarray, snap: float) -> tuple[np.ndarray, np.ndarray]:
    """Sides, in order, and where they are cut, as shares of their length in order, from 0 to 1. ``of``: cells, in order."""
    x, y, dx, dy = e[:, 0], e[:, 1], e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    length = np.hypot(dx, dy)
    right, low, high = e[:, 2] + 4 * snap, np.minimum(y, e[:, 3]) - 4 * snap, np.maximum(y, e[:, 3]) + 4 * snap  # x is the least
    padded = x - 4 * snap
    every = np.arange(len(e))
    sides, shares = [every, every], [np.zeros(len(e)), np.ones(len(e))]

    def cut(i: np.ndarray, t: np.ndarray) -> None:
        some = (t > 0) & (t < 1)
        sides.append(i[some])
        shares.append(t[some])

    with np.errstate(divide="ignore", invalid="ignore"):
        # Crossings, by one formula whichever of the two sides asks.
        for i, j in _pairs(every, np.searchsorted(of, of), np.searchsorted(of, of, side="right")):
            by_box = (low[j] <= high[i]) & (low[i] <= high[j]) & (padded[j] <= right[i]) & (padded[i] <= right[j])
            i, j = i[by_box], j[by_box]
            cross = dx[i] * dy[j] - dy[i] * dx[j]
            t = ((x[j] - x[i]) * dy[j] - (y[j] - y[i]) * dx[j]) / cross
            u = ((x[j] - x[i]) * dy[i] - (y[j] - y[i]) * dx[i]) / cross
            edge = (t > -snap / length[i]) & (t < 1 + snap / length[i]) & (u > -snap / length[j]) & (u < 1 + snap / length[j])
            met = (np.abs(cross) > 1e-12 * length[i] * length[j]) & edge
            cut(i[met], t[met])
        # Corners on the side.
        corners = np.unique(np.concatenate([np.column_stack([of, e[:, :2]]), np.column_stack([of, e[:, 2:]])]), axis=0)
        for i, j in _pairs(every, np.searchsorted(corners[:, 0], of), np.searchsorted(corners[:, 0], of, side="right")):
            by_box = (corners[j, 2] <= high[i]) & (low[i] <= corners[j, 2]) & (corners[j, 1] <= right[i]) & (padded[i] <= corners[j, 1])
            i, j = i[by_box], j[by_box]
            ox, oy = corners[j, 1] - x[i], corners[j, 2] - y[i]
            on = np.abs(ox * dy[i] - oy * dx[i]) / length[i] <= snap
            cut(i[on], ((ox * dx[i] + oy * dy[i]) / length[i] ** 2)[on])
        for at, start, step in ((box[:, 0], x, dx), (box[:, 2], x, dx), (box[:, 1], y, dy), (box[:, 3], y, dy)):
            cut(every, (at - start) / step)
    i, t = np.concatenate(sides), np.concatenate(shares)
    order = np.lexsort((t, i))
    i, t = i[order], t[order]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])])
    return i[new], t[new]


def _pieces(e: np.ndarray, of: np.ndarray, corner: np.ndarray, cell: float, snap: float) -> np.ndarray:
    """Distinct pieces of sides (cell, x, y, x2, y2), in grid steps, the smaller end first. ``corner``: each cell's numbers."""
    box = np.column_stack([corner * cell, (corner + 1) * cell])[of]
    meets = (np.maximum(e[:, 0], e[:, 2]) >= box[:, 0] - snap) & (np.minimum(e[:, 0], e[:, 2]) <= box[:, 2] + snap) & (np.maximum(e[:, 1], e[:, 3]) >= box[:, 1] - snap) & (np.minimum(e[:, 1], e[:, 3]) <= box[:, 3] + snap)
    e, of = e[meets], of[meets]
    if not len(e):
        return np.empty((0, 5), np.int64)
    i, t = _cuts(e, of, box[meets], snap)
    p = np.rint((e[i, :2] + t[:, None] * (e[i, 2:] - e[i, :2])) / snap).astype(np.int64)
    one = np.flatnonzero(i[:-1] == i[1:])
    p = np.column_stack([of[i[one]], p[one], p[one + 1]])
    p = p[(p[:, 1] != p[:, 3]) | (p[:, 2] != p[:, 4])]
    swap = (p[:, 1] > p[:, 3]) | ((p[:, 1] == p[:, 3]) & (p[:, 2] > p[:, 4]))
    p[swap] = p[swap][:, [0, 3, 4, 1, 2]]
    middle = (p[:, 1:3] + p[:, 3:]) / 2 * snap
    own = (np.floor(middle / cell) == corner[p[:, 0]]).all(axis=1)
    return np.unique(p[own], axis=0)


def _boundary(rings: pa.Array, of: np.ndarray, corner: np.ndarray, cell: float, snap: float, kind: str) -> np.ndarray:
    """Pieces of the overlay's boundary in some cells, as (cell, x, y, x2, y2) in grid steps; the overlay is on the left."""
    e, of, polygon, layers = _sides(rings, of)
    pieces = _pieces(e, of, corner, cell, snap)
    middle, step = (pieces[:, 1:3] + pieces[:, 3:]) / 2 * snap, pieces[:, 3:] - pieces[:, 1:3]
    flat = np.abs(step[:, 0]) >= np.abs(step[:, 1])  # a ray upwards, else to the right
    held = np.zeros((2, 2, len(pieces)), bool)  # by what lies beyond and on this side, and by layer
    for i, j in _pairs(np.arange(len(pieces)), np.searchsorted(of, pieces[:, 0]), np.searchsorted(of, pieces[:, 0], side="right")):
        a, b = np.where(flat[i], 0, 1), np.where(flat[i], 1, 0)
        start, end, at = e[j, a], e[j, a + 2], middle[i, a]
        met = (start <= at) != (end <= at)
        i, j, a, b, start, end, at = (v[met] for v in (i, j, a, b, start, end, at))
        height = e[j, b] + (at - start) * (e[j, b + 2] - e[j, b]) / (end - start) - middle[i, b]
        near = np.abs(height) <= 3 * snap
        if not len(i):
            continue
        first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (polygon[j[1:]] != polygon[j[:-1]])]))
        beyond, on = (np.add.reduceat(v.astype(np.int64), first) for v in (~near & (height > 0), near))
        i, layer = i[first], layers[polygon[j[first]]]
        for side, odd in enumerate((beyond % 2 == 1, (beyond + on) % 2 == 1)):
            held[side, layer[odd], i[odd]] = True
    inside = [KINDS[kind](held[side, 0], held[side, 1]) for side in (0, 1)]
    # Beyond is above, on the left of a flat piece (which runs to the right); or right, on the right of a steep one that runs up.
    far_left = np.where(flat, True, step[:, 1] < 0)
    left, right = np.where(far_left, inside[0], inside[1]), np.where(far_left, inside[1], inside[0])
    return np.concatenate([pieces[left & ~right], pieces[right & ~left][:, [0, 3, 4, 1, 2]]])


def overlay(polygons: DataFrame, by: str, cell: float, kind: str = "union", snap: float = 1e-6) -> DataFrame:
    """(by, ring, i, x, y, x2, y2): sides of the rings around an overlay of each group, in order of ``i``; outer rings run anticlockwise, holes clockwise.

    ``polygons`` has by, id, xs, ys and, but for unions of one layer, layer (0 or 1): closed rings of any shape; rings of
    one id are one polygon by the even-odd rule (holes). ``kind``: see KINDS. Coordinates are multiples of ``snap``; corners
    and crossings nearer than a few of it are one. Rings that touch in a corner stay apart. Rings with
    fewer than three corners, null or non-finite coordinates are left out; a group without area has no rows.
    """
    kinds = dict(polygons.dtypes)
    layer = F.col("layer").cast("int") if "layer" in polygons.columns else F.lit(0)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    fine = (F.size("xs") > 3) & (F.size("xs") == F.size("ys")) & ~F.exists("xs", bad) & ~F.exists("ys", bad)
    rings = polygons.select(by, "id", layer.alias("layer"), F.col("xs").cast("array<double>").alias("xs"), F.col("ys").cast("array<double>").alias("ys")).where(fine)
    over = lambda c: F.explode(F.sequence(F.floor((F.array_min(c) - 4 * snap) / cell), F.floor((F.array_max(c) + 4 * snap) / cell)))
    dealt = rings.withColumn("cx", over("xs")).withColumn("cy", over("ys"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), _CELLS):
                group, cx, cy, held = (c.slice(at, _CELLS) for c in whole.columns)
                of = np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy())
                found = _boundary(held.flatten(), of, np.column_stack([cx.to_numpy(), cy.to_numpy()]), cell, snap, kind)
                yield pa.RecordBatch.from_arrays([group.take(pa.array(found[:, 0])), *(pa.array(found[:, k]) for k in range(1, 5))], [by, "x", "y", "x2", "y2"])

    held = dealt.groupBy(by, "cx", "cy").agg(F.collect_list(F.struct("id", "layer", "xs", "ys")).alias("held"))
    sides = held.mapInArrow(work, f"`{by}` {kinds[by]}, x long, y long, x2 long, y2 long")
    # Cells may see a piece of almost no length apart; the id is the piece itself.
    sides = written(sides.distinct().withColumn("id", F.xxhash64(by, "x", "y", "x2", "y2")))
    chain = written(_followed(sides, by))
    opened = chain.join(ranked(chain, by), "id")
    scale = lambda c: (F.col(c) * snap).alias(c)
    return opened.select(by, "ring", (-F.col("left")).alias("i"), *map(scale, ("x", "y", "x2", "y2")))


def _followed(sides: DataFrame, by: str) -> DataFrame:
    """Sides with the one that follows: around a corner, clockwise from the way back, the first that leaves it."""
    angle = lambda dx, dy: F.atan2(dy.cast("double"), dx.cast("double"))
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    leaving = sides.select(by, F.col("x").alias("vx"), F.col("y").alias("vy"), angle(dx, dy).alias("a"), F.lit(0).alias("comes"), "id")
    coming = sides.select(by, F.col("x2").alias("vx"), F.col("y2").alias("vy"), angle(-dx, -dy).alias("a"), F.lit(1).alias("comes"), "id")
    around = Window.partitionBy(by, "vx", "vy")
    leaves = F.when(F.col("comes") == 0, F.col("id"))
    before = F.last(leaves, ignorenulls=True).over(around.orderBy("a", "comes").rowsBetween(Window.unboundedPreceding, -1))
    last = F.max_by(F.when(F.col("comes") == 0, F.col("id")), F.when(F.col("comes") == 0, F.col("a"))).over(around)
    turns = leaving.unionByName(coming).withColumn("next", F.coalesce(before, last)).where((F.col("comes") == 1) & F.col("next").isNotNull())
    return sides.join(turns.select("id", "next"), "id")


def measured(sides: DataFrame, *by: str) -> DataFrame:
    """(by, ring, area, perimeter, corners) of rings; a hole has negative area."""
    cross = F.sum((F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2)
    return sides.groupBy(*by, "ring").agg(cross.alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("perimeter"), F.count("*").alias("corners"))


def as_rings(sides: DataFrame, by: str) -> DataFrame:
    """(by, ring, hole, xs, ys): closed rings as arrays; each must fit in a row."""
    corners = F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("c")
    area = F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))
    rings = sides.groupBy(by, "ring").agg(corners, area.alias("area"))
    closed = lambda a: F.concat(F.col(f"c.{a}"), F.array(F.get(f"c.{a}", F.lit(0))))
    return rings.select(by, "ring", (F.col("area") < 0).alias("hole"), closed("x").alias("xs"), closed("y").alias("ys"))


def buffers(polygons: DataFrame, key: str, reach: float, cell: float, quarter: int = 8, snap: float = 1e-6) -> DataFrame:
    """Sides, as ``overlay`` gives them, around each polygon (key, xs, ys; several rings with holes) and what is within ``reach`` of it.

    Arcs have ``quarter`` segments a quarter circle, corners on the circle. The union of a polygon and of its sides, each
    widened to a band with round ends; a negative ``reach`` takes the bands away instead.
    """
    kind = dict(polygons.dtypes)[key]
    turn = np.arange(4 * quarter) * (np.pi / 2 / quarter)
    disc = np.stack([np.cos(turn), np.sin(turn)], axis=1).round(15) * abs(reach)

    def bands(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for k, xs, ys in zip(pdf[key], pdf["xs"], pdf["ys"], strict=True):
                for a, b, c, d in zip(xs, ys, xs[1:], ys[1:], strict=False):
                    h = hull_of([(float(x), float(y)) for p in ((a, b), (c, d)) for x, y in disc + np.asarray(p, float)])
                    rows.append((k, f"{a!r} {b!r} {c!r} {d!r}", 1, [p[0] for p in h] + [h[0][0]], [p[1] for p in h] + [h[0][1]]))
            yield pd.DataFrame(rows, columns=[key, "id", "layer", "xs", "ys"])

    usable = polygons.select(key, F.col("xs").cast("array<double>").alias("xs"), F.col("ys").cast("array<double>").alias("ys")).where((F.size("xs") > 1) & (F.size("xs") == F.size("ys")) & ~F.exists("xs", lambda v: v.isNull()) & ~F.exists("ys", lambda v: v.isNull()))
    widened = usable.mapInPandas(bands, f"`{key}` {kind}, id string, layer int, xs array<double>, ys array<double>")
    whole = usable.select(key, F.lit("whole").alias("id"), F.lit(0).alias("layer"), "xs", "ys")
    return overlay(whole.unionByName(widened), key, cell, "union" if reach >= 0 else "difference", snap)
