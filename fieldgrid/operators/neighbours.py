"""The k nearest places of each cell, by a tree of boxes that Spark builds and descends level by level.

Stations are counted in square (cubic, or linear) boxes of ever smaller sides; a box with ``LEAF`` times k stations or fewer is a
leaf, so crowded places have small leaves and empty ones none. Each box has the tight bounds of its stations. Cells descend
the tree together: in each level a cell keeps the boxes that can hold one of its k nearest, judged by two bounds that hold
for certain: boxes, taken by their farthest corner, that have k stations between them; and k boxes by the farthest place of
their nearest face, where each has a station. Then a cell meets the stations of the leaves it has kept. So the pairs a cell
meets depend on k, not on how many stations there are, how they cluster, or how far away the cell is.

Many cells descend as groups: boxes of a tree of their own, with the bounds of a box in place of a cell's. A group's cells
meet the stations of its leaves in one task, and only pairs that may be among a cell's k nearest leave it, so what is
shuffled is a few rows a group and k a cell. Groups that meet too many stations (cells far sparser than stations, here or
there) descend as single cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import written

#: Times k stations that a leaf has at most.
LEAF = 2
#: Halvings of a box's sides from one level to the next, by the number of axes.
HALVINGS = {1: 4, 2: 2, 3: 2}
#: Levels that are counted in one pass over the stations.
STEP = 3
#: Boxes or stations that are broadcast at most; more of them meet the cells by a shuffle.
FEW = 200_000
#: Cells of a group, at most, and stations that a group may meet.
GROUP, MOST_MET = 512, 16_384
#: Cells that are worth grouping.
MANY = 4_096
#: Stations of a leaf that groups meet.
GROUP_LEAF = 32


def on_globe(lat: Column, lon: Column) -> list[Column]:
    """A place in degrees on the unit sphere; the distance along the surface grows with the straight one."""
    lat, lon = F.radians(lat), F.radians(lon)
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW else df


def _tree(stations: DataFrame, names: Sequence[str], halvings: int, deepest: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(boxes, stations with the level and code of their leaf). Stations have places ``names`` and integers _i0.."""
    axes = len(names)
    code = lambda up: reduce(add, (F.expr(f"shiftleft(shiftright(_i{a}, {halvings} * ({deepest} - _level + {up})), CAST({a * halvings} * (_level - {up}) AS INT))") for a in range(axes)))
    level, boxes, placed, todo = 0, None, None, stations
    while True:
        last = min(level + STEP, deepest)
        each = todo.withColumn("_level", F.explode(F.sequence(F.lit(level + 1), F.lit(last)))).withColumn("_code", code(0))
        sides = [f(c).alias(f"{n}{a}") for a, c in enumerate(names) for n, f in (("_a", F.min), ("_b", F.max))]
        found = each.withColumn("_parent", code(1)).groupBy("_level", "_code", "_parent").agg(F.count("*").alias("_n"), *sides)
        above = F.sum("_n").over(Window.partitionBy("_level", "_parent"))  # a parent has 64 boxes at most
        found = found.withColumn("_above", above).where((F.col("_above") > most) | (F.col("_level") == 1)).drop("_above")
        found = written(found.withColumn("_leaf", (F.col("_n") <= most) | (F.col("_level") == deepest)))
        leaves = found.where("_leaf").select("_level", "_code")
        here = each.join(_few(leaves, leaves.count()), ["_level", "_code"])
        boxes, placed = (found, here) if boxes is None else (boxes.unionByName(found), placed.unionByName(here))
        crowded = found.where((F.col("_level") == last) & ~F.col("_leaf")).select("_level", "_code")
        n = crowded.count()
        if not n:
            return boxes, written(placed)
        todo = written(each.join(_few(crowded, n), ["_level", "_code"], "left_semi").drop("_level", "_code"))
        level = last


def met(cells: DataFrame, stations: DataFrame, key: Sequence[str], at: Sequence[Column], station_at: Sequence[Column], tie: str, k: int, slack: float = 1e-6) -> DataFrame:
    """Pairs of cells and stations, among them the k nearest stations of each cell; see ``nearest``."""
    axes = len(at)
    names, places = [f"_s{a}" for a in range(axes)], [f"_x{a}" for a in range(axes)]
    placed = stations.withColumns(dict(zip(names, station_at, strict=True))).dropna(subset=names)
    # Of stations at one place only the first k by tie can be among the k nearest.
    order = F.row_number().over(Window.partitionBy(*names).orderBy(tie))
    placed = written(placed.withColumn("_r", order).where(F.col("_r") <= k).drop("_r"))
    here = cells.withColumns(dict(zip(places, at, strict=True))).dropna(subset=places)
    ends = _ends(placed, names)
    if not ends["n"]:
        return here.join(placed, F.lit(False))
    finite = reduce(lambda a, b: a & b, (F.abs(c) < float("inf") for c in places))
    cell_ends = _ends(here.where(finite), places)
    # Cells of a group cover about as many stations as a group has cells, so fewer cells make a group where stations are dense.
    most = min(GROUP, GROUP * cell_ends["n"] // ends["n"])
    grouped = most >= 8 and cell_ends["n"] > MANY
    boxes, placed = _boxes(placed, ends, names, max(LEAF * k, GROUP_LEAF) if grouped else LEAF * k)
    levels = {r["_level"]: r["count"] for r in boxes.groupBy("_level").count().collect()}  # one row a level
    if not grouped:
        return _met_alone(here, axes, boxes, placed, levels, key, k, slack)

    groups, own = _boxes(here.where(finite), cell_ends, places, most)
    groups = groups.where("_leaf").select(F.col("_level").alias("_gl"), F.col("_code").alias("_gc"), F.ceil(F.col("_n") / most).alias("_chunks"), *(((F.col(f"_a{a}") + F.col(f"_b{a}")) / 2).alias(f"_x{a}") for a in range(axes)), *(((F.col(f"_b{a}") - F.col(f"_a{a}")) / 2).alias(f"_w{a}") for a in range(axes)))
    front = _descended(groups, boxes, levels, ["_gl", "_gc"], k, slack)
    front = written(front.withColumn("_all", F.sum("_n").over(Window.partitionBy("_gl", "_gc"))))
    # Cells at one place, beyond the deepest box, are dealt to chunks of a group.
    own = own.drop(*(f"_i{a}" for a in range(axes))).withColumnsRenamed({"_level": "_gl", "_code": "_gc"})
    sizes = front.groupBy("_gl", "_gc").agg(F.max("_all").alias("_all"), F.max("_chunks").alias("_chunks"))
    own = own.join(_few(sizes, sizes.count()), ["_gl", "_gc"]).withColumn("_chunk", F.pmod(F.xxhash64(*key), F.col("_chunks")))
    fits = front.where(F.col("_all") <= MOST_MET)
    dealt = fits.select("_gl", "_gc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_chunk"), "_level", "_code")
    dealt = dealt.join(_few(placed, ends["n"]), ["_level", "_code"]).drop("_level", "_code")
    of = ["_gl", "_gc", "_chunk"]
    left, right = own.where(F.col("_all") <= MOST_MET).drop("_all", "_chunks"), dealt.drop(*(f"_i{a}" for a in range(axes)))
    schema = here.join(placed.drop("_level", "_code", *(f"_i{a}" for a in range(axes))), F.lit(False)).schema

    mine, theirs = here.columns, [c for c in right.columns if c not in of]

    def pairs(one: pa.Table, other: pa.Table) -> pa.Table:
        x, y = (np.stack([t[c].to_numpy() for c in cs], axis=1) for t, cs in ((one, places), (other, names)))
        i, j = _near(x, y, k, slack)
        chosen = [*(one[c].take(pa.array(i)) for c in mine), *(other[c].take(pa.array(j)) for c in theirs)]
        return pa.table(chosen, names=mine + theirs)

    found = left.groupBy(*of).cogroup(right.groupBy(*of)).applyInArrow(pairs, schema)
    alone = own.where(F.col("_all") > MOST_MET).select(*here.columns).unionByName(here.where(~finite))
    if alone.isEmpty():
        return found
    rest = _met_alone(alone, axes, boxes, placed, levels, key, k, slack)
    return found.unionByName(rest.select(*found.columns))


def _ends(df: DataFrame, names: Sequence[str]) -> Row:
    return df.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max))).first()


def _boxes(df: DataFrame, ends: Row, names: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """``_tree`` of rows by the places ``names``, in boxes of the side of all."""
    axes = len(names)
    halvings = HALVINGS.get(axes, 1)
    deepest = min(26, 62 // axes) // halvings
    bits = deepest * halvings
    span = max(ends[f"max_{c}"] - ends[f"min_{c}"] for c in names) or 1.0
    whole = lambda c: F.least(F.floor((F.col(c) - ends[f"min_{c}"]) / span * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
    return _tree(df.withColumns({f"_i{a}": whole(c) for a, c in enumerate(names)}), names, halvings, deepest, most)


def _met_alone(here: DataFrame, axes: int, boxes: DataFrame, placed: DataFrame, levels: dict[int, int], key: Sequence[str], k: int, slack: float) -> DataFrame:
    """Cells (_x0..) with the stations of the leaves that each of them has kept."""
    front = _descended(here.withColumns({f"_w{a}": F.lit(0.0) for a in range(axes)}), boxes, levels, key, k, slack)
    return front.select(*here.columns, "_level", "_code").join(_few(placed, placed.count()), ["_level", "_code"]).drop("_level", "_code", *(f"_i{a}" for a in range(axes)))


def _descended(units: DataFrame, boxes: DataFrame, levels: dict[int, int], key: Sequence[str], k: int, slack: float) -> DataFrame:
    """Units (boxes of cells with the middle _x0.. and half sides _w0..) with the leaves (_level, _code, _n) that may hold one of a cell's k nearest."""
    axes = sum(f"_w{a}" in units.columns for a in range(len(units.columns)))
    front = units.select("*", F.lit(0).cast("long").alias("_code"), F.lit(0).alias("_level"), F.lit(False).alias("_leaf"), *(F.lit(None).cast(t).alias(c) for c, t in (("_n", "long"), ("_lo", "double"), ("_one", "double"), ("_hi", "double"))))
    for level in sorted(levels):
        sides = [f for a in range(axes) for f in (((F.col(f"_a{a}") + F.col(f"_b{a}")) / 2).alias(f"_m{a}"), ((F.col(f"_b{a}") - F.col(f"_a{a}")) / 2).alias(f"_h{a}"))]
        kids = boxes.where(F.col("_level") == level).select(F.col("_parent").alias("_open"), *(F.col(c).alias(f"_k{c}") for c in ("_code", "_leaf", "_n")), *sides)
        both = front.withColumn("_open", F.when(~F.col("_leaf"), F.col("_code"))).join(_few(kids, levels[level]), "_open", "left")
        both = both.withColumns({f"_d{a}": F.abs(F.col(f"_x{a}") - F.col(f"_m{a}")) for a in range(axes)})
        sides_of = [(F.col(f"_d{a}"), F.col(f"_h{a}"), F.col(f"_w{a}")) for a in range(axes)]  # from the middle, and half a side of both
        hi = reduce(add, ((d + h + w) * (d + h + w) for d, h, w in sides_of))
        lo = reduce(add, (F.pow(F.greatest(d - h - w, F.lit(0.0)), 2) for d, h, w in sides_of))
        faces = [4 * F.least(d, h) * (F.greatest(d, h) + w) for d, h, w in sides_of]  # what the nearer of two faces takes off
        one = hi - (F.greatest(*faces) if axes > 1 else faces[0])
        to = {"_code": F.col("_k_code"), "_leaf": F.col("_k_leaf"), "_n": F.col("_k_n"), "_level": F.lit(level), "_lo": F.sqrt(lo), "_one": F.sqrt(F.greatest(one, F.lit(0.0))), "_hi": F.sqrt(hi)}
        moved = F.col("_k_code").isNotNull()
        front = both.select(*units.columns, *(F.when(moved, c).otherwise(F.col(n)).alias(n) for n, c in to.items()))
        front = _within(front, key, k, slack)
    return front


def _near(x: np.ndarray, y: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and of ``y`` that may be among its k nearest, by distances as ``_within`` bounds them."""
    if not len(x) or not len(y):
        return np.empty(0, int), np.empty(0, int)
    out, step = [], max(1, (1 << 19) // len(y))
    for at in range(0, len(x), step):
        d = sum((x[at : at + step, a, None] - y[None, :, a]) ** 2 for a in range(x.shape[1]))
        bound = np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1]) if k <= len(y) else np.full(len(d), np.inf)
        i, j = np.nonzero(d <= ((bound * (1 + 1e-12) + slack) ** 2 * (1 + 1e-12))[:, None])
        out.append((i + at, j))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _within(front: DataFrame, key: Sequence[str], k: int, slack: float) -> DataFrame:
    """The boxes of each cell or group that may hold one of its k nearest stations."""
    by = Window.partitionBy(*key)
    so_far = F.sum("_n").over(by.orderBy("_hi", "_level", "_code").rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(by.orderBy("_one", "_level", "_code"))
    ranked = front.select("*", so_far.alias("_sum"), place.alias("_place"))
    bound = F.least(F.min(F.when(F.col("_sum") >= k, F.col("_hi"))).over(by), F.min(F.when(F.col("_place") >= k, F.col("_one"))).over(by))
    bounded = ranked.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("_lo") <= F.col("_bound") * (1 + 1e-12) + slack))
    return bounded.drop("_sum", "_place", "_bound")


def nearest(cells: DataFrame, stations: DataFrame, key: Sequence[str], at: Sequence[Column], station_at: Sequence[Column], distance: Column, tie: str, k: int, slack: float = 1e-6, decimals: int | None = 6) -> DataFrame:
    """Each cell with its k nearest stations (fewer if there are fewer), ``distance`` and rank ``r`` from 1; ties by ``tie``.

    ``at`` and ``station_at`` are places on the same axes; ``distance`` grows with their straight distance (any number of
    axes). It is compared at ``decimals`` (None: as it is); ``slack`` is what these can hide of the straight distance. ``key`` tells cells
    apart. Cells and stations without a place have no part; an empty side gives no rows.
    """
    found = met(cells, stations, key, at, station_at, tie, k, slack).withColumn("distance", distance)
    compared = F.col("distance") if decimals is None else F.round("distance", decimals)
    first = F.row_number().over(Window.partitionBy(*key).orderBy(compared, tie))
    ranked = found.withColumn("r", first).where(F.col("r") <= k)
    return ranked.select(*(c for c in ranked.columns if not (c.startswith("_") and c not in cells.columns and c not in stations.columns)))
