"""Outlines of regions as rings, and areas that the polygons of a group cover together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .groups import gathered, pairs_of, runs_within, whole_groups
from .tables import written

#: Links of a group whose rings are closed in one task, at most.
SMALL = 512
#: Pixels of a region that is traced in a task together with others, at most, and what a row counts in the sides' numbers.
PIXELS, WIDTH = 4096, 1 << 29
#: Sides of a cell that is covered together with others, at most, and pairs of sides that are held at a time.
SIDES, PAIRS = 64, 1 << 20
#: A pixel's sides in turn, clockwise on the screen: the neighbour beyond, and where the side starts and ends.
_SIDES = [((-1, 0), (0, 0), (1, 0)), ((0, 1), (1, 0), (1, 1)), ((1, 0), (1, 1), (0, 1)), ((0, -1), (0, 1), (0, 0))]


def sides(labelled: DataFrame) -> DataFrame:
    """(id, component, dir, x, y, x2, y2) of the pixel sides between each component and what is not of it.

    The component is on the right hand. ``labelled`` has row, col and component; absent pixels are outside.
    """
    p = labelled.select("component", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    out = None
    for k, ((dr, dc), (x, y), (x2, y2)) in enumerate(_SIDES):
        beyond = p.select("component", (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"))
        side = p.join(beyond, ["component", "row", "col"], "left_anti").select(
            ((F.col("row") * WIDTH + F.col("col")) * 4 + k).alias("id"), "component", F.lit(k).alias("dir"),
            (F.col("col") + x).alias("x"), (F.col("row") + y).alias("y"), (F.col("col") + x2).alias("x2"), (F.col("row") + y2).alias("y2"),
        )
        out = side if out is None else out.unionByName(side)
    return out


def outlines(labelled: DataFrame, eight: bool = False) -> DataFrame:
    """(component, ring, i, x, y): corners of the rings around each component, in order of ``i``; outer rings have positive area.

    Coordinates are pixel corners, y downwards. Where four sides meet, regions of four neighbours keep to their pixel
    and regions of eight cross to the diagonal one. Small regions are traced in tasks, many at a time; rings of larger ones are
    found and ranked by a number of joins logarithmic in the longest ring, and no task holds one.
    """
    p = labelled.select("component", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).dropna()
    p = written(p)
    large = written(p.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > PIXELS).select("component"))
    kind = dict(p.dtypes)["component"]
    trace = lambda q: gathered(q, "component").mapInArrow(lambda batches: _traced(batches, eight), f"component {kind}, ring long, i long, x long, y long")
    if large.isEmpty():
        return trace(p)
    return trace(p.join(large, "component", "left_anti")).unionByName(_joined_rings(p.join(large, "component", "left_semi"), eight))


def _joined_rings(labelled: DataFrame, eight: bool) -> DataFrame:
    """``outlines`` by joins, for regions of any size."""
    s = written(sides(labelled))
    after = s.select("component", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("id").alias("next"), F.col("dir").alias("next_dir"))
    turn = F.pmod(F.col("next_dir") - F.col("dir") + F.lit(1), F.lit(4))  # left 0, straight 1, right 2
    first = F.min(F.struct((turn if eight else -turn).alias("turn"), "next", "next_dir")).alias("n")
    chain = written(s.join(after, ["component", "x2", "y2"]).groupBy("component", "id", "dir", "x2", "y2").agg(first).select("component", "id", "dir", "x2", "y2", "n.next", "n.next_dir"))

    opened = chain.join(ranked(chain, "component"), "id")
    corners = opened.where(F.col("dir") != F.col("next_dir"))
    return corners.select("component", "ring", (-F.col("left")).alias("i"), F.col("x2").alias("x"), F.col("y2").alias("y"))


def _traced(batches: Iterator[pa.RecordBatch], eight: bool) -> Iterator[pa.RecordBatch]:
    """``outlines`` of whole regions, a batch's side by side. Places are numbered by the ranks of their region, row and column."""
    for batch, starts in whole_groups(batches, 1):
        sizes = np.diff(starts, append=batch.num_rows)
        group = np.repeat(np.arange(len(starts)), sizes)
        row, col = (batch.column(k).to_numpy() for k in (1, 2))
        rows, cols = (np.unique(np.concatenate([c - 1, c, c + 1])) for c in (row, col))
        place = lambda g, r, c: (g * len(rows) + np.searchsorted(rows, r)) * len(cols) + np.searchsorted(cols, c)
        pixels, once = np.unique(place(group, row, col), return_index=True)
        group, row, col = group[once], row[once], col[once]
        found = []
        for k, ((dr, dc), (x, y), (x2, y2)) in enumerate(_SIDES):
            beyond = place(group, row + dr, col + dc)
            open_ = pixels[np.minimum(np.searchsorted(pixels, beyond), len(pixels) - 1)] != beyond
            g, r, c = group[open_], row[open_], col[open_]
            found.append((((r * WIDTH + c) * 4 + k), np.full(len(g), k), place(g, r + y, c + x), place(g, r + y2, c + x2), g, c + x2, r + y2))
        ids, way, start, end, group, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        at = np.searchsorted(start[order], end)
        one, two = order[at], order[np.minimum(at + 1, len(order) - 1)]  # two sides start where pixels touch at a corner
        turn = lambda to: ((way[to] - way + 1) % 4) * (1 if eight else -1)  # left 0, straight 1, right 2
        after = np.where((start[two] == end) & (two != one) & (turn(two) < turn(one)), two, one)
        ring, left = _ranks(ids, after, int(np.bincount(group).max()))
        corner = np.flatnonzero(way != way[after])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts[group[corner]])), *(pa.array(c[corner]) for c in (ring, -left, x, y))], ["component", "ring", "i", "x", "y"])


def _ranks(ids: np.ndarray, after: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The least id of each link's ring, and the links to go until that; ``after`` are places of the next links, pointers are doubled."""
    ring, to = np.minimum(ids, ids[after]), after
    for _ in range(longest.bit_length()):
        ring, to = np.minimum(ring, ring[to]), to[to]
    closes = ids[after] == ring
    left, to = np.where(closes, 0, 1), np.where(closes, np.arange(len(ids)), after)
    for _ in range(longest.bit_length()):
        left, to = left + left[to], to[to]
    return ring, left


def ranked(chain: DataFrame, by: str) -> DataFrame:
    """(id, ring, left) of the links (by, id, next) of closed rings: the least id of a link's ring, and the links to go until that.

    A ring lies in one group. Groups of few links are closed many at a time in a task, without a join; those of larger groups by joins.
    """
    sized = written(chain.select(by, "id", "next").withColumn("_n", F.count("*").over(Window.partitionBy(by))))
    small = sized.where(F.col("_n") <= SMALL).groupBy(by).agg(F.collect_list(F.struct("id", "next")).alias("links")).select("links")
    closed = small.mapInArrow(_closed, "id long, ring long, left long")
    large = sized.where(F.col("_n") > SMALL)
    return closed if large.isEmpty() else closed.unionByName(_doubled(large))


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pointers of a batch's rings, doubled side by side."""
    for batch in batches:
        links = batch.column(0).flatten()
        ids, after = (links.field(k).to_numpy() for k in range(2))
        order = np.argsort(ids)
        first = order[np.minimum(np.searchsorted(ids, after, sorter=order), len(ids) - 1)]
        whole, ring, to = ids[first] == after, np.minimum(ids, after), first
        for _ in range(SMALL.bit_length()):
            whole, ring, to = whole & whole[to], np.minimum(ring, ring[to]), to[to]
        closes = after == ring
        left, to = np.where(closes, 0, 1), np.where(closes, np.arange(len(ids)), first)
        for _ in range(SMALL.bit_length()):
            left, to = left + left[to], to[to]
        yield pa.RecordBatch.from_arrays([pa.array(c[whole]) for c in (ids, ring, left)], ["id", "ring", "left"])


def _doubled(chain: DataFrame) -> DataFrame:
    """``ranked`` by doubling pointers: a number of joins logarithmic in the longest ring."""
    at, before = chain.select("id", F.col("next").alias("to"), F.least("id", "next").alias("ring")), None
    while True:
        at = written(at)
        state = at.agg(F.sum(F.xxhash64("id", "ring").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        there = at.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("ring").alias("_ring"))
        at = at.join(there, "to").select("id", F.col("_to").alias("to"), F.least("ring", "_ring").alias("ring"))
    # Its rank: links to go until the ring closes.
    opened, closes = chain.select("id", "next").join(at.select("id", "ring"), "id"), F.col("next") == F.col("ring")
    go = opened.select("id", "ring", F.when(~closes, F.col("next")).alias("to"), F.when(closes, 0).otherwise(1).cast("long").alias("left"))
    while True:
        go = written(go)
        if go.where(F.col("to").isNotNull()).isEmpty():
            return go.select("id", "ring", "left")
        there = go.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("left").alias("_left"))
        go = go.join(there, "to", "left").select("id", "ring", F.col("_to").alias("to"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left"))


def measured(corners: DataFrame, *by: str) -> DataFrame:
    """(by, component, ring, area, perimeter) of rings given by their corners; a ring around a hole has negative area."""
    ring = F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("c")
    rings = corners.groupBy(*by, "component", "ring").agg(ring)
    ends = F.transform("c", lambda a, i: F.struct(a["x"].alias("x"), a["y"].alias("y"), F.get("c", F.pmod(i + 1, F.size("c"))).alias("n")))
    area = F.aggregate(ends, F.lit(0.0), lambda s, e: s + (e["x"] * e["n"]["y"] - e["n"]["x"] * e["y"]) / 2)
    length = F.aggregate(ends, F.lit(0).cast("long"), lambda s, e: s + F.abs(e["x"] - e["n"]["x"]) + F.abs(e["y"] - e["n"]["y"]))
    return rings.select(*by, "component", "ring", area.alias("area"), length.alias("perimeter"))


def _cell_cover(e: np.ndarray, x0: float, y0: float, size: float, n: int) -> tuple[float, float]:
    """Areas of a square cell that one polygon or more, and all ``n``, cover. ``e``: sides (x, y, x2, y2, polygon) from left to right.

    The cell is cut into slabs at all vertices and crossings; within a slab no sides cross, so the middle line of each
    polygon's intervals has the slab's mean length.
    """
    x1, y1 = x0 + size, y0 + size
    e = e[np.argsort(e[:, 0], kind="stable")]
    ax, ay, bx = e[:, 0], e[:, 1], e[:, 2]
    rise = (e[:, 3] - ay) / (bx - ax)
    cuts = [np.array([x0, x1]), ax, bx]
    with np.errstate(divide="ignore", invalid="ignore"):
        cuts += [ax + (y - ay) / rise for y in (y0, y1)]
        for i, stop in enumerate(np.searchsorted(ax, bx, side="left").tolist()):  # sides that start before this one ends
            j = slice(i + 1, stop)
            x = (ay[j] - rise[j] * ax[j] - ay[i] + rise[i] * ax[i]) / (rise[i] - rise[j])
            cuts.append(x[(x > ax[j]) & (x < np.minimum(bx[i], bx[j]))])
    cuts = np.concatenate(cuts)
    cuts = np.unique(cuts[(cuts >= x0) & (cuts <= x1)])
    some = every = 0.0
    for a, b in zip(cuts, cuts[1:], strict=False):
        mid = (a + b) / 2
        on = (ax < mid) & (bx > mid)
        y = ay[on] + rise[on] * (mid - ax[on])
        order = np.lexsort((y, e[on, 4]))
        ends = np.clip(y[order], y0, y1)  # of each polygon in turn: enter, leave, ...
        at = np.argsort(ends, kind="stable")
        depth = np.cumsum(np.where(at % 2 == 0, 1, -1))[:-1]
        gaps = np.diff(ends[at])
        some += (b - a) * gaps[depth > 0].sum()
        every += (b - a) * gaps[depth >= n].sum()
    return float(some), float(every)


def _cells_cover(e: np.ndarray, sides: np.ndarray, x0: np.ndarray, y0: np.ndarray, size: float, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_cell_cover`` of many cells side by side: ``e`` has ``sides`` rows of each cell in turn."""
    cell, (ax, ay, bx, by, polygon) = np.repeat(np.arange(len(sides)), sides), e.T
    x1, y1, rise = x0 + size, y0 + size, (by - ay) / (bx - ax)
    first = np.cumsum(sides) - sides
    i, k = pairs_of((first + sides)[cell] - np.arange(len(e)) - 1)
    j = i + 1 + k
    met = np.maximum(ax[i], ax[j]) < np.minimum(bx[i], bx[j])
    i, j = i[met], j[met]
    with np.errstate(divide="ignore", invalid="ignore"):
        level = [ax + (y[cell] - ay) / rise for y in (y0, y1)]
        cross = (ay[j] - rise[j] * ax[j] - ay[i] + rise[i] * ax[i]) / (rise[i] - rise[j])
        met = (cross > np.maximum(ax[i], ax[j])) & (cross < np.minimum(bx[i], bx[j]))
        cuts, own = np.concatenate([x0, x1, ax, bx, *level, cross[met]]), np.concatenate([np.arange(len(sides))] * 2 + [cell] * 4 + [cell[i[met]]])
        held = (cuts >= x0[own]) & (cuts <= x1[own])
    cuts, own = cuts[held], own[held]
    order = np.lexsort((cuts, own))
    cuts, own = cuts[order], own[order]
    slab = np.flatnonzero((own[1:] == own[:-1]) & (cuts[1:] > cuts[:-1]))
    left, wide, own = cuts[slab], cuts[slab + 1] - cuts[slab], own[slab]
    some, every = np.zeros(len(sides)), np.zeros(len(sides))
    for run in runs_within(sides[own], PAIRS):
        c, w, mid = own[run], wide[run], (left[run] + (left[run] + wide[run])) / 2
        s, k = pairs_of(sides[c])
        k += first[c][s]
        on = (ax[k] < mid[s]) & (bx[k] > mid[s])
        s, k = s[on], k[on]
        y = ay[k] + rise[k] * (mid[s] - ax[k])
        order = np.lexsort((y, polygon[k], s))
        s, y = s[order], np.clip(y[order], y0[c][s[order]], y1[c][s[order]])
        before = np.searchsorted(s, s)
        step = np.where((np.arange(len(s)) - before) % 2 == 0, 1, -1)  # of each polygon in turn: enter, leave, ...
        order = np.lexsort((y, s))
        y, depth = y[order], np.cumsum(step[order])
        depth -= np.concatenate([[0], depth])[before]
        last = np.flatnonzero(s[1:] == s[:-1])
        part = w[s[last]] * (y[last + 1] - y[last])
        for out, enough in ((some, depth[last] > 0), (every, depth[last] >= n[c][s[last]])):
            out += np.bincount(c[s[last]], part * enough, len(sides))
    return some, every


def _covers(batches: Iterator[pa.RecordBatch], cell: float) -> Iterator[pa.RecordBatch]:
    """(by, m, some, every) of each cell's polygons: how many, and the areas that any and all of them cover there."""
    for batch, starts in whole_groups(batches, 3):
        by, cx, cy, ids, xs, ys = batch.columns
        sizes = np.diff(starts, append=batch.num_rows)
        group, code = np.repeat(np.arange(len(starts)), sizes), ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        own = np.unique(group * (code.max() + 1) + code)
        m = np.bincount(own // (code.max() + 1), minlength=len(starts))
        ring = np.repeat(np.arange(batch.num_rows), pc.list_value_length(xs).to_numpy(zero_copy_only=False))
        x, y = (c.flatten().to_numpy(zero_copy_only=False) for c in (xs, ys))
        a = np.flatnonzero(ring[1:] == ring[:-1])
        a, b = np.where(x[a] > x[a + 1], a + 1, a), np.where(x[a] > x[a + 1], a, a + 1)
        x0, y0 = (c.to_numpy(zero_copy_only=False)[starts] * cell for c in (cx, cy))
        of = group[ring[a]]
        met = (x[a] < x[b]) & (x[b] > x0[of]) & (x[a] < x0[of] + cell)
        a, b, of = a[met], b[met], of[met]
        e = np.stack([x[a], y[a], x[b], y[b], code[ring[a]]], axis=1)
        sides = np.bincount(of, minlength=len(starts))
        first, some, every = np.cumsum(sides) - sides, np.zeros(len(starts)), np.zeros(len(starts))
        few = np.flatnonzero((sides > 0) & (sides <= SIDES))
        for run in runs_within(sides[few] ** 2, PAIRS):
            g = few[run]
            i, k = pairs_of(sides[g])
            some[g], every[g] = _cells_cover(e[first[g][i] + k], sides[g], x0[g], y0[g], cell, m[g])
        for g in np.flatnonzero(sides > SIDES):
            some[g], every[g] = _cell_cover(e[first[g] : first[g] + sides[g]], x0[g], y0[g], cell, m[g])
        yield pa.RecordBatch.from_arrays([by.take(pa.array(starts)), pa.array(m), pa.array(some), pa.array(every)], ["by", "m", "some", "every"])


def coverage(polygons: DataFrame, by: str, cell: float) -> DataFrame:
    """(by, n, union_area, common_area): areas that any polygon, and that all polygons, of a group cover.

    ``polygons`` has by, id, xs, ys: closed rings of any shape; rings of one id are one polygon by the even-odd rule
    (holes). Rings are dealt to square cells that their boxes meet, so a large group is many tasks; a cell's share is
    computed on its own, those of few sides many at a time. Rings with fewer than three corners, null or non-finite coordinates are left out.
    """
    kind = dict(polygons.dtypes)[by]
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    fine = (F.size("xs") > 3) & (F.size("xs") == F.size("ys")) & ~F.exists("xs", bad) & ~F.exists("ys", bad) & F.col(by).isNotNull()
    rings = polygons.select(by, "id", F.col("xs").cast("array<double>").alias("xs"), F.col("ys").cast("array<double>").alias("ys")).where(fine)
    n = rings.select(by, "id").distinct().groupBy(by).agg(F.count("*").alias("n"))
    over = lambda c: F.explode(F.sequence(F.floor(F.array_min(c) / cell), F.floor(F.array_max(c) / cell)))
    dealt = gathered(rings.withColumn("cx", over("xs")).withColumn("cy", over("ys")), by, "cx", "cy")
    cells = dealt.mapInArrow(lambda batches: _covers(batches, cell), f"`{by}` {kind}, m long, some double, every double")
    # Where all polygons of a group cover a place, its cell holds all of them.
    common = F.sum(F.when(F.col("m") == F.col("n"), F.col("every")).otherwise(0.0))
    return cells.join(n, by).groupBy(by).agg(F.max("n").alias("n"), F.sum("some").alias("union_area"), common.alias("common_area"))
