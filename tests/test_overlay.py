"""Overlays and buffers of polygons against areas computed another way, and points against distances."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import scalar
from fieldgrid.operators import outlines, overlay

SCHEMA = "g int, id int, layer int, xs array<double>, ys array<double>"


def star(rng, x, y, r, n):
    """A ring of any direction about a place, and not always anticlockwise."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(x + r * rng.uniform(0.3, 1) * math.cos(t), y + r * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]
    ring = ring[:: rng.choice([1, -1])]
    return [p[0] for p in ring] + [ring[0][0]], [p[1] for p in ring] + [ring[0][1]]


def polygons(spark, seed, n):
    rng, rows = random.Random(seed), []
    for g in range(4):
        for i in range(n):
            rows.append((g, i, i % 2, *star(rng, rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(2, 6), rng.randint(3, 9))))
            if i % 3 == 0:  # a hole, or an island
                rows.append((g, i, i % 2, *star(rng, 5, 5, 1.5, 5)))
    return spark.createDataFrame(rows, SCHEMA)


def areas(df):
    return {r.g: r.a for r in overlay.measured(df, "g").groupBy("g").agg(F.sum("area").alias("a")).collect()}


@pytest.mark.parametrize("cell", [2.3, 50.0])
def test_areas_equal_those_of_coverage(spark, cell):
    many, two = polygons(spark, 1, 7), polygons(spark, 2, 2)
    want = {r.g: r for r in outlines.coverage(many, "g", 3.0).collect()}
    got = areas(overlay.overlay(many.drop("layer"), "g", cell))
    assert all(got[g] == pytest.approx(w.union_area, abs=1e-4) for g, w in want.items())
    want = {r.g: r for r in outlines.coverage(two, "g", 3.0).collect()}
    both, any_ = areas(overlay.overlay(two, "g", cell, "intersection")), areas(overlay.overlay(two, "g", cell, "union"))
    first, apart = areas(overlay.overlay(two, "g", cell, "difference")), areas(overlay.overlay(two, "g", cell, "symmetric_difference"))
    for g, w in want.items():
        assert both.get(g, 0) == pytest.approx(w.common_area, abs=1e-4) and any_[g] == pytest.approx(w.union_area, abs=1e-4)
        assert apart[g] == pytest.approx(w.union_area - w.common_area, abs=1e-4)
    one = {r.g: r.union_area for r in outlines.coverage(two.where("layer = 0"), "g", 3.0).collect()}
    assert all(first[g] == pytest.approx(one[g] - w.common_area, abs=1e-4) for g, w in want.items())


def test_rings_close_and_hold_what_polygons_hold(spark):
    df = polygons(spark, 3, 5)
    rings = overlay.as_rings(overlay.overlay(df, "g", 4.0), "g").collect()
    assert all(r.xs[0] == r.xs[-1] and r.ys[0] == r.ys[-1] and len(r.xs) > 3 for r in rings)
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(int(k % 4), int(k), float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-5, 15, (1500, 2)))], "g int, k int, x double, y double")
    inside = lambda p: points.join(p, "g").withColumn("in", scalar.in_ring(F.col("x"), F.col("y"), F.col("xs"), F.col("ys")).cast("int"))
    own = inside(df).groupBy("k", "id").agg((F.sum("in") % 2).alias("in")).groupBy("k").agg(F.max("in").alias("in"))
    of = inside(spark.createDataFrame([(r.g, r.xs, r.ys) for r in rings], "g int, xs array<double>, ys array<double>")).groupBy("k").agg((F.sum("in") % 2).alias("in"))
    assert dict(map(tuple, own.collect())) == dict(map(tuple, of.collect()))


def test_shared_sides_corners_and_holes(spark):
    box = lambda x, y, w, h: ([x, x + w, x + w, x, x], [y, y, y + h, y + h, y])
    rows = [(1, 1, 0, *box(0.0, 0.0, 1.0, 1.0)), (1, 2, 0, *box(1.0, 0.0, 1.0, 1.0)), (1, 3, 0, *box(2.0, 1.0, 1.0, 1.0))]  # side by side; one by a corner
    rows += [(2, k, 0, *b) for k, b in enumerate([box(0.0, 0.0, 3.0, 1.0), box(0.0, 2.0, 3.0, 1.0), box(0.0, 0.5, 1.0, 2.0), box(2.0, 0.5, 1.0, 2.0)])]  # a frame
    rows += [(3, 1, 0, *box(0.0, 0.0, 2.0, 2.0)), (3, 2, 0, *box(0.0, 0.0, 2.0, 2.0)), (4, 1, 0, [0.0, 1.0, 2.0, 0.0], [0.0, 0.0, 0.0, 0.0]), (4, 2, 0, [0.0, 1.0], [0.0, 1.0]), (4, 3, 0, [0.0, float("nan"), 1.0, 0.0], [0.0, 1.0, 1.0, 0.0]), (4, 4, 0, None, None)]
    got = overlay.measured(overlay.overlay(spark.createDataFrame(rows, SCHEMA), "g", 1.5), "g").collect()
    assert sorted((r.g, round(r.area, 6), round(r.perimeter, 6)) for r in got) == [(1, 1.0, 4.0), (1, 2.0, 6.0), (2, -1.0, 4.0), (2, 9.0, 12.0), (3, 4.0, 8.0)]
    assert overlay.overlay(spark.createDataFrame([], SCHEMA), "g", 1.0).count() == 0


@pytest.mark.parametrize("reach", [1.2, -0.4])
def test_buffers_hold_what_is_near(spark, reach):
    df = polygons(spark, 4, 1).select(F.col("g").alias("key"), "xs", "ys")
    rings = overlay.as_rings(overlay.buffers(df, "key", reach, 5.0, quarter=32), "key").select("key", F.col("xs").alias("bx"), F.col("ys").alias("by"))
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-8, 18, (300, 2)).tolist())], "k int, x double, y double")
    xy = (F.col("x"), F.col("y"))
    own = points.join(df.withColumn("one", F.lit(1)), F.col("one") == 1).groupBy("key", "k").agg(
        (F.sum(scalar.in_ring(*xy, F.col("xs"), F.col("ys")).cast("int")) % 2).alias("inside"), F.sqrt(F.min(scalar.squared_distance_to_ring(*xy, F.col("xs"), F.col("ys")))).alias("far"))
    held = points.withColumn("one", F.lit(1)).join(rings, F.col("one") == 1).groupBy("key", "k").agg((F.sum(scalar.in_ring(*xy, F.col("bx"), F.col("by")).cast("int")) % 2).alias("held"))
    n = 0
    for r in own.join(held, ["key", "k"], "left").collect():
        if abs(r.far - abs(reach)) > 0.002 * abs(reach):  # arcs are chords
            want = (r.inside or r.far < reach) if reach > 0 else (r.inside and r.far > -reach)
            assert bool(r.held) == bool(want), r
            n += bool(want)
    assert n > 5




@pytest.mark.parametrize("pairs", [50, 1 << 19])
def test_cells_arranged_together_equal_cells_alone(monkeypatch, pairs):
    """A call arranges many cells; polygons of one id in two cells stay apart, and parts of the pairs don't matter."""
    import pyarrow as pa

    monkeypatch.setattr(overlay, "_PAIRS", pairs)
    rng = np.random.default_rng(3)
    rings, of = [], []
    for cell in range(6):
        for i in range(cell % 4 + 1):
            p = rng.integers(0, 9, (3, 2)).astype(float)
            rings.append({"id": i, "layer": i % 2, "xs": [*p[:, 0], p[0, 0]], "ys": [*p[:, 1], p[0, 1]]})
            of.append(cell)
    of, corner = np.array(of), np.zeros((6, 2), np.int64)
    kind = pa.struct([("id", pa.int64()), ("layer", pa.int32()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64()))])
    some = lambda at: pa.array([rings[k] for k in at], kind)
    together = overlay._boundary(some(range(len(of))), of, corner, 9.0, 1e-6, "union")
    alone = [overlay._boundary(some(np.flatnonzero(of == c)), of[of == c], corner, 9.0, 1e-6, "union") for c in range(6)]
    ordered = lambda rows: sorted(map(tuple, rows.tolist()))
    assert ordered(together) == ordered(np.concatenate(alone)) and len(together) > 12
