"""Nearest places against brute force, and how many pairs a cell meets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import scalar
from fieldgrid.operators import neighbours


def frames(spark, cells, stations):
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(cells)], "c long, x double, y double")
    b = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(stations)], "s long, u double, v double")
    return a, b


def places(kind, n, rng):
    if kind == "uniform":
        return rng.uniform(0, 1000, (n, 2))
    if kind == "lattice":  # many at one place, many as far as others
        return rng.integers(0, 12, (n, 2)).astype(float)
    return np.concatenate([rng.normal(c, 10.0**-e, (n // 5 + 1, 2)) for e, c in enumerate([(0, 0), (500, 3), (500, 900), (10, 10), (999, 1)])])[:n]


CELLS = lambda rng: np.concatenate([rng.uniform(0, 1000, (60, 2)), rng.uniform(-3000, 4000, (40, 2)), rng.normal((500, 3), 0.1, (20, 2)), rng.integers(0, 12, (30, 2)), [(1e7, 0), (500, -1e5)]])


@pytest.mark.parametrize("kind", ["uniform", "lattice", "clusters"])
@pytest.mark.parametrize("n,k", [(700, 5), (3, 5), (1, 1)])
def test_equals_brute_force(spark, kind, n, k):
    rng = np.random.default_rng(n + k)
    cells, stations = CELLS(rng), places(kind, n, rng)
    a, b = frames(spark, cells, stations)
    d = F.sqrt(F.pow(F.col("x") - F.col("u"), 2) + F.pow(F.col("y") - F.col("v"), 2))
    got = {(r.c, r.r): r.s for r in neighbours.nearest(a, b, ["c"], [F.col("x"), F.col("y")], [F.col("u"), F.col("v")], d, "s", k).collect()}
    want = {}
    for c, at in enumerate(cells):
        apart = np.round(np.sqrt(((stations - at) ** 2).sum(1)), 6)
        want |= {(c, r + 1): int(s) for r, s in enumerate(np.lexsort((np.arange(n), apart))[:k])}
    assert got == want


def test_globe_over_poles_and_date_line(spark):
    rng = np.random.default_rng(2)
    globe = lambda n: np.stack([np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)], 1)
    cells, stations = np.concatenate([globe(80), [(90, 0), (-90, 7), (3, 180), (3, -180)]]), globe(900)
    a, b = frames(spark, cells, stations)
    d = scalar.haversine_km(F.col("x"), F.col("y"), F.col("u"), F.col("v"))
    near = neighbours.nearest(a, b, ["c"], neighbours.on_globe(F.col("x"), F.col("y")), neighbours.on_globe(F.col("u"), F.col("v")), d, "s", 4, slack=1e-9)
    got = {(r.c, r.r): r.s for r in near.collect()}
    rad = np.radians(stations)
    for c, (lat, lon) in enumerate(np.radians(cells)):
        h = np.sin((rad[:, 0] - lat) / 2) ** 2 + np.cos(lat) * np.cos(rad[:, 0]) * np.sin((rad[:, 1] - lon) / 2) ** 2
        assert [got[c, r] for r in range(1, 5)] == np.argsort(h, kind="stable")[:4].tolist()
    assert got[82, 1] == got[83, 1]


@pytest.mark.parametrize("kind", ["uniform", "clusters"])
def test_pairs_met_stay_flat(spark, kind):
    """From a thousand to a hundred thousand stations, with cells far outside their range."""
    most = {}
    for n in (1_000, 100_000):
        rng = np.random.default_rng(5)
        a, _ = frames(spark, CELLS(rng), [(0, 0)])
        stations = spark.createDataFrame(__import__("pandas").DataFrame(places(kind, n, rng), columns=["u", "v"]).reset_index(names="s"))
        pairs = neighbours.met(a, stations, ["c"], [F.col("x"), F.col("y")], [F.col("u"), F.col("v")], "s", 5).groupBy("c").count().collect()
        assert len(pairs) == 152
        most[n] = np.mean([r["count"] for r in pairs])
        assert max(r["count"] for r in pairs) < 40 * 5
    assert most[100_000] < 1.5 * most[1_000] and most[100_000] < 15 * 5


def test_no_place_and_no_rows(spark):
    a, b = frames(spark, [(0, 0), (float("nan"), 1)], [(1, 1), (2, 2)])
    a = a.withColumn("x", F.nullif(F.col("x"), F.lit(float("nan"))))
    b = b.unionByName(spark.createDataFrame([(9, None, 1.0)], b.schema))
    ask = lambda p, q: sorted((r.c, r.s, r.r) for r in neighbours.nearest(p, q, ["c"], [F.col("x"), F.col("y")], [F.col("u"), F.col("v")], F.abs(F.col("x") - F.col("u")), "s", 2).collect())
    assert ask(a, b) == [(0, 0, 1), (0, 1, 2)]
    assert ask(a.limit(0), b) == [] and ask(a, b.limit(0)) == []


def test_distances_as_they_are(spark):
    """Stations that only digits beyond the sixth tell apart: not a tie, unless asked for."""
    a, b = frames(spark, [(0, 0)], [(1 + 1e-9, 0), (1, 0), (1 + 2e-9, 0)])
    ask = lambda **how: [r.s for r in neighbours.nearest(a, b, ["c"], [F.col("x")], [F.col("u")], F.abs(F.col("x") - F.col("u")), "s", 3, **how).orderBy("r").collect()]
    assert ask(decimals=None) == [1, 0, 2] and ask() == [0, 1, 2]


@pytest.mark.parametrize("kind,met_at_most", [("lattice", 16_384), ("clusters", 60)])
def test_groups_equal_brute_force(spark, monkeypatch, kind, met_at_most):
    """Cells that descend as groups: many at one place, infinite ones, and groups that meet too many stations; a cell leaves its task with few pairs."""
    for name, n in (("MANY", 0), ("GROUP", 16), ("MOST_MET", met_at_most)):
        monkeypatch.setattr(neighbours, name, n)
    rng, k = np.random.default_rng(9), 3
    cells, stations = np.concatenate([CELLS(rng), np.full((50, 2), 7.0), rng.uniform(0, 1000, (60, 2))]), places(kind, 250, rng)
    a, b = frames(spark, cells, stations)
    a = a.unionByName(spark.createDataFrame([(-1, float("inf"), 0.0)], a.schema)).withColumn("note", F.when(F.col("c") % 2 == 0, F.lit("even")))
    at = [F.col("x"), F.col("y")], [F.col("u"), F.col("v")]
    d = F.sqrt(F.pow(F.col("x") - F.col("u"), 2) + F.pow(F.col("y") - F.col("v"), 2))
    rows = neighbours.nearest(a, b, ["c"], *at, d, "s", k).collect()
    got = {(r.c, r.r): r.s for r in rows}
    want = {(-1, r): r - 1 for r in (1, 2, 3)}
    for c, place in enumerate(cells):
        apart = np.round(np.sqrt(((stations - place) ** 2).sum(1)), 6)
        want |= {(c, r + 1): int(s) for r, s in enumerate(np.lexsort((np.arange(250), apart))[:k])}
    assert got == want and all(r.note == (None if r.c % 2 else "even") for r in rows)
    if kind == "lattice":
        pairs = neighbours.met(a.where("c BETWEEN 182 AND 231"), b, ["c"], *at, "s", k)
        assert pairs.groupBy("c").count().agg(F.max("count")).first()[0] <= 4 * k
