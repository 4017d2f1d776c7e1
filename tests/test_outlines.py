"""Outlines, coverage, patches and scale extrema on hand-checked and brute-force cases."""

import math

import numpy as np
import pytest

from fieldgrid.operators import outlines as O
from fieldgrid.operators import patches as P


def rings_of(spark, cells, eight=False):
    df = spark.createDataFrame([(r, c, 0) for r, c in cells], "row int, col int, component long")
    out = {}
    for x in sorted(O.outlines(df, eight).collect(), key=lambda x: x["i"]):
        out.setdefault(x["ring"], []).append((x["x"], x["y"]))
    return sorted(out.values(), key=len)


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def test_a_ring_with_a_hole(spark):
    rings = rings_of(spark, [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)])
    assert sorted(area(r) for r in rings) == [-1, 9]
    assert all(len(r) == 4 for r in rings)


def test_corners_that_touch(spark):
    assert sorted(map(area, rings_of(spark, [(0, 0), (1, 1)]))) == [1, 1]
    assert [area(r) for r in rings_of(spark, [(0, 0), (1, 1)], eight=True)] == [2]


def test_long_ring_in_order(spark):
    (ring,) = rings_of(spark, [(0, c) for c in range(40)] + [(r, 0) for r in range(40)])
    assert len(ring) == 6 and area(ring) == 79


def test_no_pixels_no_rings(spark):
    assert rings_of(spark, []) == []


def polygons(spark, rows):
    return spark.createDataFrame(rows, "site int, id int, xs array<double>, ys array<double>")


@pytest.mark.parametrize("cell", [0.7, 2.0, 100.0])
def test_coverage_of_triangles_and_holes(spark, cell):
    square = ([0.0, 4.0, 4.0, 0.0, 0.0], [0.0, 0.0, 4.0, 4.0, 0.0])
    rows = [
        (1, 1, *square), (1, 1, [1.0, 2.0, 2.0, 1.0, 1.0], [1.0, 1.0, 2.0, 2.0, 1.0]),  # a hole
        (1, 2, [0.0, 4.0, 0.0, 0.0], [0.0, 0.0, 4.0, 0.0]),
        (2, 1, *square), (2, 2, *square),
        (3, 1, [0.0, 2.0, 0.0, 2.0, 0.0], [0.0, 2.0, 2.0, 0.0, 0.0]),  # crosses itself
        (4, 1, [0.0, 1.0], [0.0, 1.0]), (4, 2, None, None), (4, 3, [0.0, 1.0, math.nan, 0.0], [0.0, 0.0, 1.0, 0.0]),
    ]
    got = {r["site"]: (r["n"], round(r["union_area"], 9), round(r["common_area"], 9)) for r in O.coverage(polygons(spark, rows), "site", cell).collect()}
    assert got == {1: (2, 16, 7), 2: (2, 16, 16), 3: (1, 2, 2)}


def test_coverage_of_random_polygons_against_points(spark):
    rng = np.random.default_rng(3)
    shapes = []
    for _ in range(4):  # stars: concave
        a = np.sort(rng.uniform(0, 2 * np.pi, 9))
        r = rng.uniform(0.5, 2.0, 9)
        x, y = 2 + r * np.cos(a), 2 + r * np.sin(a)
        shapes.append(([*x, x[0]], [*y, y[0]]))
    got = O.coverage(polygons(spark, [(1, i, list(map(float, x)), list(map(float, y))) for i, (x, y) in enumerate(shapes)]), "site", 0.9).first()
    step = 4.2 / 700
    px, py = np.meshgrid(np.arange(-0.1, 4.1, step) + step / 2, np.arange(-0.1, 4.1, step) + step / 2)
    depth = np.zeros(px.shape, int)
    for xs, ys in shapes:
        inside = np.zeros(px.shape, bool)
        for x1, y1, x2, y2 in zip(xs, ys, xs[1:], ys[1:], strict=False):
            inside ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
        depth += inside
    assert got["union_area"] == pytest.approx((depth > 0).sum() * step * step, abs=0.02)
    assert got["common_area"] == pytest.approx((depth == 4).sum() * step * step, abs=0.02)


def test_patches_move_as_arrays_do(spark):
    image = np.arange(90).reshape(9, 10)
    df = spark.createDataFrame([(r, c, int(image[r, c])) for r in range(9) for c in range(10)], "row long, col long, v long")
    places = [(t, t % 6, (t * 2) % 7, t) for t in range(1, 8)]
    rows = P.cut_patches(df, spark.createDataFrame(places, "patch long, r0 long, c0 long, transform long"), 4, ["v"]).collect()
    moved = {1: lambda a: a[::-1], 2: lambda a: a[:, ::-1], 3: np.transpose, 4: np.rot90, 5: lambda a: np.rot90(a, 2), 6: lambda a: np.rot90(a, 3), 7: lambda a: a}
    for t, r0, c0, _ in places:
        got = np.full((4, 4), -1)
        for r in rows:
            if r["patch"] == t:
                got[r["row"], r["col"]] = r["v"]
        assert (got == moved[t](image[r0 : r0 + 4, c0 : c0 + 4])).all()
    drawn = P.draw_patches(spark, 50, 9, 10, 4).collect()
    assert len(drawn) == 50 and all(0 <= d["r0"] <= 5 and 0 <= d["c0"] <= 6 and 1 <= d["transform"] <= 7 for d in drawn)


def test_a_blob_is_an_extremum(spark):
    image = {(r, c): 100.0 * math.exp(-((r - 8) ** 2 + (c - 9) ** 2) / 8) for r in range(17) for c in range(19)}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in image.items()], "row long, col long, v double")
    found = P.scale_extrema(df, "v", [0.6, 1.2, 2.0, 3.2, 5.0], 1.0).collect()
    best = max(found, key=lambda x: abs(x["response"]))
    assert (best["row"], best["col"]) == (8, 9) and best["response"] < 0


def test_small_groups_close_without_joins(spark, monkeypatch):
    """Rings of small groups are closed in tasks as the joins would; a large group goes by joins."""
    links = [(g, g * 1000 + i, g * 1000 + (i + 1) % n if i < n else g * 1000 + n + (i + 1 - n) % 3) for g, n in ((1, 4), (2, 7), (3, 40)) for i in range(n + 3)]
    chain = spark.createDataFrame(links, "g long, id long, next long")
    want = {tuple(r) for r in O._doubled(chain).collect()}
    assert len(want) == len(links)
    monkeypatch.setattr(O, "SMALL", 20)
    assert {tuple(r) for r in O.ranked(chain, "g").collect()} == want
    monkeypatch.setattr(O, "SMALL", 512)
    monkeypatch.setattr(O, "_doubled", None)
    assert {tuple(r) for r in O.ranked(chain, "g").collect()} == want


def test_small_cells_are_covered_together(monkeypatch):
    """Cells of few sides share a task's arrays and give what each gives alone, however batches part them."""
    import pyarrow as pa

    rng, rows = np.random.default_rng(5), []
    for cell in range(60):
        for k in range(rng.integers(1, 5)):
            n = rng.integers(3, 8)
            x, y = (rng.integers(-1, 4, n).astype(float) if cell % 2 else rng.uniform(-1, 4, n) for _ in range(2))
            rows.append((cell // 2, cell % 2, 0, f"p{k % 3}" if k else None, [*x, x[0]], [*y, y[0]]))
    table = pa.table({name: [r[i] for r in rows] for i, name in enumerate(("by", "cx", "cy", "id", "xs", "ys"))})

    def found(rows_a_batch):
        return np.concatenate([np.stack([b.column(k).to_numpy() for k in range(4)], axis=1) for b in O._covers(iter(table.to_batches(rows_a_batch)), 2.0)])

    monkeypatch.setattr(O, "SIDES", 0)
    alone = found(1000)
    assert len(alone) == 60 and alone[:, 3].sum() > 1
    monkeypatch.setattr(O, "SIDES", 64)
    monkeypatch.setattr(O, "_cell_cover", None)
    for rows_a_batch, pairs in ((1000, 1 << 20), (7, 1 << 20), (1000, 300)):
        monkeypatch.setattr(O, "PAIRS", pairs)
        assert np.allclose(found(rows_a_batch), alone, atol=1e-12)


@pytest.mark.parametrize("eight", [False, True])
def test_small_regions_are_traced_without_joins(spark, monkeypatch, eight):
    """Tasks trace small regions as joins trace large ones."""
    rng = np.random.default_rng(7)
    cells = [(r, c, int(1 + k)) for k in range(3) for r in range(k * 9, k * 9 + 8) for c in range(-4, 5) if rng.random() < 0.6]
    df = spark.createDataFrame(cells, "row int, col int, component long")
    want = {tuple(r) for r in O._joined_rings(df, eight).collect()}
    monkeypatch.setattr(O, "PIXELS", 43)  # one region or two of three are larger
    sizes = [sum(c[2] == k for c in cells) for k in (1, 2, 3)]
    assert min(sizes) <= 43 < max(sizes)
    assert {tuple(r) for r in O.outlines(df, eight).collect()} == want
    monkeypatch.setattr(O, "PIXELS", 4096)
    monkeypatch.setattr(O, "_joined_rings", None)
    assert {tuple(r) for r in O.outlines(df, eight).collect()} == want


@pytest.mark.parametrize("eight", [False, True])
def test_only_links_between_tiles_spread(spark, monkeypatch, eight):
    """Regions over several tiles are whole, and few links leave the tasks that label them."""
    from fieldgrid.operators import regions as G

    rng = np.random.default_rng(9)
    value = {(r, c): float(rng.random() < 0.5) if (r + c) % 17 else math.nan for r in range(-20, 80) for c in range(50, 140)}
    df = spark.createDataFrame([(*k, v) for k, v in value.items()], "row int, col long, v double")
    linked, write = [], G.written
    monkeypatch.setattr(G, "written", lambda t: (lambda w: linked.append(w.count()) or w if w.columns == ["u", "v"] else w)(write(t)))
    got = {(r["row"], r["col"]): r["component"] for r in G.components(df, "v", eight, None).collect()}
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (-1, -1), (1, -1), (-1, 1)] if eight else [])
    want = {}
    for k in sorted(value):
        todo = [] if k in want else [k]
        want.setdefault(k, (k[0] << 31) + k[1])
        while todo:
            at = todo.pop()
            for near in ((at[0] + a, at[1] + b) for a, b in steps):
                if near in value and near not in want and (value[near] == value[at] or math.isnan(value[near]) and math.isnan(value[at])):
                    want[near] = want[at]
                    todo.append(near)
    assert got == want and len(set(want.values())) > 50
    assert 0 < linked[0] < len(value) / 10
