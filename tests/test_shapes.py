"""Shapes on rasters, folders of tables, database upserts and written trees, on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldgrid.operators import learning as L
from fieldgrid.operators import relational as R
from fieldgrid.operators import shapes as S
from fieldgrid.sources import database, files, web


def test_quarter_turn(spark):
    df = spark.createDataFrame([(r, c, 10 * r + c) for r in range(3) for c in range(3)], "row long, col long, v long")
    got = {(r.row, r.col): r.v for r in S.turned(df, "v", 90, 3, 3).collect()}
    assert got == {(r, c): 10 * c + 2 - r for r in range(3) for c in range(3)}


def test_rescaled_to_half_and_double(spark):
    df = spark.createDataFrame([(r, c, 10 * r + c) for r in range(4) for c in range(4)], "row long, col long, v long")
    half = {(r.row, r.col): r.v for r in S.rescaled(df, 1, 2).collect()}
    assert half == {(r, c): 10 * (2 * r + 1) + 2 * c + 1 for r in range(2) for c in range(2)}
    assert S.rescaled(df, 2, 1).count() == 64


def test_points_meet_polygons_of_any_size(spark):
    """Sizes from a hundredth of a cell to a thousand cells, against the test of all pairs."""
    rnd = random.Random(1)
    points = [(i, rnd.uniform(-50, 1050), rnd.uniform(-50, 1050)) for i in range(400)]
    points += [(400 + i, rnd.uniform(0, 2), rnd.uniform(0, 2)) for i in range(100)]
    rings = []
    for k in range(40):
        size = 10 ** rnd.uniform(-2, 3)
        x, y = (rnd.uniform(0, 2), rnd.uniform(0, 2)) if size < 1 else (rnd.uniform(0, 500), rnd.uniform(0, 500))
        rings.append((k, [x, x + size, x, x], [y, y, y + size, y]))
    p, q = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(rings, "k int, xs array<double>, ys array<double>")
    got = sorted((r.id, r.k) for r in R.points_in_polygons(p, q, 1.0).select("id", "k").collect())
    want = sorted((i, k) for i, x, y in points for k, xs, ys in rings if x > xs[0] and y > ys[0] and (x - xs[0]) + (y - ys[0]) < xs[1] - xs[0])
    assert got == want
    near = sorted((r.id, r.k) for r in S.near_polygons(p, q, 3.0, 1.0).select("id", "k").collect())

    def away(x, y, xs, ys):
        best = math.inf
        for j in range(3):
            dx, dy = xs[j + 1] - xs[j], ys[j + 1] - ys[j]
            t = min(1, max(0, ((x - xs[j]) * dx + (y - ys[j]) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(x - xs[j] - t * dx, y - ys[j] - t * dy))
        return best

    assert near == sorted(set(want) | {(i, k) for i, x, y in points for k, xs, ys in rings if away(x, y, xs, ys) <= 3})
    assert R.points_in_polygons(p, q.limit(0), 1.0).count() == 0


def test_polygons_without_pixels_of_the_class(spark):
    px = spark.createDataFrame([(0, 0, 5)], "row long, col long, cls long")
    polygons = spark.createDataFrame([(1, [0.0, 1.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 1.0, 0.0]), (2, [8.0, 9.0, 9.0, 8.0, 8.0], [8.0, 8.0, 9.0, 9.0, 8.0])], "k int, xs array<double>, ys array<double>")
    got = {r.k: (r.n, r.area) for r in S.class_area_in_polygons(px, polygons, "k", "cls", 5, (0.0, 1.0, 0.0, 1.0), 4.0, 2.0).collect()}
    assert got == {1: (1, 0.5), 2: (0, 0.0)}


def test_united_outline_of_two_squares_and_a_hole(spark):
    """A ring of four bars around a hole is one outline and one hole; corners are those of the drawn bars."""
    box = lambda x0, y0, x1, y1: ([x0, x1, x1, x0, x0], [y0, y0, y1, y1, y0])
    bars = [box(0, 0, 3, 1), box(0, 2, 3, 3), box(0, 0, 1, 3), box(2, 0, 3, 3)]
    df = spark.createDataFrame([(7, *b) for b in bars], "site long, xs array<long>, ys array<long>")
    rows = S.united_outlines(df, "site", 4).collect()
    rings = {}
    for r in rows:
        assert r.site == 7
        rings.setdefault(r.ring, set()).add((r.x, r.y))
    assert sorted(map(sorted, rings.values())) == [[(0, 0), (0, 3), (3, 0), (3, 3)], [(1, 1), (1, 2), (2, 1), (2, 2)]]


def test_object_ends_where_it_closes(spark):
    page = "x data = {\n \"a\": {\"b\": \"};<\"},\n \"c\": 2 }; data2 = {\"c\": 3}"
    df = spark.createDataFrame([(page,), ("no script",), (None,)], "html string")
    got = [r.data and (r.data.a.b, r.data.c) for r in web.embedded_json(df, "data", "a struct<b:string>, c int").collect()]
    assert got == [("};<", 2), None, None]


def test_tables_of_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text("1,x\n2,y\n")
    (tmp_path / "deep" / "b.csv").write_text("3,z\n")
    (tmp_path / "c.txt").write_text("4,w\n")
    got = sorted(map(tuple, files.csv_parts(spark, str(tmp_path), "n int, s string").collect()))
    assert got == [(1, "x", "a.csv"), (2, "y", "a.csv"), (3, "z", "b.csv")]
    assert sorted((r.name, r.length) for r in files.files(spark, str(tmp_path), "*.csv").collect()) == [("a.csv", 8), ("b.csv", 4)]


def test_database_merges(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    kind = "k int, t int, v double"
    table = lambda: sorted(tuple(r) for r in spark.read.jdbc(url, "seen", properties=driver).collect())
    files.append_jdbc(spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0), (9, None, 0.0)], kind), url, "seen", driver)
    merge = lambda rows, **note: database.upsert_jdbc(spark.createDataFrame(rows, kind), url, "seen", ["k"], "t", driver, **note)
    assert merge([(2, 2, 5.0), (3, 1, 6.0), (1, 0, 9.0), (9, 1, 3.0), (3, 1, 4.0), (None, 7, 7.0)])
    assert table() == [(1, 1, 1.0), (2, 2, 5.0), (3, 1, 6.0), (9, 1, 3.0)]
    # A batch runs once, whatever it brings the second time; another stream's batch of the number is another.
    assert merge([(1, 5, 10.0)], stream="a", batch=3) and not merge([(1, 6, 11.0)], stream="a", batch=3) and merge([(4, 1, 1.0)], stream="b", batch=3)
    assert table() == [(1, 5, 10.0), (2, 2, 5.0), (3, 1, 6.0), (4, 1, 1.0), (9, 1, 3.0)]
    # A failure in the middle leaves the table whole, and no note of the batch.
    with database._connection(spark, url, driver) as c:
        database._run(c, 'ALTER TABLE seen ADD CONSTRAINT small CHECK ("v" < 100)')
        c.commit()
    before = table()
    with pytest.raises(Exception, match="(?i)constraint"):
        merge([(1, 9, 1.0), (2, 9, 1000.0), (5, 1, 1.0)], stream="a", batch=4)
    assert table() == before
    with database._connection(spark, url, driver) as c:
        database._run(c, "CREATE TABLE touched (n INT)")
        for what in ("INSERT", "UPDATE"):
            database._run(c, f"CREATE TRIGGER on_{what} AFTER {what} ON seen REFERENCING NEW AS fresh FOR EACH ROW INSERT INTO touched VALUES (fresh.\"k\")")
        c.commit()
    assert merge([(1, 9, 1.0), (2, 9, 99.0), (5, 1, 1.0), (3, 0, 0.0)], stream="a", batch=4)
    assert table() == [(1, 9, 1.0), (2, 9, 99.0), (3, 1, 6.0), (4, 1, 1.0), (5, 1, 1.0), (9, 1, 3.0)]
    assert sorted(r[0] for r in spark.read.jdbc(url, "touched", properties=driver).collect()) == [1, 2, 5]  # no other key is written
    with database._connection(spark, url, driver) as c:
        names = c.getMetaData().getTables(None, None, "SEEN_S%", None)
        assert not names.next()


def test_stream_into_a_database(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    for k in range(3):
        spark.createDataFrame([(u, k, float(u + k)) for u in range(k, 6)], "k int, t int, v double").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, t int, v double").parquet(source)
        database.upsert_stream(stream, url, "live", ["k"], "t", driver, check).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.jdbc(url, "live", properties=driver).collect())
    assert got == [(u, min(u, 2), float(u + min(u, 2))) for u in range(6)]


def test_written_tree_predicts_as_before(spark, tmp_path):
    nodes = [(0, "a", 2.5, 1, 2, None), (1, None, None, None, None, 7), (2, None, None, None, None, 8)]
    files.write_tree(spark, nodes, str(tmp_path / "tree"))
    again = files.read_tree(spark, str(tmp_path / "tree"))
    assert again == nodes
    df = spark.createDataFrame([(1.0,), (3.0,)], "a double")
    assert [r[0] for r in df.select(L.tree_predict(df, again)).collect()] == [7, 8]


def test_proximity_equals_all_pairs(spark):
    rnd = random.Random(3)
    px = [(r, c, int(rnd.random() < 0.02)) for r in range(20) for c in range(20) if rnd.random() < 0.9]
    df = spark.createDataFrame(px, "row long, col long, v long")
    from fieldgrid.operators import raster

    got = {(r.row, r.col): r.d for r in raster.proximity(df, F.col("v") == 1, "d", 4).collect()}
    on = [(r, c) for r, c, v in px if v]
    for r, c, _ in px:
        d = min((math.hypot(r - a, c - b) for a, b in on), default=math.inf)
        assert got[r, c] == (d if d <= 4 else None)


def test_rings_on_arrays_equal_expressions(spark):
    """Tests on arrays of a batch say what the expressions say of each row; rows without a ring hold nothing."""
    from fieldgrid.functions import scalar

    rng, rows = random.Random(4), []
    for k in range(400):
        n = rng.randrange(1, 8)
        ring = [(rng.randrange(6), rng.randrange(6)) for _ in range(n)]
        ring.append(ring[0])
        rows.append((k, rng.randrange(13) / 2, rng.randrange(13) / 2, [float(p[0]) for p in ring], [float(p[1]) for p in ring]))
    df = spark.createDataFrame([*rows, (400, 1.0, 1.0, None, None)], "k int, x double, y double, xs array<double>, ys array<double>")
    c = [F.col(v) for v in ("x", "y", "xs", "ys")]
    plain = scalar.in_ring(*c) | (scalar.squared_distance_to_ring(*c) <= 1.5625)
    got = df.select("k", S.inside(*c).alias("i"), S.inside_or_near(*c, 1.25).alias("n"), F.coalesce(scalar.in_ring(*c), F.lit(False)).alias("pi"), F.coalesce(plain, F.lit(False)).alias("pn")).collect()
    assert len(got) == 401 and all((r.i, r.n) == (r.pi, r.pn) for r in got)
    assert 0 < sum(r.i for r in got) < sum(r.n for r in got) < 401
