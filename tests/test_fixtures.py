"""Hand-checkable inputs: small grids, points, matrices and texts."""

import math

import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import physics, scalar
from fieldgrid.operators import geometry, learning, raster, regions, relational, timeseries, zonal
from fieldgrid.plans.physics import iaqi_inverse
from fieldgrid.sources import files, web
from fieldgrid.streaming import observations

GRID = [[3, 5, 6, 4, 4, 3], [4, 5, 8, 9, 6, 5], [2, 2, 5, 7, 6, 4], [5, 7, 9, 8, 9, 7], [4, 6, 5, 7, 7, 5], [3, 2, 5, 3, 4, 4]]


def grid(spark, values):
    return spark.createDataFrame([(i, j, v) for i, row in enumerate(values) for j, v in enumerate(row)], "row int, col int, v int")


def test_focal_mean(spark):
    out = {(r.row, r.col): r.m for r in raster.focal_mean(grid(spark, GRID), "v", "m").collect()}
    assert len(out) == 16
    assert out[1, 1] == pytest.approx((3 + 5 + 6 + 4 + 5 + 8 + 2 + 2 + 5) / 9)
    assert out[4, 4] == pytest.approx((8 + 9 + 7 + 7 + 7 + 5 + 3 + 4 + 4) / 9)


def test_connected_components(spark):
    image = ["0010010", "1110111", "0010010", "0110110"]
    df = grid(spark, [[int(c) for c in line] for line in image])
    parts = regions.region_sizes(regions.components(df, "v", width=7)).collect()
    assert sorted(r["size"] for r in parts) == [7, 7]


def test_sieve_merges_the_small_region(spark):
    df = grid(spark, [[1, 1, 1, 1], [1, 2, 1, 1], [3, 3, 3, 3]])
    out = {(r.row, r.col): r.v for r in regions.sieve(df, "v", 2).collect()}
    assert out[1, 1] == 1 and out[2, 0] == 3 and len(out) == 12


def test_block_mean_of_resample_grid(spark):
    df = grid(spark, [[r * 6 + c for c in range(6)] for r in range(4)])
    out = {(r.row, r.col): r.m for r in raster.block_mean(df, "v", "m", 2).collect()}
    assert out == {(i, j): (12 * i + 2 * j) + 3.5 for i in range(2) for j in range(3)}


def test_confusion_scores(spark):
    m = [[10, 1, 2], [3, 15, 4], [5, 6, 20]]
    df = spark.createDataFrame([(t, p) for p in range(3) for t in range(3) for _ in range(m[p][t])], "t int, p int")
    a = zonal.accuracy(df, "t", "p").first()
    n, right = 66, 45
    pe = (18 * 13 + 22 * 22 + 26 * 31) / n**2
    assert a.accuracy == pytest.approx(right / n) and a.kappa == pytest.approx((right / n - pe) / (1 - pe))
    s = {r.label: r for r in zonal.class_scores(df, "t", "p").collect()}
    assert s[0].precision == pytest.approx(10 / 13) and s[0].sensitivity == pytest.approx(10 / 18)


def test_pam_points(spark):
    pts = [(2, 6), (8, 4), (3, 8), (4, 7), (6, 2), (6, 4), (7, 3), (7, 4), (8, 5), (7, 6)]
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(pts)], "id long, xy array<double>")
    groups = {}
    for r in learning.pam(df, "id", "xy", 2).collect():
        groups.setdefault(r.medoid, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[0, 2, 3], [1, 4, 5, 6, 7, 8, 9]]


def test_evapotranspiration_call(spark):
    c = F.lit
    svp, slope, avp = physics.vapour_pressure(c(34.4), c(26.2), c(84.0), c(66.0))
    p, psy = physics.air_pressure(c(5.2))
    ra = physics.daily_radiation(c(201), c(32.48))
    rn = physics.net_radiation(c(7), ra, c(34.4), c(26.2), avp)
    u2 = physics.wind_at_2m(c(2.5))
    row = spark.range(1).select(p.alias("p"), psy.alias("psy"), ra.alias("ra"), u2.alias("u2"), physics.et0(slope, rn, 0.0, psy, u2, svp, avp, c(30.3)).alias("et0"), rn.alias("rn")).first()
    assert (row.p, row.psy) == (101.2, 0.067) and row.u2 == pytest.approx(2.5 * 4.87 / math.log(672.58), abs=1e-3)
    assert 39 < row.ra < 41 and 3 < row.et0 < 9


def test_air_quality(spark):
    df = spark.createDataFrame([(0.0,), (35.0,), (55.0,), (600.0,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(physics.iaqi("pm2_5", F.col("v"))).collect()] == [0.0, 50.0, 75.0, 500.0, None]
    top, main, level = physics.aqi({"pm2_5": F.lit(35.0), "pm10": F.lit(50.0)})
    assert tuple(spark.range(1).select(top, main, level).first()) == (50.0, "pm2_5,pm10", 1)


def test_concentrations_beyond_the_last_breakpoint(spark, tmp_path):
    values = [0.0, 55.25, 599.99, 600.01, 1234.5, -3.25, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert dict(map(tuple, iaqi_inverse(spark, str(tmp_path)).collect())) == dict(enumerate(values))


def test_geometry(spark):
    square = [10.0, 20.0, 20.0, 10.0, 10.0], [10.0, 10.0, 20.0, 20.0, 10.0]
    df = spark.createDataFrame([square], "xs array<double>, ys array<double>")
    row = df.select(scalar.shoelace(F.col("xs"), F.col("ys")).alias("a"), scalar.in_ring(F.lit(15.0), F.lit(15.0), F.col("xs"), F.col("ys")).alias("i"), scalar.in_ring(F.lit(25.0), F.lit(15.0), F.col("xs"), F.col("ys")).alias("o")).first()
    assert (row.a, row.i, row.o) == (100.0, True, False)
    pts = spark.createDataFrame([("a", float(x), float(y)) for x in range(5) for y in range(4)], "g string, x double, y double")
    hull = geometry.convex_hulls(pts, "g").first()
    assert hull.area == 12.0 and len(hull.xs) == 5


def test_julia_checksum_of_a_row(spark):
    """Row 500 of the grid of 1000 by 1000 with 300 iterations, against plain arithmetic."""
    c, want = complex(-0.62772, -0.42193), 0
    y = 1.8 - 500 * 3.6 / 1000
    for k in range(1000):
        z, n = complex(-1.8 + k * 3.6 / 1000, y), 0
        while n < 300 and abs(z) < 2:
            z, n = z * z + c, n + 1
        want += n
    got = spark.range(1000).select((F.col("id") * 3.6 / 1000 - 1.8).alias("x")).agg(F.sum(scalar.julia_steps(F.col("x"), F.lit(y), c.real, c.imag, 300))).first()[0]
    assert abs(got - want) <= 5  # rounding of the first coordinates may differ


def test_julia_checksum_of_the_grid(spark):
    """The known sum of the grid of 1000 by 1000, its coordinates added up step by step."""
    from itertools import accumulate, repeat

    xs, ys = ([c for c in accumulate(repeat(step, 1000), initial=first) if abs(c) <= 1.8 + 1e-9 and ((c < 1.8) if step > 0 else (c > -1.8))] for first, step in ((-1.8, 3.6 / 1000), (1.8, -3.6 / 1000)))
    rows = spark.createDataFrame([(y,) for y in ys], "y double").repartition(16)
    grid = rows.select("y", F.explode(F.array(*map(F.lit, xs))).alias("x"))
    got = scalar.with_julia_steps(grid, "x", "y", -0.62772, -0.42193, 300).agg(F.sum("steps"), F.count("*")).first()
    assert tuple(got) == (33219980, 1_000_000)


def test_upsert_first_match_and_pivot(spark):
    stored, fresh = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string"), spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "k int, v int, x string")
    assert sorted(tuple(r) for r in relational.upsert(stored, fresh, ["k"], "v").collect()) == [(1, 2, "c"), (2, 5, "b"), (3, 1, "e")]
    assert sorted(tuple(r) for r in relational.first_match(stored.select("k"), fresh, "k", ["v"]).collect()) == [(1, 2, "c"), (2, 4, "d")]


def test_series(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(1, 5)], "g string, t long, v double")
    assert [r[0] for r in df.select("t", timeseries.moving_average(["g"], ["t"], "v", 3).alias("m")).orderBy("t").select("m").collect()] == pytest.approx([2.0, 3.0, 7 / 3, 4 / 3])
    gaps = spark.createDataFrame([("s", 0, 1.0), ("s", 1, None), ("s", 2, 3.0), ("s", 3, None)], "g string, t long, v double")
    assert [r[0] for r in gaps.select("t", timeseries.interpolated(["g"], "t", "v").alias("v")).orderBy("t").select("v").collect()] == [1.0, 2.0, 3.0, None]


def test_sources(spark, tmp_path):
    (tmp_path / "w-2020-03-01.txt").write_text("2 -5 0 1.5\n8 -999 0 2\n14 7 0 -999\n")
    lines = spark.read.text(str(tmp_path / "w-2020-03-01.txt")).select("value", F.col("_metadata.file_name").alias("f"))
    got = files.hourly_weather(lines, F.col("f")).orderBy("hour").collect()
    assert [(str(r.date), r.hour, r.temperature, r.rain) for r in got] == [("2020-03-01", 2, -5.0, 1.5), ("2020-03-01", 14, 7.0, None)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "B1.txt").write_text("0.1 0.2 0.3\n1 2 3\n\n")
    assert [tuple(r) for r in files.coefficient_files(spark, str(tmp_path / "c")).orderBy("band").collect()] == [("B1", 1, 0.1, 0.2, 0.3), ("B1", 2, 1.0, 2.0, 3.0)]
    (tmp_path / "d.csv").write_text("AKST,Max TemperatureF,Min TemperatureF\n2014-1-1,46,42\n2014-1-2,,40\n")
    assert files.daily_weather(spark, str(tmp_path / "d.csv"), "AKST", {"high": "Max TemperatureF", "low": "Min TemperatureF"}).count() == 1
    page = spark.createDataFrame([("http://a.b/x", '<a href="/in">1</a><a href="http://c.d/">2</a><a href="/in">3</a><script>var d = {"k": 4};</script><tr><td><b>5</b></td></tr>')], "url string, html string")
    assert [(r.link, r.internal) for r in web.links(page).orderBy("place").collect()] == [("/in", True), ("http://c.d/", False)]
    assert web.embedded_json(page, "d", "k int").first().d.k == 4
    assert web.table_cells(page).first().cells == ["5"]
    assert raster.on_grid(spark.createDataFrame([(0, 0, 7)], "row int, col int, v int"), grid(spark, [[0, 0]]).select("row", "col"), "v", 200).count() == 2
    files.write_pixels(grid(spark, GRID), str(tmp_path / "px"), 3)
    assert files.pixel_table(spark, str(tmp_path / "px"), ["v"], (1, 2)).count() == 12


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    add = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    import datetime as dt

    row = lambda i, h: (i, dt.datetime(2024, 1, 1 + h // 24, h % 24), 1, "view", float(i), None)
    add("a.parquet", [row(1, 1), row(2, 2)])
    stream = lambda: observations.daily(observations.observations(spark, str(tmp_path / "in" / "*")), "event_type")
    observations.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    add("b.parquet", [row(3, 3), row(4, 60)])
    observations.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    done = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.n, r.total) for r in done] == [(3, 6.0)]


def test_projected_point(spark):
    x, y = scalar.to_utm(F.lit(48.8582), F.lit(2.2945), 31)
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert row.x == pytest.approx(448251.795, abs=0.05) and row.y == pytest.approx(5411932.678, abs=0.05)
    # A degree of the meridian at 45 degrees is 111 131 m on the ellipsoid.
    a, b = (scalar.to_utm(F.lit(v), F.lit(3.0), 31)[1] for v in (44.5, 45.5))
    assert spark.range(1).select((b - a) / 0.9996).first()[0] == pytest.approx(111131.7, abs=1)
