"""Vector layers: texts, bytes and shapefiles."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from fieldgrid.sources import vectors as V

GEOMETRIES = [
    ("POINT", [[(1.5, -2.0)]]), ("LINESTRING", [[(0.0, 0.0), (1.0, 1.0), (2.5, 1e-7)]]), ("POLYGON", [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 2.0), (2.0, 3.0), (1.0, 3.0), (1.0, 2.0)]]),
    ("MULTILINESTRING", [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 5.0)]]), ("MULTIPOINT", [[(1.0, 1.0), (2.0, 2.0)]]), ("POLYGON", []), ("POINT", []),
]


def plain(g):
    return None if g is None else (g.kind, [[(p.x, p.y) for p in r] for r in g.parts])


def test_texts_and_bytes_round_trip(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate([*GEOMETRIES, None])], f"i int, g {V.GEOMETRY}")
    made = df.select("i", "g", V.to_wkt(F.col("g")).alias("t"), V.to_wkb(F.col("g")).alias("b"))
    rows = made.select("*", V.from_wkt(F.col("t")).alias("gt"), V.from_wkb(F.col("b")).alias("gb")).orderBy("i").collect()
    for r, g in zip(rows, [*GEOMETRIES, None], strict=True):
        assert plain(r.gt) == plain(r.gb) == g, r
    assert rows[0].t == "POINT (1.5 -2.0)" and rows[2].t.startswith("POLYGON ((0.0 0.0, 0.0 4.0,") and rows[5].t == "POLYGON EMPTY"
    odd = spark.createDataFrame([("point(3 4)",), ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",), ("MULTIPOINT ((1 1), (2 2))",), ("nonsense",), ("POLYGON ((0 0, 1",), (None,)], "t string")
    got = [plain(r.g) for r in odd.select(V.from_wkt(F.col("t")).alias("g")).collect()]
    assert got[0] == ("POINT", [[(3.0, 4.0)]]) and got[1][0] == "POLYGON" and len(got[1][1]) == 2 and got[2] == GEOMETRIES[4] and got[3:] == [None] * 3
    big = struct.pack(">BI2d", 0, 1, 7.0, 8.0)
    many = struct.pack("<BII", 1, 6, 1) + struct.pack("<BIII", 1, 3, 1, 2) + struct.pack("<4d", 0, 0, 1, 1)
    values = spark.createDataFrame([(big,), (many,), (b"",), (b"\x01\x02",), (big[:-1],), (struct.pack("<BII", 1, 2, 1 << 31),), (None,)], "b binary")
    assert [plain(r.g) for r in values.select(V.from_wkb(F.col("b")).alias("g")).collect()] == [("POINT", [[(7.0, 8.0)]]), ("POLYGON", [[(0.0, 0.0), (1.0, 1.0)]]), None, None, None, None, None]


def layer(spark, n=500):
    rows = []
    for i in range(n):
        x = float(i)
        rings = [[(x, 0.0), (x, 1.0), (x + 1, 1.0), (x + 1, 0.0), (x, 0.0)]] + ([[(x + 0.2, 0.2), (x + 0.4, 0.2), (x + 0.4, 0.4), (x + 0.2, 0.2)]] if i % 2 else [])
        rows.append((i, f"näme {i % 7}" if i % 5 else None, i / 3, dt.date(2020, 1, 1 + i % 28), i % 2 == 0, ("POLYGON", rings) if i % 50 else None))
    return spark.createDataFrame(rows, f"id long, name string, size double, day date, even boolean, geometry {V.GEOMETRY}"), rows


def test_shapefiles_round_trip(spark, tmp_path):
    df, rows = layer(spark)
    path = str(tmp_path / "layer")
    V.write_layer(df.repartition(3), path)
    assert len(list((tmp_path / "layer").glob("*.shp"))) == 3 and not list((tmp_path / "layer").glob("_*"))
    back = V.read_layer(spark, path)
    assert dict(back.dtypes) == {"id": "bigint", "name": "string", "size": "double", "day": "date", "even": "boolean", "geometry": V.GEOMETRY}
    got = sorted((r.id, r.name, r.size, r.day, r.even, plain(r.geometry)) for r in back.collect())
    assert got == rows
    V.write_layer(df.where("id < 10").coalesce(1), path)
    assert V.read_layer(spark, path).count() == 510
    V.write_layer(df.where("id < 10").coalesce(1), path, "overwrite")
    assert V.read_layer(spark, path).count() == 10 and len(list((tmp_path / "layer").glob("*.shp"))) == 1


def test_ranges_filters_and_boxes(spark, tmp_path):
    df, rows = layer(spark)
    path = str(tmp_path / "layer")
    V.write_layer(df.coalesce(1), path)
    V.register(spark)
    read = spark.read.format("shapes").option("records", "60").load(path)
    assert read.rdd.getNumPartitions() == 9 and read.count() == 500
    for condition, want in [("id = 77", lambda r: r[0] == 77), ("name = 'näme 3' AND size >= 50", lambda r: r[1] == "näme 3" and r[2] >= 50), ("name IS NULL", lambda r: r[1] is None), ("id IN (1, 2, 600) AND even", lambda r: r[0] == 2), ("day < DATE'2020-01-05'", lambda r: r[3] < dt.date(2020, 1, 5)), ("name LIKE 'näme 1%'", lambda r: (r[1] or "").startswith("näme 1")), ("id % 2 = 1", lambda r: r[0] % 2)]:
        assert sorted(r.id for r in read.where(condition).collect()) == [r[0] for r in rows if want(r)], condition
    reader = V.ShapeReader(read.schema, {"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("id",), 3), GreaterThan(("geometry", "kind"), "x")])) == [GreaterThan(("geometry", "kind"), "x")] and len(list(reader.read(reader.partitions()[0]))) == 1
    boxed = V.read_layer(spark, path, (100.5, -5, 102.5, 5)).collect()
    assert sorted(r.id for r in boxed) == [101, 102]  # 100 has no geometry


def test_kinds_datasets_and_errors(spark, tmp_path):
    kinds = spark.createDataFrame([(i, g) for i, g in enumerate(GEOMETRIES[:5])], f"id int, geometry {V.GEOMETRY}")
    for i, (kind, parts) in enumerate(GEOMETRIES[:5]):
        path = str(tmp_path / str(i))
        V.write_layer(kinds.where(f"id = {i}"), path)
        assert [plain(r.geometry) for r in V.read_layer(spark, path).collect()] == [(kind, parts)]
    V.write_layers(kinds.withColumn("layer", F.concat(F.lit("l"), "id")), str(tmp_path / "dataset"), "layer")
    assert sorted(p.name for p in (tmp_path / "dataset").iterdir()) == ["l0", "l1", "l2", "l3", "l4"]
    with pytest.raises(Exception, match="one kind of shape"):
        V.write_layer(kinds.coalesce(1), str(tmp_path / "mixed"))
    assert not list((tmp_path / "mixed").glob("*.shp"))
    with pytest.raises(Exception, match="10 letters"):
        V.write_layer(kinds.withColumn("a_very_long_name", F.lit(1)), str(tmp_path / "long"))
    with pytest.raises(Exception, match="longer than 254"):
        V.write_layer(kinds.where("id = 0").withColumn("t", F.lit("x" * 300)), str(tmp_path / "wide"))
    with pytest.raises(Exception, match="no shapefile"):
        (tmp_path / "none").mkdir()
        V.read_layer(spark, str(tmp_path / "none")).count()


def test_a_task_writes_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """A task holds the records of one file only, whatever its rows; all are read back."""
    df, rows = layer(spark, 300)
    path = str(tmp_path / "layer")
    monkeypatch.setattr(V, "HELD", 20_000)
    writer = V.ShapeWriter(df.schema, path, False)
    taken, written, file = 0, [], V.ShapeWriter._file

    def seen(self, fs, stem, records, *rest):
        written.append((taken, len(records[0]), sum(map(len, (r for c in records for r in c)))))
        file(self, fs, stem, records, *rest)

    def stream():
        nonlocal taken
        for row in df.coalesce(1).collect():
            taken += 1
            yield row

    monkeypatch.setattr(V.ShapeWriter, "_file", seen)
    writer.commit([writer.write(stream()), None])
    assert len(written) > 5 and sum(n for _, n, _ in written) == 300 and all(size < 21_000 for _, _, size in written)
    assert [t for t, _, _ in written] == [sum(n for _, n, _ in written[: k + 1]) for k in range(len(written))]
    assert len(list((tmp_path / "layer").glob("*.shp"))) == len(written) and not list((tmp_path / "layer").glob("_*"))
    got = sorted((r.id, r.name, r.size, r.day, r.even, plain(r.geometry)) for r in V.read_layer(spark, path).collect())
    assert got == rows
