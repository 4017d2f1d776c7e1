"""Map projections: known places, round trips and datum shifts."""

import math

import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import projections as P
from fieldgrid.functions import scalar


def places(spark, lons, lats):
    return spark.createDataFrame([(float(x), float(y)) for x in lons for y in lats], "lon double, lat double")


@pytest.mark.parametrize("text", [
    "+proj=utm +zone=31", "+proj=utm +zone=31 +south +ellps=intl", "+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", "+proj=merc +lat_ts=40", "+proj=merc +a=6378137 +b=6378137",
    "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=39 +lon_0=5", "+proj=lcc +lat_1=-20 +lat_2=-40 +lat_0=-30 +lon_0=5", "+proj=lcc +lat_1=46 +lat_0=46 +lon_0=2 +k_0=0.9999", "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=5", "+proj=aea +lat_1=-18 +lat_2=-36 +lat_0=0 +lon_0=5", "+proj=cea +lat_ts=45",
])
def test_round_trips(spark, text):
    p, degrees = P.parse(text), P.parse("+proj=longlat")
    degrees = P.Projection("longlat", p.a, p.f)
    df = places(spark, range(-12, 20, 4), range(-80, 81, 10))
    back = P.transformed(P.transformed(df.withColumns({"a": F.col("lon"), "b": F.col("lat")}), "lon", "lat", degrees, p), "x", "y", p, degrees, ("lon", "lat"))
    off = back.select(F.max(F.abs(F.col("lon") - F.col("a"))), F.max(F.abs(F.col("lat") - F.col("b")))).first()
    assert max(off) < 1e-3 / 111_000


def test_known_places(spark):
    one = lambda code_or_text, lon, lat: tuple(P.transformed(places(spark, [lon], [lat]), "lon", "lat", P.from_code(4326), P.from_code(code_or_text) if isinstance(code_or_text, int) else P.parse(code_or_text)).select("x", "y").first())
    # The Lambert and Albers examples of Snyder's manual (Clarke 1866): 35 N, 75 W.
    x, y = P.transformed(places(spark, [-75], [35]), "lon", "lat", P.parse("+proj=longlat +ellps=clrk66"), P.parse("+proj=lcc +lat_1=33 +lat_2=45 +lat_0=23 +lon_0=-96 +ellps=clrk66")).select("x", "y").first()
    assert (round(x, 1), round(y, 1)) == (1894410.9, 1564649.5)
    x, y = P.transformed(places(spark, [-75], [35]), "lon", "lat", P.parse("+proj=longlat +ellps=clrk66"), P.parse("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66")).select("x", "y").first()
    assert (round(x, 1), round(y, 1)) == (1885472.7, 1535925.0)
    # The transverse Mercator example: 40 30 N, 73 30 W, zone 18 of Clarke's ellipsoid.
    x, y = P.transformed(places(spark, [-73.5], [40.5]), "lon", "lat", P.parse("+proj=longlat +ellps=clrk66"), P.parse("+proj=utm +zone=18 +ellps=clrk66")).select("x", "y").first()
    assert (round(x - 500000, 1), round(y, 1)) == (127106.5, 4484124.4)
    edge = math.pi * 6378137
    assert one(3857, 180.0, 0.0) == pytest.approx((-edge, 0), abs=1e-6) or one(3857, 180.0, 0.0) == pytest.approx((edge, 0), abs=1e-6)
    df = places(spark, [0.5, 2.9, 5.5], [1, 45, 70])
    e, n = scalar.to_utm(F.col("lat"), F.col("lon"), 31)
    got = P.transformed(df.withColumns({"e": e, "n": n}), "lon", "lat", P.from_code(4326), P.from_code(32631))
    assert all(abs(r.x - r.e) < 0.005 and abs(r.y - r.n) < 0.005 for r in got.collect())
    south = P.transformed(df.withColumn("lat", -F.col("lat")), "lon", "lat", P.from_code(4326), P.from_code(32731))
    north = {round(r.x, 6): r.y for r in got.collect()}
    assert all(round(r.y + north[round(r.x, 6)] - 1e7, 6) == 0 for r in south.collect())


def test_datum_shifts(spark):
    # A published example of seven parameters (WGS 72 to WGS 84): 55 N, 4 E to 55 00 00.090 N, 4 00 00.554 E.
    old, new = P.Projection("longlat", 6378135.0, 1 / 298.26, shift=(0, 0, 4.5, 0, 0, 0.554, 0.219)), P.from_code(4326)
    r = P.transformed(places(spark, [4], [55]), "lon", "lat", old, new, ("lon", "lat")).first()
    assert (r.lat - 55) * 3600 == pytest.approx(0.090, abs=5e-3) and (r.lon - 4) * 3600 == pytest.approx(0.554, abs=5e-3)
    df = places(spark, range(-170, 180, 30), range(-80, 81, 20)).withColumns({"a": F.col("lon"), "b": F.col("lat")})
    shifted = P.parse("+proj=longlat +ellps=bessel +towgs84=598.1,73.7,418.2,0.202,0.045,-2.455,6.7")
    there = P.transformed(df.withColumn("h", F.lit(0.0)), "lon", "lat", shifted, new, ("lon", "lat"), "h")
    back = P.transformed(there, "lon", "lat", new, shifted, ("lon", "lat"), "h")
    far = there.select(F.min(F.abs(F.col("lat") - F.col("b")) + F.abs(F.col("lon") - F.col("a")))).first()[0]
    off = back.select(F.max(F.abs(F.col("lat") - F.col("b"))), F.max(F.abs(F.col("lon") - F.col("a")) * F.cos(F.radians("b")))).first()
    assert far > 1e-6 and max(off) < 1e-3 / 111_000
    none = P.transformed(spark.createDataFrame([(None, 1.0, 7)], "lon double, lat double, x int"), "lon", "lat", new, P.parse("+proj=utm +zone=1")).first()
    assert none.x is None and none.lat == 1.0
    with pytest.raises(ValueError):
        P.parse("+proj=nonesuch")
    with pytest.raises(ValueError):
        P.from_code(1)
