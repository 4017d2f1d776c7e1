"""Map projections both ways, and shifts between datums, as column expressions.

A ``Projection`` is read from a definition like ``+proj=utm +zone=12 +south +ellps=GRS80`` or from a code. Its steps are added to
a DataFrame one by one, so an expression that later steps use often is evaluated once a row. Supported: longlat, merc
(on a sphere or an ellipsoid), tmerc and utm, lcc, aea and cea; datum shifts of three or seven parameters. Degrees and metres.
Round trips are exact to a thousandth of a millimetre within 30 degrees of the central meridian.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Semi-major axes and inverse flattenings of ellipsoids.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "clrk66": (6378206.4, 294.978698213898), "intl": (6378388.0, 297.0),
    "krass": (6378245.0, 298.3), "bessel": (6377397.155, 299.1528128), "airy": (6377563.396, 299.3249646), "IAU76": (6378140.0, 298.257),
}
DATUMS = {"WGS84": "WGS84", "NAD83": "GRS80", "NAD27": "clrk66"}


@dataclass(frozen=True)
class Projection:
    kind: str = "longlat"
    a: float = 6378137.0
    f: float = 1 / 298.257223563
    lat0: float = 0.0
    lon0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    scale: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    shift: tuple[float, ...] = field(default=())

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


def parse(text: str) -> Projection:
    """A projection from its definition: words ``+name=value``."""
    said = dict((w.lstrip("+").split("=", 1) + [""])[:2] for w in text.split())
    number = lambda name, default=0.0: float(said.get(name, default))
    a, inverse = ELLIPSOIDS[said.get("ellps") or DATUMS[said.get("datum", "WGS84")]]
    a, f = number("a", a), 1 / number("rf", inverse)
    if "b" in said:
        f = 1 - number("b") / a
    kind, p = said["proj"], {"lat0": number("lat_0"), "lon0": number("lon_0"), "lat1": number("lat_1", said.get("lat_ts", said.get("lat_0", 0))), "scale": number("k_0", said.get("k", 1)), "x0": number("x_0"), "y0": number("y_0")}
    p["lat2"] = number("lat_2", p["lat1"])
    if kind == "utm":
        kind, p = "tmerc", {"lon0": 6 * int(said["zone"]) - 183.0, "scale": 0.9996, "x0": 500000.0, "y0": 1e7 if "south" in said else 0.0}
    if kind not in _FORWARD and kind not in ("longlat", "latlong"):
        raise ValueError(f"unknown projection {kind}")
    shift = tuple(float(x) for x in said["towgs84"].split(",")) if said.get("towgs84") else ()
    return Projection("longlat" if kind == "latlong" else kind, a, f, shift=shift if any(shift) else (), **p)


def from_code(code: int) -> Projection:
    """A projection from its EPSG code: WGS 84 and NAD 83 in degrees, web Mercator, and the UTM zones of both."""
    if code in (4326, 4269):
        return parse(f"+proj=longlat +ellps={'WGS84' if code == 4326 else 'GRS80'}")
    if code == 3857:
        return parse("+proj=merc +a=6378137 +b=6378137")
    for first, south, ellipsoid in ((32600, "", "WGS84"), (32700, "+south", "WGS84"), (26900, "", "GRS80")):
        if 1 <= code - first <= 60:
            return parse(f"+proj=utm +zone={code - first} {south} +ellps={ellipsoid}")
    raise ValueError(f"unknown code {code}")


# Coefficients of series in the third flattening n, from its first power on where the function starts.
_ALPHA = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800], [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440], [49561 / 161280, -179 / 168, 6601661 / 7257600], [34729 / 80640, -3418889 / 1995840], [212378941 / 319334400],
]
_BETA = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800], [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720], [4397 / 161280, -11 / 504, -830251 / 7257600], [4583 / 161280, -108847 / 3991680], [20648693 / 638668800],
]
_DELTA = [
    [2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675], [7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945],
    [56 / 15, -136 / 35, -1262 / 105, 73814 / 2835], [4279 / 630, -332 / 35, -399572 / 14175], [4174 / 315, -144838 / 6237], [601676 / 22275],
]


def _series(table: list[list[float]], f: float) -> list[float]:
    n = f / (2 - f)
    return [sum(c * n ** (k + j) for j, c in enumerate(row)) for k, row in enumerate(table, 1)]


def _radius(p: Projection) -> float:
    """Of the meridian's length."""
    n = p.f / (2 - p.f)
    return p.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)


def _isometric(p: Projection, sine: Column) -> Column:
    """Isometric latitude from the sine of the latitude."""
    return F.atanh(sine) - p.e * F.atanh(p.e * sine) if p.f else F.atanh(sine)


def _plain_isometric(p: Projection, lat: float) -> float:
    s = math.sin(math.radians(lat))
    return math.atanh(s) - p.e * math.atanh(p.e * s)


def _area(p: Projection, sine: Column) -> Column:
    """q, which grows with the area between the equator and a latitude."""
    return (1 - p.e2) * (sine / (1 - p.e2 * sine * sine) + F.atanh(p.e * sine) / p.e) if p.f else 2 * sine


def _plain_area(p: Projection, lat: float) -> float:
    s = math.sin(math.radians(lat))
    return (1 - p.e2) * (s / (1 - p.e2 * s * s) + math.atanh(p.e * s) / p.e) if p.f else 2 * s


def _parallel(p: Projection, lat: float) -> float:
    """Radius of a parallel, in units of a."""
    s = math.sin(math.radians(lat))
    return math.cos(math.radians(lat)) / math.sqrt(1 - p.e2 * s * s)


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns({f"_pr_{k}": c for k, c in columns.items()})


def _c(name: str) -> Column:
    return F.col(f"_pr_{name}")


# Forward: from _pr_lat and _pr_lon (radians from the central meridian) to _pr_x and _pr_y, before the false origin.


def _tmerc(df: DataFrame, p: Projection) -> DataFrame:
    alpha, r = _series(_ALPHA, p.f), _radius(p) * p.scale
    df = _with(df, t=F.sinh(_isometric(p, F.sin(_c("lat")))))
    df = _with(df, xi=F.atan2(_c("t"), F.cos(_c("lon"))), eta=F.asinh(F.sin(_c("lon")) / F.hypot(_c("t"), F.cos(_c("lon")))))
    north = reduce(add, (c * F.sin(2 * k * _c("xi")) * F.cosh(2 * k * _c("eta")) for k, c in enumerate(alpha, 1)), _c("xi"))
    east = reduce(add, (c * F.cos(2 * k * _c("xi")) * F.sinh(2 * k * _c("eta")) for k, c in enumerate(alpha, 1)), _c("eta"))
    return _with(df, x=r * east, y=r * north - p.scale * _meridian(p))


def _meridian(p: Projection) -> float:
    """Length of the meridian from the equator to the latitude of origin."""
    chi = math.atan(math.sinh(_plain_isometric(p, p.lat0)))
    return _radius(p) * (chi + sum(c * math.sin(2 * k * chi) for k, c in enumerate(_series(_ALPHA, p.f), 1)))


def _merc(df: DataFrame, p: Projection) -> DataFrame:
    k = p.a * (_parallel(p, p.lat1) if p.lat1 else p.scale)
    return _with(df, x=k * _c("lon"), y=k * _isometric(p, F.sin(_c("lat"))))


def _cone(p: Projection) -> tuple[float, float, float]:
    """n, a * F and the radius at the origin of a conformal cone."""
    m1, m2, q1, q2 = _parallel(p, p.lat1), _parallel(p, p.lat2), _plain_isometric(p, p.lat1), _plain_isometric(p, p.lat2)
    n = math.sin(math.radians(p.lat1)) if abs(p.lat1 - p.lat2) < 1e-10 else math.log(m1 / m2) / (q2 - q1)
    size = p.a * p.scale * m1 / n * math.exp(n * q1)
    return n, size, size * math.exp(-n * _plain_isometric(p, p.lat0))


def _lcc(df: DataFrame, p: Projection) -> DataFrame:
    n, size, r0 = _cone(p)
    df = _with(df, r=size * F.exp(-n * _isometric(p, F.sin(_c("lat")))))
    return _with(df, x=_c("r") * F.sin(n * _c("lon")), y=r0 - _c("r") * F.cos(n * _c("lon")))


def _equal_cone(p: Projection) -> tuple[float, float, float]:
    """n, C and the radius at the origin of an equal-area cone."""
    m1, m2, q1, q2 = _parallel(p, p.lat1), _parallel(p, p.lat2), _plain_area(p, p.lat1), _plain_area(p, p.lat2)
    n = math.sin(math.radians(p.lat1)) if abs(p.lat1 - p.lat2) < 1e-10 else (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    return n, c, p.a * math.sqrt(c - n * _plain_area(p, p.lat0)) / n


def _aea(df: DataFrame, p: Projection) -> DataFrame:
    n, c, r0 = _equal_cone(p)
    df = _with(df, r=p.a * F.sqrt(F.greatest(c - n * _area(p, F.sin(_c("lat"))), F.lit(0.0))) / n)
    return _with(df, x=_c("r") * F.sin(n * _c("lon")), y=r0 - _c("r") * F.cos(n * _c("lon")))


def _cea(df: DataFrame, p: Projection) -> DataFrame:
    k = _parallel(p, p.lat1)
    return _with(df, x=p.a * k * _c("lon"), y=p.a / (2 * k) * _area(p, F.sin(_c("lat"))))


_FORWARD = {"tmerc": _tmerc, "merc": _merc, "lcc": _lcc, "aea": _aea, "cea": _cea}

# Inverse: from _pr_x and _pr_y to _pr_lat and _pr_lon.


def _from_conformal(df: DataFrame, p: Projection) -> DataFrame:
    """The latitude of a conformal one, _pr_chi."""
    return _with(df, lat=reduce(add, (c * F.sin(2 * k * _c("chi")) for k, c in enumerate(_series(_DELTA, p.f), 1)), _c("chi")))


def _from_area(df: DataFrame, p: Projection) -> DataFrame:
    """The latitude of _pr_q: by a series, made exact by two of Newton's steps."""
    if not p.f:
        return _with(df, lat=F.asin(_c("q") / 2))
    e2 = p.e2
    beta = F.asin(F.greatest(F.least(_c("q") / _plain_area(p, 90.0), F.lit(1.0)), F.lit(-1.0)))
    df = _with(df, beta=beta)
    df = _with(df, lat=_c("beta") + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * _c("beta")) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * _c("beta")) + 761 * e2**3 / 45360 * F.sin(6 * _c("beta")))
    for _ in range(2):
        df = _with(df, s=F.sin(_c("lat")))
        w = 1 - e2 * _c("s") * _c("s")
        step = w * w / 2 * (_c("q") / (1 - e2) - _c("s") / w - F.atanh(p.e * _c("s")) / p.e)
        df = _with(df, lat=_c("lat") + F.when(F.cos(_c("lat")) > 1e-9, step / F.greatest(F.cos(_c("lat")), F.lit(1e-9))).otherwise(0.0))
    return df


def _tmerc_inverse(df: DataFrame, p: Projection) -> DataFrame:
    beta, r = _series(_BETA, p.f), _radius(p) * p.scale
    df = _with(df, xi=(_c("y") + p.scale * _meridian(p)) / r, eta=_c("x") / r)
    north = reduce(add, (-c * F.sin(2 * k * _c("xi")) * F.cosh(2 * k * _c("eta")) for k, c in enumerate(beta, 1)), _c("xi"))
    east = reduce(add, (-c * F.cos(2 * k * _c("xi")) * F.sinh(2 * k * _c("eta")) for k, c in enumerate(beta, 1)), _c("eta"))
    df = _with(df, n=north, h=east)
    df = _with(df, chi=F.asin(F.greatest(F.least(F.sin(_c("n")) / F.cosh(_c("h")), F.lit(1.0)), F.lit(-1.0))), lon=F.atan2(F.sinh(_c("h")), F.cos(_c("n"))))
    return _from_conformal(df, p)


def _merc_inverse(df: DataFrame, p: Projection) -> DataFrame:
    k = p.a * (_parallel(p, p.lat1) if p.lat1 else p.scale)
    return _from_conformal(_with(df, chi=F.atan(F.sinh(_c("y") / k)), lon=_c("x") / k), p)


def _polar(df: DataFrame, n: float, r0: float) -> DataFrame:
    sign = math.copysign(1.0, n)
    return _with(df, r=sign * F.hypot(_c("x"), r0 - _c("y")), lon=F.atan2(sign * _c("x"), sign * (r0 - _c("y"))) / n)


def _lcc_inverse(df: DataFrame, p: Projection) -> DataFrame:
    n, size, r0 = _cone(p)
    df = _polar(df, n, r0)
    return _from_conformal(_with(df, chi=math.pi / 2 - 2 * F.atan(F.pow(_c("r") / size, F.lit(1 / n)))), p)


def _aea_inverse(df: DataFrame, p: Projection) -> DataFrame:
    n, c, r0 = _equal_cone(p)
    df = _polar(df, n, r0)
    return _from_area(_with(df, q=(c - (_c("r") * n / p.a) * (_c("r") * n / p.a)) / n), p)


def _cea_inverse(df: DataFrame, p: Projection) -> DataFrame:
    k = _parallel(p, p.lat1)
    return _from_area(_with(df, q=_c("y") * 2 * k / p.a, lon=_c("x") / (p.a * k)), p)


_INVERSE = {"tmerc": _tmerc_inverse, "merc": _merc_inverse, "lcc": _lcc_inverse, "aea": _aea_inverse, "cea": _cea_inverse}

# Datums.


def _matrix(shift: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Translation, and rotation with scale, of a shift to WGS 84 (seconds of arc of a position vector, parts in a million)."""
    t = np.array(shift[:3], float)
    rx, ry, rz, ppm = (list(shift[3:]) + [0.0] * 4)[:4]
    rx, ry, rz = (math.radians(v / 3600) for v in (rx, ry, rz))
    return t, (1 + ppm * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])


def _geocentric(df: DataFrame, p: Projection) -> DataFrame:
    df = _with(df, n=p.a / F.sqrt(1 - p.e2 * F.sin(_c("lat")) * F.sin(_c("lat"))))
    flat = (_c("n") + _c("h")) * F.cos(_c("lat"))
    return _with(df, gx=flat * F.cos(_c("lon")), gy=flat * F.sin(_c("lon")), gz=(_c("n") * (1 - p.e2) + _c("h")) * F.sin(_c("lat")))


def _geodetic(df: DataFrame, p: Projection) -> DataFrame:
    """Latitude, longitude and height, by Bowring's formula twice."""
    b, flat = p.a * (1 - p.f), F.hypot(_c("gx"), _c("gy"))
    df = _with(df, flat=flat, u=F.atan2(_c("gz") * p.a, flat * b))
    for _ in range(2):
        s, c = F.sin(_c("u")), F.cos(_c("u"))
        df = _with(df, lat=F.atan2(_c("gz") + p.e2 / (1 - p.e2) * b * s * s * s, _c("flat") - p.e2 * p.a * c * c * c))
        df = _with(df, u=F.atan2((1 - p.f) * F.sin(_c("lat")), F.cos(_c("lat"))))
    s, c = F.sin(_c("lat")), F.cos(_c("lat"))
    return _with(df, lon=F.atan2(_c("gy"), _c("gx")), h=_c("flat") * c + _c("gz") * s - p.a * F.sqrt(1 - p.e2 * s * s))


def _moved(df: DataFrame, t: np.ndarray, m: np.ndarray, back: bool) -> DataFrame:
    g = [_c("gx"), _c("gy"), _c("gz")]
    if back:
        m = np.linalg.inv(m)
        g = [c - float(o) for c, o in zip(g, t, strict=True)]
    rows = [reduce(add, (float(k) * c for k, c in zip(row, g, strict=True))) for row in m]
    if not back:
        rows = [r + float(o) for r, o in zip(rows, t, strict=True)]
    return _with(df, gx=rows[0], gy=rows[1], gz=rows[2])


def transformed(df: DataFrame, x: str, y: str, source: Projection, target: Projection, out: tuple[str, str] = ("x", "y"), height: str | None = None) -> DataFrame:
    """``df`` and the places (x, y), or (longitude, latitude) in degrees, of one projection in another, as columns ``out``.

    A datum shift takes heights above the ellipsoid from the column ``height`` and replaces them by those above the other one;
    without it heights are 0, and a shift and its reverse come back to a few decimetres only. A null place stays null.
    """
    here = df.columns
    if source.kind == "longlat":
        df = _with(df, lat=F.radians(F.col(y)), lon=F.radians(F.col(x)))
    else:
        df = _with(df, x=F.col(x).cast("double") - source.x0, y=F.col(y).cast("double") - source.y0)
        df = _INVERSE[source.kind](df, source)
        df = _with(df, lon=_c("lon") + math.radians(source.lon0))
    if (source.shift, source.a, source.f) != (target.shift, target.a, target.f) and (source.shift or target.shift):
        df = _geocentric(_with(df, h=F.coalesce(F.col(height), F.lit(0.0)) if height else F.lit(0.0)), source)
        for shift, back in ((source.shift, False), (target.shift, True)):
            if shift:
                df = _moved(df, *_matrix(shift), back)
        df = _geodetic(df, target)
        if height:
            df = df.withColumn(height, _c("h"))
    if target.kind == "longlat":
        found = F.degrees(_c("lon")), F.degrees(_c("lat"))
    else:
        lon = _c("lon") - math.radians(target.lon0)
        df = _with(df, lon=lon - 2 * math.pi * F.floor((lon + math.pi) / (2 * math.pi)))
        df = _FORWARD[target.kind](df, target)
        found = _c("x") + target.x0, _c("y") + target.y0
    return df.select(*(c for c in here if c not in out), found[0].alias(out[0]), found[1].alias(out[1]))
