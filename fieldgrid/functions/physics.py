"""Radiometry, sun position, evapotranspiration and air quality as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_RAD = math.pi / 180


def surface_reflectance(dn: Column, gain: Column | float, xa: Column | float, xb: Column | float, xc: Column | float) -> Column:
    """Surface reflectance times 10000 from a digital number and its correction coefficients; 0 where there is no data."""
    y = dn * gain * xa - xb
    return F.when(dn == 0, 0.0).otherwise(F.bround(y / (1.0 + y * xc) * 10000))


def day_angle_series(day: Column) -> Column:
    a = 2 * math.pi * day / 365
    return 1.000110 + 0.034221 * F.cos(a) + 0.00128 * F.sin(a) + 0.000719 * F.cos(2 * a) + 0.000077 * F.sin(2 * a)


def apparent_reflectance(dn: Column, gain: Column, bias: Column, esun: Column, zenith_degrees: Column, day: Column) -> Column:
    """Reflectance at the top of the atmosphere times 10000; the distance series enters squared; 0 where there is no data."""
    d = day_angle_series(day)
    return F.when(dn == 0, 0.0).otherwise(10000.0 * (gain * dn + bias) * math.pi * (d * d) / (esun * F.cos(zenith_degrees * _RAD)))


# Calibration (satellite, sensor, band, gain, bias, solar irradiance); the last band of each sensor is panchromatic.
CALIBRATION = [
    ("GF2", "PMS1", 1, 0.1193, 0.0, 1941.53), ("GF2", "PMS1", 2, 0.1530, 0.0, 1854.15), ("GF2", "PMS1", 3, 0.1530, 0.0, 1541.48), ("GF2", "PMS1", 4, 0.1569, 0.0, 1086.43), ("GF2", "PMS1", 5, 0.1503, 0.0, 1364.03),
    ("GF2", "PMS2", 1, 0.1434, 0.0, 1940.93), ("GF2", "PMS2", 2, 0.1595, 0.0, 1853.99), ("GF2", "PMS2", 3, 0.1511, 0.0, 1541.39), ("GF2", "PMS2", 4, 0.1685, 0.0, 1086.51), ("GF2", "PMS2", 5, 0.1679, 0.0, 1361.93),
    ("GF1", "PMS1", 1, 0.1424, 0.0, 1944.98), ("GF1", "PMS1", 2, 0.1177, 0.0, 1854.42), ("GF1", "PMS1", 3, 0.1194, 0.0, 1542.63), ("GF1", "PMS1", 4, 0.1135, 0.0, 1080.81), ("GF1", "PMS1", 5, 0.1228, 0.0, 1371.53),
    ("GF1", "PMS2", 1, 0.1460, 0.0, 1945.34), ("GF1", "PMS2", 2, 0.1248, 0.0, 1854.15), ("GF1", "PMS2", 3, 0.1274, 0.0, 1543.62), ("GF1", "PMS2", 4, 0.1255, 0.0, 1081.93), ("GF1", "PMS2", 5, 0.1365, 0.0, 1376.10),
    ("SSC6", "", 1, 0.2474, -59.940, 2009.28), ("SSC6", "", 2, 0.1332, -27.919, 1820.25), ("SSC6", "", 3, 0.1110, -24.487, 1583.3), ("SSC6", "", 4, 0.1255, -44.010, 1114.22), ("SSC6", "", 5, 0.0715, -49.873, 1582.79),
]
CALIBRATION_SCHEMA = "satellite string, sensor string, band int, gain double, bias double, esun double"


def declination(day: Column) -> Column:
    """Solar declination in radians."""
    return 23.45 * _RAD * F.sin((day - 81) * (360 / 365 * _RAD))


def sun_position(day: Column, utc_hours: Column, lat: Column, lon: Column, zone: int = 8) -> tuple[Column, Column]:
    """Zenith and azimuth in degrees, to three decimals."""
    b = (day - 81) * (360 / 365 * _RAD)
    eot = 9.87 * F.sin(2 * b) - 7.53 * F.cos(b) - 1.5 * F.sin(b)
    solar = utc_hours + zone + (4 * (lon - 15 * zone) + eot) / 60
    hour, decl, phi = 15 * (solar - 12) * _RAD, declination(day), lat * _RAD
    up = F.asin(F.sin(decl) * F.sin(phi) + F.cos(decl) * F.cos(phi) * F.cos(hour))
    east = (F.sin(decl) * F.cos(phi) - F.cos(decl) * F.sin(phi) * F.cos(hour)) / F.cos(up)
    return 90 - F.round(up / _RAD, 3), F.round(F.acos(F.greatest(F.least(east, F.lit(1.0)), F.lit(-1.0))) / _RAD, 3)


def air_pressure(altitude: Column) -> tuple[Column, Column]:
    """Air pressure (kPa) and the psychrometric constant."""
    p = 101.3 * F.pow((293 - 0.0065 * altitude) / 293, F.lit(5.26))
    return F.round(p, 1), F.round(0.665e-3 * p, 3)


def _saturation(t: Column) -> Column:
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def vapour_pressure(t_max: Column, t_min: Column, rh_max: Column, rh_min: Column, t_mean: Column | None = None) -> tuple[Column, Column, Column]:
    """Saturation pressure, slope of its curve, actual pressure; the mean temperature is that of the extremes if not given."""
    mean = (t_max + t_min) / 2 if t_mean is None else t_mean
    high, low = _saturation(t_max), _saturation(t_min)
    slope = 4098 * _saturation(mean) / ((mean + 237.3) * (mean + 237.3))
    return F.round((high + low) / 2, 3), F.round(slope, 3), F.round((low * rh_max / 100 + high * rh_min / 100) / 2, 3)


def _sunset(day: Column, lat: Column) -> Column:
    return F.acos(-F.tan(lat * _RAD) * F.tan(declination(day)))


def daily_radiation(day: Column, lat: Column) -> Column:
    """Extraterrestrial radiation of a day (MJ per square metre)."""
    phi, decl, ws = lat * _RAD, declination(day), _sunset(day, lat)
    inverse = 1 + 0.033 * F.cos(2 * math.pi * day / 365)
    return 24 * 60 * 0.082 * inverse * (ws * F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.sin(ws)) / math.pi


def hourly_radiation(day: Column, lat: Column, lon: Column, start: Column, end: Column, zone: int = 8) -> Column:
    """Extraterrestrial radiation between two hours of a day."""
    phi, decl = lat * _RAD, declination(day)
    b = (day - 81) * (360 / 365 * _RAD)
    season = 0.1645 * F.sin(2 * b) - 0.1255 * F.cos(b) - 0.025 * F.sin(b)
    w = math.pi * ((start + end) / 2 + 0.06667 * (lon - 15 * zone) + season - 12) / 12
    half = math.pi * (end - start) / 24
    inverse = 1 + 0.033 * F.cos(2 * math.pi * day / 365)
    return 12 * 60 * 0.082 * inverse * (2 * half * F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * (F.sin(w + half) - F.sin(w - half))) / math.pi


def net_radiation(month: Column, radiation: Column, t_max: Column, t_min: Column, actual: Column) -> Column:
    """Net radiation; clear-sky coefficients 0.17 + 0.45 from April to September, else 0.14 + 0.45."""
    rs = 0.16 * radiation * F.sqrt(t_max - t_min)
    rso = (F.when(month.between(4, 9), 0.17).otherwise(0.14) + 0.45) * radiation
    warm = (F.pow(t_max + 273.16, F.lit(4)) + F.pow(t_min + 273.16, F.lit(4))) / 2
    return (1 - 0.23) * rs - 4.903e-9 * warm * (0.34 - 0.14 * F.sqrt(actual)) * (1.35 * rs / rso - 0.35)


def wind_at_2m(wind: Column) -> Column:
    return F.round(wind * 4.87 / math.log(67.8 * 10 - 5.42), 3)


def et0(slope: Column, net: Column, soil: Column | float, psychrometric: Column, wind2: Column, saturation: Column, actual: Column, t_mean: Column) -> Column:
    """Reference evapotranspiration (mm a day) by Penman and Monteith; ``soil``: heat flux into the soil."""
    return (0.408 * slope * (net - soil) + psychrometric * 900 * wind2 * (saturation - actual) / (t_mean + 273)) / (slope + psychrometric * (1 + 0.34 * wind2))


# Index levels, and the concentrations at which each pollutant reaches them.
IAQI_LEVELS = [0, 50, 100, 150, 200, 300, 400, 500]
BREAKPOINTS = {
    "so2_24h": [0, 50, 150, 475, 800, 1600, 2100, 2620],
    "so2": [0, 150, 500, 650, 800, 1600, 2100, 2620],
    "no2_24h": [0, 40, 80, 180, 280, 565, 750, 940],
    "no2": [0, 100, 200, 700, 1200, 2340, 3090, 3840],
    "pm10": [0, 50, 150, 250, 350, 420, 500, 600],
    "pm10_24h": [0, 50, 150, 250, 350, 420, 500, 600],
    "pm2_5": [0, 35, 75, 115, 150, 250, 350, 500],
    "pm2_5_24h": [0, 35, 75, 115, 150, 250, 350, 500],
    "co_24h": [0, 2, 4, 14, 24, 36, 48, 60],
    "co": [0, 5, 10, 35, 60, 90, 120, 150],
    "o3": [0, 160, 200, 300, 400, 800, 1000, 1200],
    "o3_8h": [0, 100, 160, 215, 265, 800, 1000, 1200],
}


def _piecewise(x: Column, xs: list[int], ys: list[int], capped: bool = True) -> Column:
    lines = [((y1 - y0) / (x1 - x0) * (x - x0) + y0, x1) for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False)]
    out = F.when(x <= xs[0], F.lit(float(ys[0])) if capped else lines[0][0])
    for y, x1 in lines:
        out = out.when(x <= x1, y)
    return F.when(x >= 0, out.otherwise(F.lit(float(ys[-1])))) if capped else out.otherwise(lines[-1][0])


def iaqi(pollutant: str, value: Column, capped: bool = True) -> Column:
    """Index of one pollutant: piecewise linear, 500 at most, null below zero; not ``capped``: the first and last lines go on."""
    return _piecewise(value, BREAKPOINTS[pollutant], IAQI_LEVELS, capped)


def concentration(pollutant: str, index: Column, capped: bool = True) -> Column:
    """The concentration at which a pollutant has an index: the inverse of ``iaqi``. Of a capped index 500 may be any from the last breakpoint on."""
    return _piecewise(index, IAQI_LEVELS, BREAKPOINTS[pollutant], capped)


def aqi(values: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Air quality index, its primary pollutants (comma-joined, in the order given), its level from 1 to 6."""
    each = {p: iaqi(p, v) for p, v in values.items()}
    top = F.greatest(*each.values()) if len(each) > 1 else next(iter(each.values()))
    primary = F.array_join(F.filter(F.array(*[F.when(x == top, F.lit(p)) for p, x in each.items()]), lambda x: x.isNotNull()), ",")
    level = F.when(top <= 50, 1).when(top <= 100, 2).when(top <= 150, 3).when(top <= 200, 4).when(top <= 300, 5).otherwise(6)
    return top, primary, F.when(top.isNotNull(), level)


def aerosol_depth(value: Column) -> Column:
    """Mean optical depth of a footprint: 0.001 times the mean of the valid values, 0.6 if there are none (an aggregate)."""
    return F.coalesce(F.avg(F.when(value != -9999, value)) * 0.001, F.lit(0.6))
