"""Spectral indices by name. Bands are reflectances times 10000; 0 is no data.

``register_index`` adds to the registry; ``with_indices`` appends any of them to a pixel table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Bands = Mapping[str, Column]
INDICES: dict[str, Callable[[Bands], Column]] = {}


def register_index(name: str, build: Callable[[Bands], Column]) -> None:
    INDICES[name] = build


def _index(build: Callable[[Bands], Column]) -> Callable[[Bands], Column]:
    register_index(build.__name__, build)
    return build


def to_int16(x: Column) -> Column:
    """Truncated toward zero; null where a 16-bit integer can't hold it."""
    whole = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
    return F.when(whole.between(-32768, 32767), whole).cast("smallint")


def _scaled(x: Column) -> Column:
    return to_int16(x * 1000)


def _reflectance(x: Column) -> Column:
    return x / 10000.0


@_index
def ndvi(b: Bands) -> Column:
    return _scaled((b["nir"] - b["red"]) / (b["nir"] + b["red"] + 1e-6))


@_index
def ndvi_masked(b: Bands) -> Column:
    """-99 where both bands are empty."""
    return F.when(b["nir"] + b["red"] > 0, (b["nir"] - b["red"]) / (b["nir"] + b["red"])).otherwise(-99.0)


@_index
def msavi(b: Bands) -> Column:
    nir, red = _reflectance(b["nir"]), _reflectance(b["red"])
    return _scaled(nir + 0.5 - F.sqrt((nir + 0.5) * (nir + 0.5) - 2 * (nir - red)))


@_index
def mtci(b: Bands) -> Column:
    return _scaled((b["re2"] - b["re1"]) / (b["re1"] - b["red"] + 1e-6))


@_index
def arvi(b: Bands) -> Column:
    return _scaled((b["nir"] - 2 * b["red"] + b["blue"]) / (b["nir"] + 2 * b["red"] - b["blue"] + 1e-6))


@_index
def vi7(b: Bands) -> Column:
    blue, green, red, nir = (_reflectance(b[k]) for k in ("blue", "green", "red", "nir"))
    return _scaled((blue + green + red) * (nir + red) / (nir - red + 1e-6))


@_index
def vi4(b: Bands) -> Column:
    return b["blue"] + b["green"] + b["red"]


@_index
def gcvi(b: Bands) -> Column:
    """The small term is beside the quotient, not in its denominator; null where green is 0."""
    return to_int16((F.try_divide(b["nir"] * 1.0, b["green"]) + 1e-6 - 1) * 1000)


@_index
def dvi(b: Bands) -> Column:
    return b["nir"] - b["red"]


@_index
def ndre(b: Bands) -> Column:
    return _scaled((b["nir"] - b["re1"]) / (b["nir"] + b["re1"] + 1e-6))


@_index
def ttvi(b: Bands) -> Column:
    re2, re3, re4 = (_reflectance(b[k]) for k in ("re2", "re3", "re4"))
    return 0.5 * ((865 - 740) * (re3 - re2) - (re4 - re2) * (783 - 740))


@_index
def ireci(b: Bands) -> Column:
    re1, re2, re3, red = (_reflectance(b[k]) for k in ("re1", "re2", "re3", "red"))
    return F.round((re3 - red) / (re1 / (re2 + 1e-5) + 1e-5), 3)


def with_indices(pixels: DataFrame, names: Iterable[str]) -> DataFrame:
    """``pixels`` and a column for each index; bands are its columns."""
    bands = {c: F.col(c) for c in pixels.columns}
    return pixels.withColumns({n: INDICES[n](bands) for n in names})


def cover_fraction(ndvi_value: Column, low: Column, high: Column) -> Column:
    """Fractional vegetation cover between two clip points of the index, 0.99 at most."""
    clipped = F.least(F.greatest(ndvi_value, low), high)
    return F.least(1 - F.pow((high - clipped) / (high - low), F.lit(0.6175)), F.lit(0.99))


def perpendicular_drought(red: Column, nir: Column, slope: float, cover: Column, red_veg: float = 0.05, nir_veg: float = 0.5) -> Column:
    """Modified perpendicular drought index on a soil line of the given slope."""
    m = F.lit(slope)
    return (red + m * nir - cover * (red_veg + m * nir_veg)) / ((1 - cover) * F.sqrt(m * m + 1))


def is_cloud(blue: Column, red: Column) -> Column:
    return (_reflectance(blue) > 0.15) | (_reflectance(red) > 0.18)


def decision_rule(b3: Column, b4: Column, b6: Column) -> Column:
    return F.when((b6 - b3).between(4600, 6200) & (b4 > 1000), 12).otherwise(200)


def cloud_code(mask: Column) -> Column:
    """Cloud code of an 8-bit mask value: 0 no data, 3 cloud (bits 1 and 2 clear), 2 otherwise."""
    return F.when(mask == 0, 0).when(mask.bitwiseAND(F.lit(6)) == 0, 3).otherwise(2)
