"""Training patches cut from rasters, and extrema of difference-of-Gaussian layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .raster import focal, gaussian

#: Where pixel (i, j) of a patch whose last index is m goes: rows reversed, columns reversed, transposed, turned left by
#: one, two and three quarters, unchanged.
TRANSFORMS = {1: ("m - i", "j"), 2: ("i", "m - j"), 3: ("j", "i"), 4: ("m - j", "i"), 5: ("m - i", "m - j"), 6: ("j", "m - i"), 7: ("i", "j")}


def draw_patches(spark: SparkSession, n: int, rows: int, cols: int, size: int, seed: int = 0) -> DataFrame:
    """(patch, r0, c0, transform): places of ``n`` whole patches and one of seven transforms each, drawn by hash."""
    draw = lambda k, most: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(most))
    return spark.range(n).select(F.col("id").alias("patch"), draw(0, rows - size + 1).alias("r0"), draw(1, cols - size + 1).alias("c0"), (draw(2, 7) + 1).alias("transform"))


def cut_patches(df: DataFrame, patches: DataFrame, size: int, bands: Sequence[str]) -> DataFrame:
    """(patch, row, col, bands): pixels of each patch (patch, r0, c0, transform), moved by its transform.

    A patch meets four blocks of its own size at most, so patches and pixels are joined by block.
    """
    block = lambda c: F.floor(F.col(c) / size)
    both = lambda c: F.array_distinct(F.array(block(c), F.floor((F.col(c) + size - 1) / size)))
    asks = patches.select("*", F.explode(both("r0")).alias("br")).select("*", F.explode(both("c0")).alias("bc"))
    pixels = df.select("row", "col", *bands, block("row").alias("br"), block("col").alias("bc"))
    i, j = F.col("row") - F.col("r0"), F.col("col") - F.col("c0")
    inside = asks.join(pixels, ["br", "bc"]).withColumn("i", i).withColumn("j", j).where(f"i BETWEEN 0 AND {size - 1} AND j BETWEEN 0 AND {size - 1}")
    place = lambda axis: F.expr("CASE transform " + " ".join(f"WHEN {t} THEN {ij[axis].replace('m', str(size - 1))}" for t, ij in TRANSFORMS.items()) + " END")
    return inside.select("patch", place(0).alias("row"), place(1).alias("col"), *bands)


def scale_extrema(df: DataFrame, value: str, sigmas: Sequence[float], least: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, layer, row, col, response): pixels whose difference of Gaussians is the extreme of its 26 neighbours.

    Layer k is the image smoothed by sigma k + 1 less that by sigma k; only inner layers, pixels whose square is whole
    and responses of ``least`` or more count. Layers are columns, so all windows share two shuffles.
    """
    for k, s in enumerate(sigmas):
        df = gaussian(df, value, f"_g{k}", s, by)
    layers = range(len(sigmas) - 1)
    d = df.select(*by, "row", "col", *[(F.col(f"_g{k + 1}") - F.col(f"_g{k}")).alias(f"_d{k}") for k in layers])
    for k in layers:
        d = focal(focal(focal(d, f"_d{k}", f"_lo{k}", "min", 1, by), f"_d{k}", f"_hi{k}", "max", 1, by), f"_d{k}", f"_m{k}", "mean", 1, by)
    out = None
    for k in layers[1:-1]:
        here, around = F.col(f"_d{k}"), [k - 1, k, k + 1]
        extreme = ((here > 0) & (here == F.greatest(*[f"_hi{a}" for a in around]))) | ((here < 0) & (here == F.least(*[f"_lo{a}" for a in around])))
        found = d.where(extreme & (F.abs(here) >= least) & (F.col(f"_m{k}_n") == 9)).select(*by, F.lit(k).alias("layer"), "row", "col", here.alias("response"))
        out = found if out is None else out.unionByName(found)
    return out
