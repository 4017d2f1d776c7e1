"""Statistics of pixels by zone: shares, majorities, modes, areas, cross counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def zonal(pixels: DataFrame, zone: str, **aggregates: Column) -> DataFrame:
    """Any aggregate Columns by zone."""
    return pixels.groupBy(zone).agg(*[c.alias(k) for k, c in aggregates.items()])


def mean_not_zero(value: str, digits: int = 4) -> Column:
    return F.round(F.avg(F.when(F.col(value) != 0, F.col(value))), digits)


def class_shares(pixels: DataFrame, zone: str, value: str, legend: DataFrame) -> DataFrame:
    """(zone, id, share): the share of a zone's pixels that aren't 0 in each legend range (id, min, max: half open), to 3 digits.

    The legend is a small table by nature (a colour table) and travels to the pixels.
    """
    seen = pixels.where(F.col(value) != 0)
    total = seen.groupBy(zone).agg(F.count("*").alias("_t"))
    inside = seen.join(F.broadcast(legend), (F.col(value) >= F.col("min")) & (F.col(value) < F.col("max"))).groupBy(zone, "id").agg(F.count("*").alias("_n"))
    return inside.join(total, zone).select(zone, "id", F.round(F.col("_n") / F.col("_t"), 3).alias("share"))


def zonal_mode(pixels: DataFrame, zone: str, value: str) -> DataFrame:
    """(zone, mode, share): each zone's most frequent value, the smallest of equals, and its share to 2 digits."""
    n = pixels.groupBy(zone, value).agg(F.count("*").alias("_n"))
    top = n.groupBy(zone).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_m"), F.sum("_n").alias("_t"))
    return top.select(zone, F.col("_m.v").alias("mode"), F.round(-F.col("_m.n") / F.col("_t"), 2).alias("share"))


def zonal_majority(pixels: DataFrame, zone: str, value: str, flags: Sequence[float], least: float, nodata: float) -> DataFrame:
    """(zone, flag): the flag of the largest share among the flags if that is ``least`` or more, else no data; ties: the first flag."""
    place = F.array_position(F.array(*map(F.lit, flags)), F.col(value))
    n = pixels.where(F.col(value).isin(*flags)).groupBy(zone, value).agg(F.count("*").alias("_n"))
    best = n.groupBy(zone).agg(F.min(F.struct((-F.col("_n")).alias("n"), place.alias("p"), F.col(value).alias("v"))).alias("_m"), F.sum("_n").alias("_t"))
    chosen = F.when(-F.col("_m.n") / F.col("_t") >= least, F.col("_m.v")).otherwise(F.lit(nodata))
    return pixels.select(zone).distinct().join(best.select(zone, chosen.alias("flag")), zone, "left").withColumn("flag", F.coalesce("flag", F.lit(nodata)))


def class_areas(pixels: DataFrame, value: str, dx: float, dy: float, drop: float | None = 200, unit: float = 666.7) -> DataFrame:
    """(value, area): pixels of each class times their size, in units of ``unit`` square metres."""
    rows = pixels if drop is None else pixels.where(F.col(value) != drop)
    return rows.groupBy(value).agg(F.round(F.count("*") * abs(dx * dy) / unit, 4).alias("area"))


def cross_counts(pixels: DataFrame, zone: str, value: str, values: Sequence) -> DataFrame:
    """A row for each zone, a column for the count of each value."""
    return pixels.groupBy(zone).pivot(value, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def cloud_fraction(pixels: DataFrame, raster: str, code: str) -> DataFrame:
    return pixels.groupBy(raster).agg(F.round(F.try_divide(F.count_if(F.col(code) == 3), F.count_if(F.col(code) != 0)), 3).alias("fraction"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: overall accuracy and kappa, from the counts of pairs of labels."""
    n = confusion(df, truth, predicted)
    rows, cols = n.groupBy("truth").agg(F.sum("n").alias("r")), n.groupBy("predicted").agg(F.sum("n").alias("c"))
    chance = rows.join(cols, F.col("truth") == F.col("predicted")).agg(F.sum(F.col("r") * F.col("c")).alias("rc"))
    both = n.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("d")).crossJoin(chance)
    po, pe = F.col("d") / F.col("t"), F.col("rc") / (F.col("t") * F.col("t"))
    return both.select(po.alias("accuracy"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, sensitivity, specificity, f1) of each label that occurs as truth."""
    n = confusion(df, truth, predicted)
    each = n.select(F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("label"), "truth", "predicted", "n")
    is_t, is_p = F.col("truth") == F.col("label"), F.col("predicted") == F.col("label")
    sums = each.groupBy("label").agg(F.sum(F.when(is_t & is_p, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~is_t & is_p, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(is_t & ~is_p, F.col("n")).otherwise(0)).alias("fn"))
    sums = sums.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t"))))
    tn = F.col("t") - F.col("tp") - F.col("fp") - F.col("fn")
    return sums.where(F.col("tp") + F.col("fn") > 0).select(
        "label", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("sensitivity"),
        F.try_divide(tn, tn + F.col("fp")).alias("specificity"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def iqr_mean(df: DataFrame, by: str, row: str, band: str, value: str, any_band: bool = False) -> DataFrame:
    """Mean spectrum of each class over its rows within the quartile fences: in all bands, or with ``any_band`` in one at least.

    ``df`` is long: a row for each sample and band.
    """
    fences = df.groupBy(by, band).agg(F.percentile(value, 0.25).alias("_q1"), F.percentile(value, 0.75).alias("_q3"))
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    inside = df.join(fences, [by, band]).withColumn("_in", (F.col(value) >= F.col("_q1") - reach) & (F.col(value) <= F.col("_q3") + reach))
    kept = inside.groupBy(by, row).agg((F.max if any_band else F.min)("_in").alias("_keep")).where("_keep").select(by, row)
    return df.join(kept, [by, row]).groupBy(by, band).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))


def gram_schmidt(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Bands made orthogonal in order as gs_<band>: less the mean and the projections on those before. A pass for each band."""
    out = df
    for i, b in enumerate(bands):
        if not i:
            out = out.withColumn(f"gs_{b}", F.col(b).cast("double"))
            continue
        before = [f"gs_{x}" for x in bands[:i]]
        stats = out.agg(F.avg(b).alias("_mean"), *[F.try_divide(F.covar_pop(b, g), F.var_pop(g)).alias(f"_phi{j}") for j, g in enumerate(before)])
        less = [F.coalesce(F.col(f"_phi{j}"), F.lit(0.0)) * F.col(g) for j, g in enumerate(before)]
        out = out.crossJoin(F.broadcast(stats)).withColumn(f"gs_{b}", F.col(b) - F.col("_mean") - sum(less[1:], less[0])).drop("_mean", *[f"_phi{j}" for j in range(i)])
    return out


def lag_table(df: DataFrame, by: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumns({f"last_{c}": F.lag(c).over(w) for c in columns})


def gram_schmidt_inverse(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Bands back from ``gram_schmidt``'s columns, as back_<band>; the bands themselves give means and projections."""
    out = df
    for i, b in enumerate(bands):
        if not i:
            out = out.withColumn(f"back_{b}", F.col(f"gs_{b}"))
            continue
        before = [f"gs_{x}" for x in bands[:i]]
        stats = out.agg(F.avg(b).alias("_mean"), *[F.coalesce(F.try_divide(F.covar_pop(b, g), F.var_pop(g)), F.lit(0.0)).alias(f"_phi{j}") for j, g in enumerate(before)])
        more = [F.col(f"_phi{j}") * F.col(g) for j, g in enumerate(before)]
        out = out.crossJoin(F.broadcast(stats)).withColumn(f"back_{b}", F.col(f"gs_{b}") + F.col("_mean") + sum(more[1:], more[0])).drop("_mean", *[f"_phi{j}" for j in range(i)])
    return out
