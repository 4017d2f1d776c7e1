"""Histograms, cumulative shares, clip points, thresholds and stretches of values.

Values are counted by level first (a pre-aggregated shuffle); windows then run over levels only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ordered(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)


def counts(df: DataFrame, value: str, background: float | None = 0) -> DataFrame:
    """(level, n) of each value but the background."""
    rows = df.where(F.col(value).isNotNull())
    rows = rows if background is None else rows.where(F.col(value) != background)
    return rows.groupBy(F.col(value).alias("level")).agg(F.count("*").alias("n"))


def step_histogram(df: DataFrame, value: str, step: float) -> DataFrame:
    """(bin, n, zeros): bins of ``step`` from the least value on; the largest value is in the last one."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    last = F.ceil((F.col("b") - F.col("a") + step - 1) / step)
    bin_ = F.when(F.col(value) == F.col("b"), last).otherwise(F.floor((F.col(value) - F.col("a")) / step))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col(value) == 0).alias("zeros"))


def cdf(df: DataFrame, value: str, background: float | None = 0) -> DataFrame:
    """(level, n, share): the share of values at this level or below."""
    c = counts(df, value, background)
    return c.withColumn("share", F.sum("n").over(_ordered()) / F.sum("n").over(Window.partitionBy()))


def clip_points(df: DataFrame, value: str, percent: float, background: float | None = 0) -> DataFrame:
    """One row (low, high): the levels whose cumulative shares are nearest to percent and to 100 - percent; ties: the smaller."""
    near = lambda p: F.min(F.struct(F.abs(F.col("share") - p), "level"))["level"]
    return cdf(df, value, background).agg(near(percent / 100).alias("low"), near(1 - percent / 100).alias("high"))


def linear_stretch(value: Column, low: Column, high: Column, to_low: float = 1, to_high: float = 255) -> Column:
    return F.when(value <= low, to_low).when(value >= high, to_high).otherwise(to_low + (to_high - to_low) * 1.0 * (value - low) / (high - low))


def otsu(df: DataFrame, value: str) -> DataFrame:
    """One row (threshold): the level of the largest variance between what is at or below it and what is above; ties: the smallest."""
    c = counts(df, value, None).crossJoin(F.broadcast(df.agg(F.count(value).alias("total"), F.sum(value).alias("mass"))))
    c = c.withColumn("so_far", F.sum("n").over(_ordered())).withColumn("w0", F.sum("n").over(_ordered()) / F.col("total")).withColumn("m0", F.sum(F.col("n") * F.col("level")).over(_ordered()) / F.col("total"))
    w1 = 1 - F.col("w0")
    gap = F.col("m0") / F.col("w0") - F.try_divide(F.col("mass") / F.col("total") - F.col("m0"), w1)
    ranked = c.where(F.col("so_far") < F.col("total")).withColumn("between", F.round(F.col("w0") * w1 * gap * gap, 9))
    return ranked.agg(F.max(F.struct("between", -F.col("level")))["between"].alias("between"), (-F.max(F.struct("between", (-F.col("level")).alias("m")))["m"]).alias("threshold"))


def match(df: DataFrame, value: str, reference: DataFrame, reference_value: str) -> DataFrame:
    """(level, matched): for each level the reference level of the nearest cumulative share; ties: the smaller.

    Levels of both tables are put in one order of shares, in which the reference's nearest are the last before and the first behind: no pairs are made.
    """
    none = lambda t: F.lit(None).cast(t)
    kinds = dict(df.dtypes)[value], dict(reference.dtypes)[reference_value]
    a = cdf(df, value).select(F.col("level").cast(kinds[0]).alias("level"), "share", none(kinds[1]).alias("r"))
    b = cdf(reference, reference_value).select(none(kinds[0]).alias("level"), "share", F.col("level").cast(kinds[1]).alias("r"))
    known = F.when(F.col("r").isNotNull(), F.struct("share", "r"))
    order = Window.orderBy("share", F.col("r").isNull())
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first(known, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = a.unionByName(b).select("level", "share", F.array_compact(F.array(before, behind)).alias("near")).where(F.col("level").isNotNull())
    nearest = F.array_min(F.transform("near", lambda x: F.struct(F.round(F.abs(F.col("share") - x["share"]), 12).alias("d"), x["r"].alias("r"))))
    return both.select("level", nearest["r"].alias("matched"))


def std_stretch(df: DataFrame, value: str, out: str, sigmas: float = 2) -> DataFrame:
    """Clipped to the mean and two deviations, over the range between them."""
    s = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    low, high = F.col("_m") - sigmas * F.col("_s"), F.col("_m") + sigmas * F.col("_s")
    return df.crossJoin(F.broadcast(s)).withColumn(out, F.least(F.greatest(F.col(value), low), high) / (high - low)).drop("_m", "_s")


def min_max_stretch(df: DataFrame, value: str, reference: DataFrame, reference_value: str, out: str) -> DataFrame:
    """Stretched linearly to the range of the reference, truncated."""
    a = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    b = reference.agg(F.min(reference_value).alias("_c"), F.max(reference_value).alias("_d"))
    x = F.col("_c") + (F.col("_d") - F.col("_c")) * ((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")))
    return df.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).withColumn(out, F.floor(x)).drop("_a", "_b", "_c", "_d")


def statistics_match(df: DataFrame, value: str, reference: str, out: str) -> DataFrame:
    """``value`` times a gain plus a bias, so that mean and deviation are those of ``reference``."""
    s = df.agg(F.avg(value).alias("_m1"), F.stddev_pop(value).alias("_s1"), F.avg(reference).alias("_m3"), F.stddev_pop(reference).alias("_s3"))
    gain = F.col("_s3") / F.col("_s1")
    return df.crossJoin(F.broadcast(s)).withColumn(out, F.col(value) * gain + F.col("_m3") - gain * F.col("_m1")).drop("_m1", "_s1", "_m3", "_s3")
