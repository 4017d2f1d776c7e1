"""Regular series, moving and cumulative windows, runs of a state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def daily_mean(hours: Column, value: Column) -> Column:
    """Mean of hours 2, 8, 14 and 20 if all are there, else of the extremes (an aggregate)."""
    at = [F.min(F.when(hours == h, value)) for h in (2, 8, 14, 20)]
    whole = at[0].isNotNull() & at[1].isNotNull() & at[2].isNotNull() & at[3].isNotNull()
    return F.when(whole, (at[0] + at[1] + at[2] + at[3]) / 4).otherwise((F.max(value) + F.min(value)) / 2)


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str, part: Column, digits: int = 3) -> DataFrame:
    """``df`` and the total so far in each group, rounded once. ``part`` (a day, say) rises with the order: parts are
    summed first, so no task orders all rows of a long series."""
    parted = df.withColumn("_part", part)
    sums = parted.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(earlier, F.lit(0.0))).drop("_sum")
    own = F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parted.withColumn("_own", own).join(sums, [*by, "_part"]).withColumn(out, F.round(F.col("_before") + F.col("_own"), digits)).drop("_part", "_own", "_before")


def moving_average(by: Sequence[str], order: Sequence[str], value: str, n: int) -> Column:
    """Sum of this and the next n - 1 rows over n: what is missing at the end counts as zero."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(0, n - 1)) / n


def since_last(by: Sequence[str], order: Sequence[str], column: str) -> Column:
    return F.col(column) - F.lag(column).over(Window.partitionBy(*by).orderBy(*order))


def state_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """``df`` and ``run``, which counts the changes of ``state`` so far in each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(1)
    return df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def regular(df: DataFrame, by: Sequence[str], slot: str, step: int, value: str, order: str) -> DataFrame:
    """A row for each multiple of ``step`` between a group's first and last slot: the last value by ``order``, or null."""
    last = df.groupBy(*by, slot).agg(F.max_by(value, order).alias(value))
    grid = df.groupBy(*by).agg(F.min(slot).alias("_a"), F.max(slot).alias("_b")).select(*by, F.explode(F.sequence("_a", "_b", F.lit(step).cast("long"))).alias(slot))
    return grid.join(last, [*by, slot], "left")


def interpolated(by: Sequence[str], at: str, value: str) -> Column:
    """``value``, or if it is null the linear interpolation between its neighbours in ``at``; null outside them."""
    w = Window.partitionBy(*by).orderBy(at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("x"), F.col(value).alias("y")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    between = a["y"] + (b["y"] - a["y"]) * F.try_divide((F.col(at) - a["x"]).cast("double"), (b["x"] - a["x"]).cast("double"))
    return F.coalesce(F.col(value), between)
