"""Joins, lookups, upserts and reshaping of attribute tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar

#: Cells that a polygon spans along its longer axis, but for one.
SPAN = 4


def bbox(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether a point is in a closed rectangle."""
    return x.between(x0, x1) & y.between(y0, y1)


def first_match(left: DataFrame, right: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``left`` with the first row of ``right`` of the same key; rows without a match stay.

    The right side is reduced to a row for each key by a pre-aggregated minimum, so no key gathers its rows.
    """
    rest = [c for c in right.columns if c != key]
    first = right.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_m"))
    return left.join(first, key, "left").select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in rest])


def upsert(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of both, for each key that with the largest version; of equal ones the fresh row."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_m"))
    return last.select(*[F.col(f"_m.{c}").alias(c) if c in rest else F.col(c) for c in stored.columns])


def unseen(fresh: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fresh.join(stored.select(*keys), list(keys), "left_anti")


def nearest_in_time(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, value: str, bucket_seconds: int) -> DataFrame:
    """For each left row the right ``value`` of the same ``by`` nearest in time, within ``bucket_seconds``; ties: the earlier.

    An as-of join as an equi-join: the left row looks into its own time bucket and the two beside it, which hold all
    right rows within reach; a pre-aggregated minimum picks the nearest. Times are epoch seconds.
    """
    r = right.select(*by, F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.floor(F.col(right_time) / bucket_seconds).alias("_b"))
    around = F.explode(F.array(*[F.floor(F.col(left_time) / bucket_seconds) + d for d in (-1, 0, 1)])).alias("_b")
    pairs = left.select("*", around).join(r, [*by, "_b"]).where(F.abs(F.col(left_time) - F.col("_t")) <= bucket_seconds)
    near = pairs.groupBy(*left.columns).agg(F.min(F.struct(F.abs(F.col(left_time) - F.col("_t")).alias("gap"), F.col("_t").alias("time"), F.col("_v").alias("value"))).alias("_m"))
    return near.select(*left.columns, "_m.gap", "_m.time", "_m.value")


def pivot_last(df: DataFrame, row: str, column: str, values: Sequence, value: str, order: str) -> DataFrame:
    """Rows by ``row``, a column for each of ``values``, the last value by ``order`` in each cell."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.max_by(value, order))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], part: Column, out: str) -> DataFrame:
    """Numbers from 0 in each group by ``order``, which must rise with ``part``.

    Parts are counted and summed up first, then each is numbered by itself: no task orders all rows of a group.
    """
    parted = df.withColumn("_part", part)
    n = parted.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    n = n.withColumn("_before", F.coalesce(earlier, F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return parted.withColumn("_rank", rank).join(n, [*by, "_part"]).withColumn(out, F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")


def balance(samples: DataFrame, label: str, order: Sequence[str], part: Column) -> DataFrame:
    """Each class repeated, in order, up to the size of the largest. ``part`` rises with the order (see ``numbered``)."""
    n = samples.groupBy(label).agg(F.count("*").alias("_n"))
    n = n.crossJoin(n.agg(F.max("_n").alias("_top")))  # a row for each class
    copies = F.explode(F.sequence(F.lit(0), F.ceil(F.col("_top") / F.col("_n")).cast("int") - 1)).alias("copy")
    rows = numbered(samples, [label], order, part, "_i").join(F.broadcast(n), label).select("*", copies)
    return rows.where(F.col("_i") + F.col("copy") * F.col("_n") < F.col("_top")).drop("_i", "_n", "_top")


def points_in_boxes(points: DataFrame, polygons: DataFrame, cell: float, x: str = "x", y: str = "y", xs: str = "xs", ys: str = "ys") -> DataFrame:
    """Pairs of points and the polygons whose bounds hold them.

    An equi-join on grid cells. A polygon's cells are ``cell`` times a power of two wide, so that it meets a few of them
    however large it is; a point is in one cell of each width that occurs. The driver sees the widths' powers only.
    """
    bounds = {"_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)}
    longest = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(longest / (cell * SPAN)))).cast("int")
    q = polygons.withColumns(bounds).withColumn("_level", level)
    at = lambda v: F.floor(v / (cell * F.pow(F.lit(2.0), F.col("_level"))))
    cells = lambda a, b: F.explode(F.sequence(at(F.col(a)), at(F.col(b))))
    levels = sorted(q.agg(F.collect_set("_level")).first()[0]) or [0]
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels))) if len(levels) > 1 else F.lit(levels[0]))
    p = p.withColumns({"_cx": at(F.col(x)), "_cy": at(F.col(y))})
    q = q.withColumn("_cx", cells("_x0", "_x1")).withColumn("_cy", cells("_y0", "_y1"))
    met = p.join(q, ["_level", "_cx", "_cy"]).where(F.col(x).between(F.col("_x0"), F.col("_x1")) & F.col(y).between(F.col("_y0"), F.col("_y1")))
    return met.drop("_level", "_cx", "_cy", *bounds)


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of points and the polygons (``xs``, ``ys``: closed rings) that hold them: bounds first, then the exact test."""
    return points_in_boxes(points, polygons, cell, x, y).where(scalar.in_ring(F.col(x), F.col(y), F.col("xs"), F.col("ys")))


def within_distance(points: DataFrame, centres: DataFrame, reach: float, x: str = "x", y: str = "y", cx: str = "cx", cy: str = "cy") -> DataFrame:
    """Pairs of points and centres at a distance of ``reach`` or less, by an equi-join on cells of that size."""
    p = points.withColumn("_gx", F.floor(F.col(x) / reach)).withColumn("_gy", F.floor(F.col(y) / reach))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    c = centres.withColumn("_s", F.explode(steps)).withColumn("_gx", F.floor(F.col(cx) / reach) + F.col("_s.i")).withColumn("_gy", F.floor(F.col(cy) / reach) + F.col("_s.j"))
    near = (F.col(x) - F.col(cx)) * (F.col(x) - F.col(cx)) + (F.col(y) - F.col(cy)) * (F.col(y) - F.col(cy)) <= reach * reach
    return p.join(c, ["_gx", "_gy"]).where(near).drop("_gx", "_gy", "_s")


def overlapping(boxes: DataFrame, other: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (x0, y0, x1, y1) of two tables (second: ox0 ...) that overlap, and their common box.

    A box's own cells are ``cell`` times a power of two wide, so that it meets a few of them however large it is; it is also in
    the wider cells that occur. Two boxes meet in cells of the wider of their two widths, and there in the one that
    holds the lower left corner of their intersection, so each pair is found once. The driver sees the widths' powers only.
    """
    level = lambda x0, y0, x1, y1: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0), F.lit(cell)) / (cell * SPAN)))).cast("int")
    own = {"_own": ("x0", "y0", "x1", "y1"), "_oown": ("ox0", "oy0", "ox1", "oy1")}
    a, b = (df.withColumn(n, level(*own[n])) for df, n in ((boxes, "_own"), (other, "_oown")))
    levels = sorted({r[0] for df, n in ((a, "_own"), (b, "_oown")) for r in df.select(n).distinct().collect() if r[0] is not None})
    width = cell * F.pow(F.lit(2.0), F.col("_level"))
    cells = lambda u, v: F.explode(F.sequence(F.floor(F.col(u) / width), F.floor(F.col(v) / width)))

    def dealt(df: DataFrame, n: str) -> DataFrame:
        x0, y0, x1, y1 = own[n]
        wider = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k >= F.col(n))
        return df.withColumn("_level", F.explode(wider)).withColumn("_cx", cells(x0, x1)).withColumn("_cy", cells(y0, y1))

    left, low = F.greatest("x0", "ox0"), F.greatest("y0", "oy0")
    meets = (F.col("x0") < F.col("ox1")) & (F.col("ox0") < F.col("x1")) & (F.col("y0") < F.col("oy1")) & (F.col("oy0") < F.col("y1"))
    once = (F.col("_level") == F.greatest("_own", "_oown")) & (F.floor(left / width) == F.col("_cx")) & (F.floor(low / width) == F.col("_cy"))
    common = {"ix0": left, "iy0": low, "ix1": F.least("x1", "ox1"), "iy1": F.least("y1", "oy1")}
    return dealt(a, "_own").join(dealt(b, "_oown"), ["_level", "_cx", "_cy"]).where(meets & once).withColumns(common).drop("_level", "_cx", "_cy", "_own", "_oown")
