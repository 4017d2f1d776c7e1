"""Matching of images by points: correlation, affine models by consensus, soil lines by trimming.

The tables here are key points or levels of one scene; models travel to the points, counts come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import numbered as numbered_in_parts


def correlation(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, ncc): the absolute normalised cross-correlation of two windows in each group."""
    return df.groupBy(by).agg(F.abs(F.corr(a, b)).alias("ncc"))


def _affine_of(t: list[Column]) -> list[Column]:
    """Coefficients (a, b, c, d, e, f) of u = a x + b y + c, v = d x + e y + f through three matches (x, y, u, v)."""
    (x1, y1, u1, v1), (x2, y2, u2, v2), (x3, y3, u3, v3) = ([p[k] for k in ("x", "y", "u", "v")] for p in t)
    det = (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)
    out = []
    for w1, w2, w3 in ((u1, u2, u3), (v1, v2, v3)):
        a = F.try_divide((w2 - w1) * (y3 - y1) - (w3 - w1) * (y2 - y1), det)
        b = F.try_divide((x2 - x1) * (w3 - w1) - (x3 - x1) * (w2 - w1), det)
        out += [a, b, w1 - a * x1 - b * y1]
    return out


def consensus_affine(matches: DataFrame, tries: int, radius: float) -> DataFrame:
    """One row: the affine model through three matches (id, x, y, u, v) that most matches agree with; ties: the least error.

    ``tries`` triples are drawn by hash; models times matches are an aggregate, models are the broadcast side.
    """
    n = matches.count()
    numbered = matches.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(tries)))
    draw = lambda s: matches.sparkSession.range(tries).select(F.col("id").alias("try"), F.pmod(F.xxhash64("id", F.lit(s)), F.lit(n)).alias("at"))
    ranked = numbered_in_parts(numbered, [], ["k", "id"], F.col("k"), "at").select("at", F.struct("id", "x", "y", "u", "v").alias("p"))
    triple = draw(1).join(ranked, "at").select("try", F.col("p").alias("p1"))
    for s in (2, 3):
        triple = triple.join(draw(s).join(ranked, "at").select("try", F.col("p").alias(f"p{s}")), "try")
    names = list("abcdef")
    model = triple.select("try", *[c.alias(k) for k, c in zip(names, _affine_of([F.col("p1"), F.col("p2"), F.col("p3")]), strict=True)]).dropna()
    du = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") - F.col("u")
    dv = F.col("d") * F.col("x") + F.col("e") * F.col("y") + F.col("f") - F.col("v")
    each = matches.join(F.broadcast(model)).withColumn("e2", du * du + dv * dv)
    votes = each.groupBy("try", *names).agg(F.count_if(F.col("e2") <= radius * radius).alias("inliers"), F.sqrt(F.avg(F.when(F.col("e2") <= radius * radius, F.col("e2")))).alias("rmse"))
    return votes.orderBy(F.desc("inliers"), "rmse", "try").limit(1).select(*names, "inliers", "rmse")


def soil_line(df: DataFrame, red: str, nir: str, lowest: int = 10, parts: int = 8, rounds: int = 5) -> DataFrame:
    """One row (slope, intercept, n): a line through the lowest ``nir`` values of each level of ``red``, trimmed.

    In each round every part of the red range loses its point of the largest residual. Levels are counted first;
    the points are as many as levels times ``lowest``.
    """
    r = F.row_number().over(Window.partitionBy(red).orderBy(nir))
    points = df.groupBy(red, nir).agg(F.count("*").alias("_n")).withColumn("_r", r).where(F.col("_r") <= lowest).select(F.col(red).alias("x"), F.col(nir).alias("y"))
    ends = points.agg(F.min("x").alias("_a"), F.max("x").alias("_b"))
    points = points.crossJoin(F.broadcast(ends)).withColumn("part", F.floor((F.col("x") - F.col("_a")) * parts / (F.col("_b") - F.col("_a") + 1))).drop("_a", "_b")
    for _ in range(rounds):
        line = points.agg(F.regr_slope("y", "x").alias("_s"), F.regr_intercept("y", "x").alias("_i"))
        off = points.crossJoin(F.broadcast(line)).withColumn("_e", F.abs(F.col("y") - F.col("_i") - F.col("_s") * F.col("x")))
        worst = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("_e"), "x", "y"))
        points = off.withColumn("_w", worst).where((F.col("_w") > 1)).select("x", "y", "part")
    return points.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("n"))
