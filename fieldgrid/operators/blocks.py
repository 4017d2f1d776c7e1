"""All pairs of vectors of two sides, reduced in blocks: a task holds a block of each, and only what it reduces to leaves it."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .tables import written

#: Vectors of a block.
BLOCK = 1024
#: Vectors of a block where only the nearest are kept.
NEAR_BLOCK = 4096


def _dealt(left: DataFrame, right: DataFrame, group: str, row: str, vector: str, block: int) -> DataFrame:
    """Both sides (group, id, v), each row once for each block of the other side of its group."""
    sides = []
    for side, df in (("l", left), ("r", right)):
        sides.append(df.select(F.col(group).alias("g"), F.col(row).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"), F.lit(side).alias("side")))
    both = sides[0].unionByName(sides[1])
    n = both.groupBy("g").agg(*[F.ceil(F.count_if(F.col("side") == s) / block).cast("int").alias(s) for s in "lr"])  # a row for each group
    sized = both.join(n, "g").where("l > 0 AND r > 0")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == "l", F.col("l")).otherwise(F.col("r"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == "l", F.col("r")).otherwise(F.col("l")) - 1))
    placed = sized.withColumn("own", own).withColumn("other", other)
    is_left = F.col("side") == "l"
    return placed.select("g", F.when(is_left, F.col("own")).otherwise(F.col("other")).alias("bl"), F.when(is_left, F.col("other")).otherwise(F.col("own")).alias("br"), "side", "id", "v")


def _two_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance to 9 places) of the two rows of ``y`` nearest to each row of ``x``, nearest first; ties: the first.

    Products tell squared distances but for rounding; those that may be among the two least by this are measured as they are.
    """
    k, out = min(2, len(y)), []
    with np.errstate(invalid="ignore", over="ignore"):
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        error = 1e-12 * (xx + yy[np.isfinite(yy)].max(initial=0.0))  # far above what products of this size lose
        for at in range(0, len(x), 256):
            here = slice(at, at + 256)
            square = xx[here, None] + yy - 2 * (x[here] @ y.T)
            square[np.isnan(square)] = np.inf
            least = np.partition(square, k - 1, axis=1)[:, k - 1]
            most = (np.sqrt(np.maximum(least + error[here], 0)) + 2e-9) ** 2 + error[here]
            i, j = np.nonzero(~(square > most[:, None]))
            i += at
            d = np.empty(len(i))
            for a in range(0, len(i), 65536):
                apart = x[i[a : a + 65536]] - y[j[a : a + 65536]]
                d[a : a + 65536] = np.sqrt(np.einsum("ij,ij->i", apart, apart)).round(9)
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.searchsorted(i, i)  # where a row's own begin
            kept = np.arange(len(i)) - first < k
            out.append((i[kept], j[kept], d[kept]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def two_nearest(left: DataFrame, right: DataFrame, row: str, vector: str, block: int = NEAR_BLOCK) -> DataFrame:
    """(side, id, other, d, rank): of each vector the two nearest of the other side, rank 1 and 2; ties: the smaller id; d to 9 places."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        both = [pdf[pdf["side"] == s].sort_values("id") for s in "lr"]
        if not all(map(len, both)):
            return pd.DataFrame({"side": [], "id": [], "other": [], "d": []})
        ids, vectors, out = [p["id"].to_numpy() for p in both], [np.stack(p["v"].to_numpy()) for p in both], []
        for side, one, other in (("l", 0, 1), ("r", 1, 0)):
            i, j, d = _two_of(vectors[one], vectors[other])
            out.append(pd.DataFrame({"side": side, "id": ids[one][i], "other": ids[other][j], "d": d}))
        return pd.concat(out)

    one = lambda df: df.withColumn("_g", F.lit(0))
    kind = dict(left.dtypes)[row]
    found = _dealt(one(left), one(right), "_g", row, vector, block).groupBy("bl", "br").applyInPandas(best, f"side string, id {kind}, other {kind}, d double")
    first = F.min(F.struct("d", "other"))
    two = found.groupBy("side", "id").agg(first.alias("m"), F.count("*").alias("n"))
    met = found.join(two, ["side", "id"])
    second = met.where((F.col("other") != F.col("m.other"))).groupBy("side", "id").agg(F.min(F.struct("d", "other")).alias("s"))
    ranked = two.select("side", "id", F.col("m.other").alias("other"), F.col("m.d").alias("d"), F.lit(1).alias("rank"))
    return ranked.unionByName(second.select("side", "id", F.col("s.other").alias("other"), F.col("s.d").alias("d"), F.lit(2).alias("rank")))


def distance_sums(points: DataFrame, group: str, row: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(group, row, cost): the sum of each point's distances to all points of its group.

    Blocks are rows, and pairs of blocks stream through tasks: a task holds one pair and the sums of one block, and no
    vector is shuffled or sorted more than once. Work grows with the square of a group.
    """
    kinds = dict(points.dtypes)
    plain = points.select(F.col(group).alias("g"), F.col(row).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    n = plain.groupBy("g").agg(F.ceil(F.count("*") / block).alias("n"))  # a row for each group
    dealt = plain.join(n, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "b": pdf["b"].iloc[:1], "ids": [pdf["id"].to_numpy()], "v": [np.stack(pdf["v"].to_numpy()).tobytes()]})

    blocks = written(dealt.groupBy("g", "b").applyInPandas(packed, f"g {kinds[group]}, b long, ids array<{kinds[row]}>, v binary"))
    parts = max(1, blocks.count() // 8, min(4, blocks.count()))
    one = blocks.repartition(parts, "g", "b")
    other = blocks.repartition(parts, "g", "b").select(F.col("g").alias("h"), F.col("v").alias("w"))
    # Not an equality, which would bring a group to one task.
    met = one.join(other, (F.col("g") <= F.col("h")) & (F.col("g") >= F.col("h"))).select("g", "b", "ids", "v", "w")

    def sums(rows: Iterator[Row]) -> Iterator[tuple]:
        for (g, _), pairs in itertools.groupby(rows, lambda r: (r["g"], r["b"])):
            x = cost = None
            for r in pairs:
                if x is None:
                    ids, x = r["ids"], np.frombuffer(r["v"]).reshape(len(r["ids"]), -1)
                    cost = np.zeros(len(ids))
                y = np.frombuffer(r["w"]).reshape(-1, x.shape[1])
                for at in range(0, len(x), 64):
                    d = x[at : at + 64, None, :] - y[None, :, :]
                    cost[at : at + 64] += np.sqrt(np.einsum("ijk,ijk->ij", d, d)).sum(axis=1)
            yield from zip(itertools.repeat(g), ids, cost.tolist())

    part = points.sparkSession.createDataFrame(met.rdd.mapPartitions(sums), f"g {kinds[group]}, id {kinds[row]}, cost double", verifySchema=False)
    return part.groupBy(F.col("g").alias(group), F.col("id").alias(row)).agg(F.sum("cost").alias("cost"))
