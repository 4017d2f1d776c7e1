"""Decision trees by exhaustive splits, all trees of a forest at once, grown until pure.

Each row keeps its node in every tree and, in a forest, a Poisson weight of each tree from a hash of the row. A level of all
trees is one round: weights are counted by tree, node, feature, value and label; running counts over the values, in two steps (parts of a
feature's range, then values in a part, so no task orders all values of a node), give every split's score. Rows of a node
that agree in a tree's features and the label count as one of their summed weight; nodes of few such rows are finished in one
job at the end, a group of bounded size each, as the levels of a tree that peels off a few rows at a time are many. The driver
holds the trees only.

A split sends values at or above its threshold to the right. Its score is the sum over both sides of squared counts of
labels by size, in doubles that are exact for up to some 100 000 rows; ties: the first feature, then the smallest
threshold. A node is split while it has ``least`` (weighted) rows, several labels, and a split that lowers its Gini index.
Leaves vote; ties: the smallest label. Rows with a null feature or label are left out.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import written

#: Different rows of a node that is finished in one task, and these times its labels.
SMALL = 200_000
MOST_CELLS = 4_000_000
#: Parts of a feature's range.
RANGES = 1024
#: Nodes of all trees that may be sent to every task.
MOST_NODES = 2_000_000

Node = tuple[int, "str | None", "float | None", "int | None", "int | None", "int | None"]


def _weight(row: Column, tree: int, seed: int) -> Column:
    """A Poisson variate of mean one from a hash."""
    u = F.shiftrightunsigned(F.xxhash64(row, F.lit(tree), F.lit(seed)), 11) / float(1 << 53)
    bounds, term, total = [], math.exp(-1), 0.0
    for k in range(1, 16):
        total += term
        term /= k
        bounds.append(total)
    return sum(((u >= b).cast("int") for b in bounds), F.lit(0))


def _running(df: DataFrame, by: Sequence[str], order: str, part: str, values: Sequence[str]) -> DataFrame:
    """``df`` with the sums of ``values`` of what comes before a row in its group, as _before_value; ``part`` rises with ``order``."""
    sums = df.groupBy(*by, part).agg(*(F.sum(v).alias(v) for v in values))
    earlier, own = (Window.partitionBy(*by, *more).orderBy(at).rowsBetween(Window.unboundedPreceding, -1) for more, at in (((), part), ((part,), order)))
    before = lambda v, w: F.coalesce(F.sum(v).over(w), F.lit(0))
    parts = sums.select(*by, part, *(before(v, earlier).alias(f"_p_{v}") for v in values))
    rows = df.select("*", *(before(v, own).alias(f"_o_{v}") for v in values)).join(parts, [*by, part])
    return rows.select(*df.columns, *((F.col(f"_p_{v}") + F.col(f"_o_{v}")).alias(f"_before_{v}") for v in values))


def _best_splits(rows: DataFrame, votes: DataFrame, nodes: DataFrame, features: Sequence[str], chosen: list[list[int]]) -> DataFrame:
    """(tree, node, feature, threshold) of the best split of each of ``nodes`` (tree, node, n, squares), if it lowers the Gini index."""
    ends = rows.agg(*(f(F.col("_x")[k]).alias(f"{f.__name__}{k}") for k in range(len(features)) for f in (F.min, F.max))).first()
    low, wide = (F.array(*(F.lit(float(v)) for v in c)) for c in zip(*((ends[f"min{k}"], (ends[f"max{k}"] - ends[f"min{k}"]) or 1.0) for k in range(len(features))), strict=True))
    used = F.array(*(F.array(*map(F.lit, c)) for c in chosen))
    long = _by_tree(rows).join(F.broadcast(nodes.select("tree", "node")), ["tree", "node"]).select("tree", "node", "_y", "_w", F.posexplode("_x").alias("f", "v")).where(F.array_contains(F.get(used, F.col("tree")), F.col("f")))
    n = long.groupBy("tree", "node", "f", "v", "_y").agg(F.sum("_w").cast("long").alias("c")).withColumn("_part", F.floor((F.col("v") - F.get(low, F.col("f"))) / F.get(wide, F.col("f")) * RANGES).cast("int"))
    left = _running(n, ["tree", "node", "f", "_y"], "v", "_part", ["c"]).join(F.broadcast(votes.select("tree", "node", "_y", F.col("n").alias("_total"))), ["tree", "node", "_y"])
    square, c, was = F.col("c") * F.col("c"), F.col("c"), F.col("_before_c")
    moved = left.withColumns({"_dl": 2 * was * c + square, "_dr": square - 2 * (F.col("_total") - was) * c})
    levels = moved.groupBy("tree", "node", "f", "v", "_part").agg(*(F.sum(k).alias(k) for k in ("c", "_dl", "_dr")))
    at = _running(levels, ["tree", "node", "f"], "v", "_part", ["c", "_dl", "_dr"]).join(F.broadcast(nodes), ["tree", "node"])
    l, r = F.col("_before_c").cast("double"), (F.col("n") - F.col("_before_c")).cast("double")  # noqa: E741
    score = (F.col("_before__dl") * r + (F.col("squares") + F.col("_before__dr")) * l) / (l * r)
    tried = at.where((F.col("_before_c") > 0) & (F.col("_before_c") < F.col("n"))).withColumn("score", score).where(F.col("score") > F.col("squares").cast("double") / F.col("n"))
    return tried.groupBy("tree", "node").agg(F.min(F.struct((-F.col("score")).alias("s"), "f", "v")).alias("b")).select("tree", "node", "b.f", "b.v")


def _by_tree(rows: DataFrame) -> DataFrame:
    """(tree, node, _y, _w, _x) of rows in nodes that aren't leaves."""
    each = rows.select("_x", "_y", F.posexplode(F.arrays_zip("_at", "_w")).alias("tree", "a")).select("tree", F.col("a._at").alias("node"), "_y", F.col("a._w").alias("_w"), "_x")
    return each.where((F.col("node") >= 0) & (F.col("_w") > 0))


def _different(rows: DataFrame, nodes: DataFrame, chosen: list[list[int]]) -> DataFrame:
    """(tree, node, _x, _y, _w) of rows in some nodes, alike ones as one: _x holds the tree's features only, _w sums weights."""
    used = F.array(*(F.array(*map(F.lit, c)) for c in chosen))
    mine = _by_tree(rows).join(F.broadcast(nodes), ["tree", "node"]).withColumn("_x", F.transform(F.get(used, F.col("tree")), lambda f: F.get("_x", f)))
    return mine.groupBy("tree", "node", "_x", "_y").agg(F.sum("_w").alias("_w"))


def _subtree(x: np.ndarray, y: np.ndarray, w: np.ndarray, chosen: Sequence[int], depth: int | None, least: int) -> list[tuple]:
    """(number, feature, threshold, left, right, label) of a node's subtree, the node being 0."""
    names, code = np.unique(y, return_inverse=True)
    out: list[tuple] = []
    todo, count = [(0, np.arange(len(y)), depth)], 1
    while todo:
        number, rows, deep = todo.pop()
        votes = np.bincount(code[rows], weights=w[rows], minlength=len(names)).astype(np.int64)
        n, squares, best = int(votes.sum()), float((votes * votes).sum()), None
        if (votes > 0).sum() > 1 and n >= least and (deep is None or deep > 0):
            for f in chosen:
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v = x[order, f]
                at = np.flatnonzero(v[1:] > v[:-1])
                if not len(at):
                    continue
                one = np.zeros((len(order), len(names)), np.int64)
                one[np.arange(len(order)), code[order]] = w[order]
                before = one.cumsum(axis=0)[at]
                after = votes - before
                l, r = before.sum(1).astype(float), after.sum(1).astype(float)  # noqa: E741
                score = ((before * before).sum(1) * r + (after * after).sum(1) * l) / (l * r)
                k = int(np.argmax(score))
                if score[k] > squares / n and (best is None or score[k] > best[0]):
                    best = score[k], f, v[at[k] + 1]
        if best is None:
            out.append((number, None, None, None, None, names.tolist()[int(np.argmax(votes))]))
            continue
        _, f, t = best
        right = x[rows, f] >= t
        out.append((number, f, float(t), count, count + 1, None))
        todo += [(count, rows[~right], deep and deep - 1), (count + 1, rows[right], deep and deep - 1)]
        count += 2
    return out


def grow(samples: DataFrame, features: Sequence[str], label: str, trees: int = 1, *, bootstrap: bool = False, subset: int | None = None, depth: int | None = None, least: int = 2, seed: int = 42, small: int = SMALL) -> list[list[Node]]:
    """Trees as lists of nodes (number, feature, threshold, left, right, label), the root being 0.

    ``bootstrap``: each tree has Poisson weights of its own; ``subset``: so many features a tree; ``depth``: None for none.
    """
    features = list(features)
    chosen = [sorted(random.Random(seed + k).sample(range(len(features)), subset)) if subset else list(range(len(features))) for k in range(trees)]
    row = F.xxhash64(*samples.columns)
    weights = F.array(*(_weight(row, k, seed) if bootstrap else F.lit(1) for k in range(trees)))
    rows = samples.dropna(subset=[*features, label]).select(F.array(*(F.col(f).cast("double") for f in features)).alias("_x"), F.col(label).alias("_y"), weights.alias("_w"), F.array_repeat(F.lit(0), trees).alias("_at"))
    rows, spark = written(rows), samples.sparkSession
    forest: list[dict[int, Node]] = [{} for _ in range(trees)]
    free, finish, level = [1] * trees, set(), 0
    open_ = {(k, 0) for k in range(trees)}
    while open_:
        here = spark.createDataFrame(sorted(open_), "tree int, node int")
        votes = written(_different(rows, here, chosen).groupBy("tree", "node", "_y").agg(F.sum("_w").alias("n"), F.count("*").alias("rows")))
        of_node = votes.groupBy("tree", "node").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("labels"), F.min(F.struct((-F.col("n")).alias("m"), F.col("_y").alias("y")))["y"].alias("top"))
        split = []
        for r in of_node.collect():  # a row for each node of the level that is large, or has just left one
            key = r["tree"], r["node"]
            if r["labels"] == 1 or r["n"] < least or level == depth:
                forest[key[0]][key[1]] = (key[1], None, None, None, None, r["top"])
            elif r["rows"] <= small and r["rows"] * r["labels"] <= MOST_CELLS:
                finish.add((*key, level))
            else:
                split.append((*key, r["n"], r["squares"], r["top"]))
        open_ = set()
        if split:
            nodes = spark.createDataFrame([s[:4] for s in split], "tree int, node int, n long, squares long")
            best = {(b["tree"], b["node"]): (b["f"], b["v"]) for b in _best_splits(rows, votes, nodes, features, chosen).collect()}
            for k, node, _, _, top in split:
                if (k, node) not in best:
                    forest[k][node] = (node, None, None, None, None, top)
                    continue
                f, v = best[k, node]
                forest[k][node] = (node, features[f], v, free[k], free[k] + 1, None)
                open_ |= {(k, free[k]), (k, free[k] + 1)}
                free[k] += 2
            rows = written(rows.withColumn("_at", _descended(spark, rows, [[forest[k][n] for k2, n in best if k2 == k] for k in range(trees)], features)))
        level += 1
    if finish:
        small_ones = spark.createDataFrame([(k, n) for k, n, _ in sorted(finish)], "tree int, node int")
        levels = {(k, n): lv for k, n, lv in finish}
        kind = rows.schema["_y"].dataType.simpleString()

        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            one = pdf.iloc[0]
            k, root = int(one["tree"]), int(one["node"])
            found = _subtree(np.stack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy(), pdf["_w"].to_numpy(), range(len(chosen[k])), None if depth is None else depth - levels[k, root], least)
            return pd.DataFrame([(k, root, n, None if f is None else chosen[k][f], *rest) for n, f, *rest in found], columns=["tree", "root", "number", "f", "v", "lo", "hi", "y"]).astype({"f": "Int64", "lo": "Int64", "hi": "Int64"})

        grouped = _different(rows, small_ones, chosen).groupBy("tree", "node").applyInPandas(done, f"tree int, root int, number int, f int, v double, lo int, hi int, y {kind}")
        parts: dict[tuple[int, int], list] = {}
        for r in grouped.collect():  # the nodes of the trees
            parts.setdefault((r["tree"], r["root"]), []).append(r)
        for (k, root), found in sorted(parts.items()):
            first = free[k] - 1
            at = lambda n, root=root, first=first: root if n == 0 else first + n
            for r in found:
                leaf = r["f"] is None
                forest[k][at(r["number"])] = (at(r["number"]), None, None, None, None, r["y"]) if leaf else (at(r["number"]), features[r["f"]], r["v"], at(r["lo"]), at(r["hi"]), None)
            free[k] += len(found) - 1
    return [[tree[n] for n in sorted(tree)] for tree in forest]


def _as_arrays(trees: Sequence[Sequence[Node]], features: Sequence[str], code: dict) -> list[tuple[np.ndarray, ...]]:
    """Each tree as arrays by number of node: feature (-1 in leaves and where there is no node), threshold, left, right, label's code."""
    if sum(map(len, trees)) > MOST_NODES:
        raise ValueError(f"over {MOST_NODES} nodes")
    out, index = [], {f: k for k, f in enumerate(features)}
    for tree in trees:
        size = max((n[0] for n in tree), default=0) + 1
        f, v, lo, hi, y = np.full(size, -1, np.int32), np.zeros(size), np.zeros(size, np.int32), np.zeros(size, np.int32), np.full(size, -1, np.int32)
        for n, feature, threshold, left, right, label in tree:
            if feature is None:
                y[n] = code[label]
            else:
                f[n], v[n], lo[n], hi[n] = index[feature], float(threshold), left, right
        out.append((f, v, lo, hi, y))
    return out


def _leaves(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The code of the label that a tree gives each row of ``x``."""
    f, v, lo, hi, y = tree
    at, going = np.zeros(len(x), np.int32), np.arange(len(x))
    while len(going := going[f[at[going]] >= 0]):
        node = at[going]
        value = x[going, f[node]]
        at[going] = np.where((value >= v[node]) | np.isnan(value), hi[node], lo[node])
    return y[at]


def _descended(spark, rows: DataFrame, splits: list[list[Node]], features: Sequence[str]) -> Column:  # noqa: ANN001
    """Each row's nodes after the splits of a level. The splits are a constant: one part of a plan, of bounded number."""
    constant = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")
    index, moved = {f: k for k, f in enumerate(features)}, []
    for k, own in enumerate(splits):
        at = F.get("_at", F.lit(k))
        place = F.array_position(constant([n[0] for n in own], "int"), at) - 1
        f, v, lo, hi = (constant(c, t) for c, t in (([index[n[1]] for n in own], "int"), ([float(n[2]) for n in own], "double"), ([n[3] for n in own], "int"), ([n[4] for n in own], "int")))
        moved.append(F.when(place < 0, at).when(F.get("_x", F.get(f, place)) >= F.get(v, place), F.get(hi, place)).otherwise(F.get(lo, place)) if own else at)
    return F.array(*moved)


def predict(df: DataFrame, trees: Sequence[Sequence[Node]], out: str = "predicted") -> DataFrame:
    """``df`` with what most trees say; ties: the smallest label. A null feature goes left. No shuffle.

    Trees are sent to each executor once, as arrays of a checked number of nodes; rows walk down them a batch at a time.
    """
    features = sorted({n[1] for t in trees for n in t if n[1] is not None})
    labels = sorted({n[5] for t in trees for n in t if n[1] is None})
    kind = "string" if labels and isinstance(labels[0], str) else "int"
    sent = df.sparkSession.sparkContext.broadcast(_as_arrays(trees, features, {y: k for k, y in enumerate(labels)}))

    def vote(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        said = np.column_stack([_leaves(x, tree) for tree in sent.value])
        best, most = np.full(len(x), -1), np.zeros(len(x), int)
        for own in said.T:
            n = (said == own[:, None]).sum(1)
            better = (own >= 0) & ((n > most) | ((n == most) & (own < best)))
            best, most = np.where(better, own, best), np.where(better, n, most)
        return pd.Series([labels[k] if k >= 0 else None for k in best.tolist()], dtype=object)

    x = [F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))) for f in features] or [F.lit(0.0)]
    return df.withColumn(out, F.pandas_udf(vote, kind)(*x) if trees else F.lit(None).cast(kind))
