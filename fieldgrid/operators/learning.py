"""Trees, clusters and spectral matching, as aggregates where a step is one; models come from the ML library."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from . import forests
from .blocks import distance_sums, two_nearest
from .medoids import medoids as least_members
from .medoids import sampled
from .tables import written


def gini(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("gini"))


def entropy(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return n.agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def best_splits(df: DataFrame, label: str, feature: str, value: str) -> DataFrame:
    """(feature, threshold, gain): for each feature the split (``>=`` to the right) of the largest drop in Gini index; ties: the smallest.

    ``df`` is long. Labels are counted by level first; running counts then go over the levels of a feature.
    """
    n = df.groupBy(feature, value, label).agg(F.count("*").alias("n"))
    levels = n.groupBy(feature, value).agg(F.sum("n").alias("here"))
    classes = n.groupBy(feature, label).agg(F.sum("n").alias("total"))
    grid = levels.join(classes, feature).join(n, [feature, value, label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = Window.partitionBy(feature, label).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    left = grid.withColumn("left", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = left.groupBy(feature, value).agg(F.sum("left").alias("l"), F.sum("total").alias("t"), F.sum(F.col("left") * F.col("left")).alias("l2"), F.sum((F.col("total") - F.col("left")) * (F.col("total") - F.col("left"))).alias("r2"), F.sum(F.col("total") * F.col("total")).alias("t2"))
    r = F.col("t") - F.col("l")
    impurity = lambda squares, size: 1 - squares / (size * size)
    gain = impurity(F.col("t2"), F.col("t")) - F.col("l") / F.col("t") * impurity(F.col("l2"), F.col("l")) - r / F.col("t") * impurity(F.col("r2"), r)
    tried = sums.where((F.col("l") > 0) & (r > 0)).withColumn("gain", F.round(gain, 9))
    return tried.groupBy(feature).agg(F.max(F.struct("gain", (-F.col(value)).alias("m"))).alias("_m")).select(feature, (-F.col("_m.m")).alias("threshold"), F.col("_m.gain").alias("gain"))


def majority_vote(votes: DataFrame, row: str, label: str) -> DataFrame:
    """(row, label): the label most trees vote for; ties: the smallest."""
    n = votes.groupBy(row, label).agg(F.count("*").alias("n"))
    return n.groupBy(row).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("v")))["v"].alias(label))


def spectral_probability(spectrum: Column, reference: Column) -> Column:
    """Cosine times one less the distance over the root of the number of bands."""
    cosine = F.try_divide(scalar.dot(spectrum, reference), F.sqrt(scalar.dot(spectrum, spectrum)) * F.sqrt(scalar.dot(reference, reference)))
    return cosine * (1 - scalar.euclidean(spectrum, reference) / F.sqrt(F.size(spectrum)))


def class_means(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, mean): the mean vector of each class."""
    long = df.select(label, F.posexplode(vector).alias("i", "v")).groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return long.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("_s")).select(label, F.col("_s.m").alias("mean"))


def _least_of(df: DataFrame, candidates: DataFrame, cost: Callable[[Column], Column], tie: str) -> DataFrame:
    """``df`` with ``_m``: the (cost, tie) of the candidate of the least cost. All candidates are one row, of bounded number, so no row is copied or shuffled."""
    one = candidates.agg(F.collect_list(F.struct(*candidates.columns)).alias("_all"))
    best = F.array_min(F.transform("_all", lambda c: F.struct(cost(c).alias("cost"), c[tie].alias("tie"))))
    return df.crossJoin(F.broadcast(one)).where(F.size("_all") > 0).withColumn("_m", best)


def best_class(df: DataFrame, row: str, vector: str, means: DataFrame, label: str) -> DataFrame:
    """(row, best, probability): the class of the most probable spectrum; ties: the smallest. Means are one row a class."""
    each = _least_of(df, means, lambda c: -F.round(spectral_probability(F.col(vector), c["mean"]), 6), label)
    return each.select(row, F.col("_m.tie").alias("best"), (-F.col("_m.cost")).alias("probability"))


def assign_medoids(points: DataFrame, medoids: DataFrame, row: str, vector: str) -> DataFrame:
    """(row, medoid, cost): the nearest medoid (medoid, centre); ties: the smallest. Medoids are k rows."""
    each = _least_of(points, medoids, lambda c: F.round(scalar.euclidean(F.col(vector), c["centre"]), 9), "medoid")
    return each.select(row, F.col("_m.tie").alias("medoid"), F.col("_m.cost").alias("cost"))


def pam(points: DataFrame, row: str, vector: str, k: int, rounds: int = 100) -> DataFrame:
    """(row, medoid, cost) after k-medoids; starts from the k smallest rows.

    In each round every member of a cluster may become its medoid, until none is better: bounds of all members' sums of
    distances leave few whose sums are made (``operators.medoids``). The driver holds the k medoids, some thousand vectors
    and what bounds need; clusters with vectors that are not finite go pair by pair. Costs are compared to 9 places; ties: the smallest row.
    """
    medoids = points.orderBy(row).limit(k).select(F.col(row).alias("medoid"), F.col(vector).alias("centre")).collect()
    schema = points.select(F.col(row).alias("medoid"), F.col(vector).alias("centre")).schema
    table = lambda: points.sparkSession.createDataFrame([(m, list(v)) for m, v in medoids], schema)
    plain, sample = points.select(F.col(row).alias("row"), F.col(vector).alias("v")), sampled(points, row, vector, k)
    before = None
    while medoids and rounds and before != [m for m, _ in medoids]:
        before, rounds = [m for m, _ in medoids], rounds - 1
        found, left = least_members(plain, [v for _, v in medoids], sample)
        now = list(found.values())
        if left:
            own = points.join(assign_medoids(points, table(), row, vector).where(F.col("medoid").isin([before[g] for g in left])).select(row, "medoid"), row)
            costs = distance_sums(own, "medoid", row, vector).withColumn("cost", F.round("cost", 9))
            best = costs.groupBy("medoid").agg(F.min(F.struct("cost", row))[row].alias(row)).select(row)
            now += points.join(F.broadcast(best), row).select(row, vector).collect()
        medoids = sorted((tuple(m) for m in now), key=lambda m: m[0])
    return assign_medoids(points, table(), row, vector)


def ratio_matches(left: DataFrame, right: DataFrame, row: str, vector: str, ratio: float = 0.7) -> DataFrame:
    """(left, right): pairs that are each other's nearest, each nearer than ``ratio`` times its second nearest.

    Distances of blocks of both sides are reduced in their tasks to each vector's two nearest.
    """
    near = written(two_nearest(left, right, row, vector))
    second = near.where("rank = 2").select("side", "id", F.col("d").alias("_second"))
    sure = near.where("rank = 1").join(second, ["side", "id"]).where(F.col("d") < ratio * F.col("_second"))
    one = sure.where("side = 'l'").select(F.col("id").alias("left"), F.col("other").alias("right"))
    two = sure.where("side = 'r'").select(F.col("other").alias("left"), F.col("id").alias("right"))
    return one.join(two, ["left", "right"])


def cart(samples: DataFrame, features: Sequence[str], label: str, depth: int | None = None, least: int = 2) -> list[forests.Node]:
    """A decision tree by exhaustive splits, grown until its leaves are pure (or ``depth``), as nodes; see ``operators.forests``."""
    return forests.grow(samples, features, label, depth=depth, least=least)[0]


def cart_forest(samples: DataFrame, features: Sequence[str], label: str, trees: int = 10, depth: int | None = None, seed: int = 42) -> list[list[forests.Node]]:
    """Trees of ``cart``, all grown at once, each on Poisson weights of its own and floor(log2 f) + 1 of the features."""
    return forests.grow(samples, features, label, trees, bootstrap=True, subset=int(math.log2(len(features))) + 1, depth=depth, seed=seed)


def random_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 10, seed: int = 42):  # noqa: ANN201
    """A fitted random forest on log2 of the features for each tree."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    forest = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, featureSubsetStrategy="log2", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), forest]).fit(df)


def k_means(df: DataFrame, features: Sequence[str], k: int, seed: int = 42):  # noqa: ANN201
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), KMeans(featuresCol="_features", k=k, seed=seed)]).fit(df)


def tree_predict(df: DataFrame, nodes: list[tuple[int, str | None, float | None, int | None, int | None, int | None]], root: int = 0) -> Column:
    """The result of a decision tree given as rows (node, feature, threshold, left, right, result): ``>=`` goes right."""
    by_id = {n[0]: n for n in nodes}

    def at(k: int) -> Column:
        _, feature, threshold, left, right, result = by_id[k]
        return F.lit(result) if feature is None else F.when(F.col(feature) >= threshold, at(right)).otherwise(at(left))

    return at(root)


def calinski_harabasz(df: DataFrame, label: str, vector: str) -> DataFrame:
    """One row (score): between-cluster over within-cluster dispersion, by degrees of freedom."""
    long = df.select(label, F.posexplode(vector).alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    by = long.groupBy(label, "i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
    of = by.groupBy("i").agg(F.sum("s").alias("S"), F.sum("n").alias("N"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("q").alias("q"), F.count("*").alias("k"))
    sums = of.agg(F.sum(F.col("b") - F.col("S") * F.col("S") / F.col("N")).alias("between"), F.sum(F.col("q") - F.col("b")).alias("within"), F.max("N").alias("n"), F.max("k").alias("k"))
    return sums.select((F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))).alias("score"))


def forest_regressor(df: DataFrame, features: Sequence[str], target: str, trees: int = 10, least: int = 100, seed: int = 42):  # noqa: ANN201
    """A fitted regression forest whose leaves hold ``least`` rows or more."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    forest = RandomForestRegressor(featuresCol="_features", labelCol=target, numTrees=trees, minInstancesPerNode=least, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), forest]).fit(df)


def perceptron(df: DataFrame, features: Sequence[str], label: str, hidden: int, classes: int, steps: int = 50, seed: int = 42):  # noqa: ANN201
    """A fitted perceptron with one hidden layer."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    net = MultilayerPerceptronClassifier(featuresCol="_scaled", labelCol=label, layers=[len(features), hidden, classes], maxIter=steps, seed=seed)
    stages = [VectorAssembler(inputCols=list(features), outputCol="_features"), StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True), net]
    return Pipeline(stages=stages).fit(df)
