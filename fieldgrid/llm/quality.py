"""Quality classifier: Bradley-Terry pairwise ranking of documents by features of their whole text.

A labelled sample gives preference pairs (a document of label 1 is preferred to one of label 0). The weights
minimise the logistic loss on the pairs' feature differences, so ``w . features`` is a Bradley-Terry strength.
A quantile of the sample's strengths is the threshold; strengths are mapped to 0..1 so that it lies at ``cut_at``.

Defined cases: null or empty text has the features of an empty text and gets a score like any other; a null id
has no fold and isn't learnt from; null labels are left out; a document labelled more than once counts once, with
its largest label, and if its id repeats with other texts, the least of their features; texts of any length are read
whole; an empty table gives an empty one; without labels of both kinds the weights are zero and every score is 0.5; extra columns stay, but for one of the name of the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: At most so many labelled documents are learnt from: those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Partners of each document of the larger class.
PAIRS_EACH = 4

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "bang": b"!?",
    "mark": b"*$%&#@^~+=", "frame": b"|<>{}[]\\/_`", "stop": b".,;:", "quote": b"'\"()-", "high": range(128, 256),
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _codes in enumerate(_CLASSES.values()):
    _TABLE[list(_codes), _i] = 1
N_FEATURES = 23


def text_features(text: str | None) -> list[float]:
    """Shares of character classes, repetition of words and lines, and lengths of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    size = max(1, len(raw))
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / size
    upper, lower, digit, space, bang, mark, frame, stop, quote, high = share.tolist()
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = raw.split(b"\n")
    letters = max(1e-9, upper + lower + high)
    top = max(counts.values(), default=0) / n
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    root = math.sqrt
    return [
        math.log1p(len(raw)), math.log1p(len(words)), upper / letters, root(digit), space, root(bang), root(mark), root(frame), stop, root(quote), high,
        1.0 - lower - space, min(1.0, 20 * mark), min(1.0, 20 * bang), min(1.0, 20 * frame), min(40, (1 - space) * size / n) / 10, len(counts) / n, top, again,
        root(again), 1 - len(set(lines)) / len(lines), math.log1p(size / len(lines)), 1.0 if len(words) < 5 else 0.0,
    ]


def features_of(texts: pd.Series) -> np.ndarray:
    return np.array([text_features(t) for t in texts]).reshape(len(texts), N_FEATURES)


@dataclass(frozen=True)
class BradleyTerry:
    """Weights on standardised features, and the strength that is the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut_at: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        at = self.strength(x) - self.threshold
        out = 1 / (1 + np.exp(-np.clip(at + math.log(self.cut_at / (1 - self.cut_at)), -700, 700)))
        return np.where(at >= 0, np.maximum(out, self.cut_at), np.minimum(out, np.nextafter(self.cut_at, 0)))


def _pairs(feats: DataFrame) -> DataFrame:
    """A row for each preference pair: the features of the better document and of the worse.

    Documents of each class are numbered by hash; number i of the larger class meets PAIRS_EACH numbers of the
    smaller, by an equi-join, so that there are PAIRS_EACH times as many pairs as documents at most.
    """
    numbered = feats.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1)
    n = {r["label"]: r["n"] for r in numbered.groupBy("label").agg(F.count("*").alias("n")).collect()}
    big, small = (1, 0) if n.get(1, 0) >= n.get(0, 0) else (0, 1)
    many = numbered.where(F.col("label") == big).select("f", F.explode(F.sequence(F.lit(0), F.lit(PAIRS_EACH - 1))).alias("r"), "i")
    many = many.select("f", ((F.col("i") * PAIRS_EACH + F.col("r")) % max(1, n.get(small, 0))).alias("j"))
    few = numbered.where(F.col("label") == small).select(F.col("f").alias("g"), F.col("i").alias("j"))
    both = many.join(few, "j")
    return both.select(*((F.col("f").alias("better"), F.col("g").alias("worse")) if big else (F.col("g").alias("better"), F.col("f").alias("worse"))))


def fit(docs: DataFrame, labels: DataFrame, learn: str, *, label: str = "quality", cut_at: float = 0.3, max_labelled: int = MAX_LABELLED, ridge: float = 1e-3, steps: int = 8) -> BradleyTerry:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, <label>)`` where the condition ``learn`` on doc_id holds.

    The labelled sample is bounded by ``max_labelled``; its feature rows are made and paired on the executors, which
    also sum gradient and curvature of the loss. The driver sees those sums only.
    """
    chosen = labels.where(F.expr(learn) & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "f": list(features_of(b["text"]))})

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(featurise, "doc_id long, label int, f array<double>")
    feats = cut(sample.groupBy("doc_id", "label").agg(F.min("f").alias("f")))  # an id that repeats counts once
    stats = feats.select(F.posexplode("f").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("*").alias("n")).orderBy("k").collect()
    zero = np.zeros(N_FEATURES)
    if not stats:
        return BradleyTerry(zero, zero + 1, zero, 0.0, cut_at)
    mean, scale = np.array([r["m"] for r in stats]), np.array([r["s"] if r["s"] > 1e-9 else 1.0 for r in stats])
    pairs, w = cut(_pairs(feats)), zero
    d = N_FEATURES

    for _ in range(steps):

        def sums(batches: Iterator[pd.DataFrame], w=w) -> Iterator[pd.DataFrame]:
            grad, curve, n = np.zeros(d), np.zeros((d, d)), 0
            for b in batches:
                x = np.clip((np.stack(b["better"].to_numpy()) - mean) / scale, -6, 6) - np.clip((np.stack(b["worse"].to_numpy()) - mean) / scale, -6, 6)
                p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))
                grad, curve, n = grad + x.T @ p, curve + (x.T * (p * (1 - p))) @ x, n + len(b)
            yield pd.DataFrame({"s": [np.concatenate([[n], grad, curve.ravel()])]})

        total = np.sum([r["s"] for r in pairs.mapInPandas(sums, "s array<double>").collect()] or [np.zeros(1 + d + d * d)], axis=0)
        if not total[0]:
            return BradleyTerry(mean, scale, zero, 0.0, cut_at)
        step = np.linalg.solve(total[1 + d :].reshape(d, d) / total[0] + ridge * np.eye(d), total[1 : 1 + d] / total[0] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return BradleyTerry(mean, scale, w, _threshold(feats, BradleyTerry(mean, scale, w, 0.0, cut_at)), cut_at)


def _threshold(feats: DataFrame, model: BradleyTerry) -> float:
    """The quantile of the sample's strengths that parts the two labels best (largest balanced accuracy): sought in
    hundredths, then in fiftieths of a hundredth around the best of these."""

    def strengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s": model.strength(np.stack(b["f"].to_numpy())), "label": b["label"]})

    rated = feats.mapInPandas(strengths, "s double, label int")
    of_label = lambda k, holds: F.sum(((F.col("label") == k) & holds).cast("int")) / F.greatest(F.sum((F.col("label") == k).cast("int")), F.lit(1))

    def best(shares: list[float]) -> tuple[float, float]:
        at = rated.agg(F.percentile("s", F.array(*map(F.lit, shares))).alias("q")).first()["q"]
        grid = F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.array(*[F.lit(float(q)) for q in at]).alias("t"))).alias("c")
        tried = rated.select("s", "label", grid).select("s", "label", "c.share", "c.t").groupBy("share", "t")
        parted = tried.agg((of_label(1, F.col("s") >= F.col("t")) + of_label(0, F.col("s") < F.col("t"))).alias("right"))
        first = parted.orderBy(F.desc("right"), "share").first()
        return first["share"], first["t"]

    coarse, _ = best([q / 100 for q in range(1, 100)])
    at = best([round(coarse + k / 5000, 4) for k in range(-50, 51) if 0 < coarse + k / 5000 < 1])[1]
    below = rated.where(F.col("s") < at).agg(F.max("s").alias("s")).first()["s"]
    return at if below is None else (at + below) / 2  # in the middle of the gap


def with_score(docs: DataFrame, model: BradleyTerry, column: str = "quality_score") -> DataFrame:
    """``docs`` and the score of each whole text. One pass, no shuffle."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(features_of(texts)))

    return docs.withColumn(column, score(F.col("text")))
