"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams where no rule fits.

All of it is DataFrame functions. A URL's features are the distinct n-grams of its host and of its path, hashed to a fixed
number of places, each with the weight one over the root of their number, so every feature vector has length one. The
regression is fitted to a small labelled table of URLs by L-BFGS: Spark sums the loss and its gradient over that table in
one aggregation a step, the weights (a fixed number) stay on the driver. Scoring is one projection: the weights are a
constant array in it, so URLs are neither shuffled nor grouped and a hot host costs nothing extra.

Rules are a table (host, path, verdict). A rule fits its host and all subdomains if the URL's path starts with the rule's;
the longest rule (host and path together, then host) wins, of several verdicts for one rule the smallest. URLs meet them
by an equi-join for each number of labels that hosts of rules have; the rules of one host are one row.

Defined cases: a null URL, or one without ``://``, has an empty host and path; a URL with neither has the
score 0; rows that repeat are judged each; URLs of any length are read whole, in time in proportion; ports and user names are
part of the host; rules without a host fit nothing, a rule's null path is empty; labelled rows without URL or label are not
learnt from, and after an empty labelled table all other scores are 0.5; an empty table of pages gives no rows; extra columns stay,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, small

#: Places that n-grams are hashed to.
PLACES = 1 << 14
#: Labelled rows that are learnt from at most: those of the smallest hashes.
MOST_LABELLED = 20_000
#: Weight of half the squared length of the weights in the loss.
RIDGE = 1e-4
#: Length of the gradient at which the fit is done.
EXACT = 2e-3

# The small labelled table. Both classes have the same domains and kinds of paths, so hosts' words decide.
BAD_HOSTS = (
    "royal-casino jackpot-casino casino-bonus casino-games big-win win-now slots-jackpot poker-bonus lucky-poker live-bets sport-bets bets-now free-slots free-spins "
    "adult-cams adult-video adult-chat xxx-tube sexy-dates hot-xxx cheap-meds diet-pills pills-online cheap-viagra pharma-pills spam-links link-spam spam-mail "
    "link-farm ads-click ads-server click-track track-pixel banner-ads pop-ads"
).split()
GOOD_HOSTS = (
    "weather news library history museum physics garden recipes travel school university science mathematics theatre nature "
    "thinking teaching nations station another leather northern tonight things election fishing other the-times the-river shipping "
    "information translation education reading writing health sports music cinema market forest railway harbour village city letters "
    "free-software open-track adults-learning linking farmers cheaper-travel winter spinning"
).split()
_DOMAINS = ("example.com", "example.net", "example.org")
_PREFIXES = ("", "www.", "m.", "blog.")
_PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/{}", "/")
BAD_WORDS, GOOD_WORDS = ("casino", "bonus", "xxx", "pills", "bets"), ("article", "guide", "notes", "index", "about")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label); label 1: block."""
    rows = []
    for label, hosts, words in ((1, BAD_HOSTS, BAD_WORDS), (0, GOOD_HOSTS, GOOD_WORDS)):
        for k, host in enumerate(hosts):
            for j in range(3):
                place = _PATHS[(k + j) % len(_PATHS)].format(37 * k % 991 if j else words[k % len(words)])
                rows.append((f"https://{_PREFIXES[(k + j) % 4]}{host}.{_DOMAINS[(k + j) % 3]}{place}", label))
    return spark.createDataFrame(rows, "url string, label int")


# URLs.


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next slash, question mark or hash sign, A to Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark or hash sign."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _grams(text: Column, tag: str) -> list[Column]:
    """Arrays of the places of the 3-, 4- and 5-grams of a text between marks.

    Characters are shifted against each other and zipped, so each n-gram is read from one element.
    """
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    shifted = F.arrays_zip(*(F.slice(chars, k + 1, F.size(chars)).alias(str(k)) for k in range(5)))

    def of_length(n: int) -> Column:
        place = lambda z: F.pmod(F.xxhash64(F.lit(tag), *(z[str(k)] for k in range(n))), F.lit(PLACES)).cast("int")
        return F.transform(shifted, lambda z: F.when(z[str(n - 1)].isNotNull(), place(z)))

    return [of_length(n) for n in (3, 4, 5)]


def features(host: Column, path: Column) -> Column:
    """The distinct places of the n-grams of a URL."""
    return F.array_compact(F.array_distinct(F.concat(*_grams(host, "host"), *_grams(path, "path"))))


# The regression.


class Model(NamedTuple):
    intercept: float
    weights: list[float]


def _constant(values: list, kind: str = "double") -> Column:
    """An array as one constant; its text is read once, when the plan is made."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _share(places: Column) -> Column:
    """The weight of each of a URL's features."""
    return 1 / F.sqrt(F.greatest(F.size(places), F.lit(1)))


def _margin(places: Column, model: Model) -> Column:
    weights = _constant(model.weights)
    total = F.aggregate(places, F.lit(0.0), lambda sum_, p: sum_ + F.get(weights, p))
    return F.lit(model.intercept) + total * _share(places)


def probability(host: Column, path: Column, model: Model) -> Column:
    """The regression's probability that a URL is to be blocked; 0 without features."""
    places = features(host, path)
    return F.when(F.size(places) > 0, 1 / (1 + F.exp(-_margin(places, model)))).otherwise(0.0)


def fit(labelled: DataFrame, *, most: int = MOST_LABELLED, ridge: float = RIDGE, steps: int = 60, exact: float = EXACT) -> Model:
    """The weights of the least mean logistic loss plus ``ridge`` times half their squared length (the intercept is free).

    Places that no labelled URL has keep the weight zero and are left out of the steps.
    """
    usable = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select("url", F.col("label").cast("double").alias("label"))
    bounded = usable.orderBy(F.xxhash64("url"), "url", "label").limit(most)
    rows = cut(bounded.select(features(host_of(F.col("url")), path_of(F.col("url"))).alias("places"), "label"))
    n = rows.count()
    if not n:
        return Model(0.0, [0.0] * PLACES)
    seen = sorted(r.place for r in rows.select(F.explode("places").alias("place")).distinct().collect())
    number = [-1] * PLACES
    for k, place in enumerate(seen):
        number[place] = k
    to_number = _constant(number, "int")
    rows = cut(rows.withColumn("places", F.transform("places", lambda p: F.get(to_number, p))))

    def loss(x: list[float]) -> tuple[float, list[float]]:
        """At x (weights of seen places, then the intercept): the loss and its gradient, each part a row of one aggregation."""
        m = F.col("margin")
        off = (1 / (1 + F.exp(-m)) - F.col("label")) / n
        cost = (F.greatest(m, F.lit(0.0)) - m * F.col("label") + F.log1p(F.exp(-F.abs(m)))) / n
        shares = F.concat(
            F.array(F.struct(F.lit(-1).alias("place"), F.col("cost").alias("share")), F.struct(F.lit(len(seen)).alias("place"), F.col("off").alias("share"))),
            F.transform("places", lambda p: F.struct(p.alias("place"), F.col("slope").alias("share"))),
        )
        at = rows.coalesce(1).withColumn("margin", _margin(F.col("places"), Model(x[-1], x[:-1]))).withColumns({"off": off, "cost": cost, "slope": off * _share(F.col("places"))})
        sums = dict(map(tuple, at.select(F.inline(shares)).groupBy("place").agg(F.sum("share")).collect()))
        gradient = [ridge * w for w in x[:-1]] + [0.0]
        total = ridge / 2 * sum(w * w for w in x[:-1]) + sums.pop(-1)
        for place, share in sums.items():
            gradient[place] += share
        return total, gradient

    best = minimum(loss, [0.0] * (len(seen) + 1), steps, exact)
    weights = [0.0] * PLACES
    for place, w in zip(seen, best, strict=False):
        weights[place] = round(w, 9)
    return Model(round(best[-1], 9), weights)


def minimum(loss: Callable[[list[float]], tuple[float, list[float]]], x: list[float], steps: int, exact: float, memory: int = 6) -> list[float]:
    """L-BFGS with halved steps: where the gradient is ``exact`` small, or after ``steps`` evaluations."""
    dot = lambda a, b: math.fsum(p * q for p, q in zip(a, b, strict=True))
    value, slope = loss(x)
    seen: list[tuple[list[float], list[float], float]] = []
    used = 1
    while used < steps and math.sqrt(dot(slope, slope)) > exact:
        d, marks = [-g for g in slope], []
        for s, y, r in reversed(seen):
            a = r * dot(s, d)
            marks.append(a)
            d = [p - a * q for p, q in zip(d, y, strict=True)]
        if seen:
            s, y, _ = seen[-1]
            scale = dot(s, y) / dot(y, y)
            d = [p * scale for p in d]
        else:
            d = [4 * p for p in d]
        for (s, y, r), a in zip(seen, reversed(marks), strict=True):
            b = r * dot(y, d)
            d = [p + (a - b) * q for p, q in zip(d, s, strict=True)]
        length, fall = 1.0, dot(slope, d)
        while True:
            there = [p + length * q for p, q in zip(x, d, strict=True)]
            new, new_slope = loss(there)
            used += 1
            if new <= value + 1e-4 * length * fall or used >= steps:
                break
            length /= 2
        if new > value:
            break
        s, y = [p - q for p, q in zip(there, x, strict=True)], [p - q for p, q in zip(new_slope, slope, strict=True)]
        if (c := dot(s, y)) > 1e-18:
            seen = [*seen[1 - memory :], (s, y, 1 / c)]
        x, value, slope = there, new, new_slope
    return x


# Rules and verdicts.


def with_rule(urls: DataFrame, rules: DataFrame, host: str, path: str, out: str) -> DataFrame:
    """``urls`` with a column ``out``: struct<rule, verdict> of the longest rule that fits, or null.

    A join for each number of labels in rules' hosts, no more than the deepest of them has; rows are kept as they are.
    """
    plain = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    each = plain.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    row = F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), "path", F.concat("host", "path").alias("rule"), "verdict")
    hosts = cut(each.groupBy("host").agg(F.collect_list(row).alias("of_host")).withColumn("depth", F.size(F.split("host", r"\."))))
    depths = sorted(r.depth for r in hosts.select("depth").distinct().collect())
    key, met = fresh(urls, "host_end"), fresh(urls, "rules_met")
    found = urls
    for depth in depths:
        here = small(hosts.where(F.col("depth") == depth).select(F.col("host").alias(key), F.col("of_host").alias(f"{met}{depth}")))
        found = found.withColumn(key, F.substring_index(host, ".", -depth)).join(here, key, "left").drop(key)
    empty = F.lit(None).cast("struct<rule:string,verdict:string>")
    if not depths:
        return found.withColumn(out, empty)
    fits = [F.filter(F.coalesce(f"{met}{d}", F.array()), lambda r: F.startswith(F.col(path), r["path"])) for d in depths]
    best = F.array_max(F.concat(*fits))
    chosen = F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))
    return found.withColumn(out, chosen).drop(*(f"{met}{d}" for d in depths))


def with_verdict(pages: DataFrame, rules: DataFrame, model: Model, out: str = "judged", *, url: str = "url", block_at: float = 0.5) -> DataFrame:
    """``pages`` with a column ``out``: struct<host, path, rule, score, verdict>; score: the regression's, that it is to be blocked."""
    host, path, rule = (fresh(pages, n) for n in ("host", "path", "rule"))
    read = with_rule(pages.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url))), rules, host, path, rule)
    score = probability(F.col(host), F.col(path), model)
    verdict = F.coalesce(f"{rule}.verdict", F.when(F.col(out)["score"] >= block_at, "block").otherwise("allow"))
    parts = F.struct(F.col(host).alias("host"), F.col(path).alias("path"), F.col(f"{rule}.rule").alias("rule"), score.alias("score"))
    judged = read.withColumn(out, parts).withColumn(out, F.col(out).withField("verdict", verdict))
    return judged.drop(host, path, rule)
