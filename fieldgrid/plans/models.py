"""Impurity, splits, spectra, clusters, matching, votes; models are rows-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as C
from ..operators import learning as L
from .registry import PIXELS_SQL, pixels, query, table


@query("WITH n AS (SELECT count(*) AS n FROM embeddings GROUP BY label) SELECT round(1 - sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE), 9) AS gini FROM n")
def gini(spark: SparkSession, sf: str) -> DataFrame:
    return L.gini(table(spark, sf, "embeddings"), "label").select(F.round("gini", 9).alias("gini"))


@query("WITH n AS (SELECT count(*) AS n FROM part GROUP BY p_brand), p AS (SELECT n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM n) SELECT round(-sum(p * log2(p)), 9) AS entropy FROM p")
def entropy_gain(spark: SparkSession, sf: str) -> DataFrame:
    return L.entropy(table(spark, sf, "part"), "p_brand").select(F.round("entropy", 9).alias("entropy"))


@query(f"""WITH {PIXELS_SQL}, f AS (SELECT cls, name, val FROM (UNPIVOT (SELECT cls, blue, green // 50 AS green FROM px) ON blue, green INTO NAME name VALUE val)), t AS (SELECT DISTINCT name, val FROM f),
  s AS (SELECT t.name, t.val, f.cls, count(*) AS n, count(*) FILTER (f.val < t.val) AS l FROM t JOIN f USING (name) GROUP BY 1, 2, 3),
  g AS (SELECT name, val, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(l) AS DOUBLE) AS l, CAST(sum(n * n) AS DOUBLE) AS n2, CAST(sum(l * l) AS DOUBLE) AS l2, CAST(sum((n - l) * (n - l)) AS DOUBLE) AS r2 FROM s GROUP BY 1, 2 HAVING sum(l) > 0),
  h AS (SELECT name, val, round((1 - n2 / (n * n)) - l / n * (1 - l2 / (l * l)) - (n - l) / n * (1 - r2 / ((n - l) * (n - l))), 9) AS gain FROM g) SELECT name, val AS threshold, gain FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY gain DESC, val) AS r FROM h) WHERE r = 1""")
def best_split(spark: SparkSession, sf: str) -> DataFrame:
    long = pixels(spark, sf).select("cls", "blue", F.floor(F.col("green") / 50).alias("green")).unpivot(["cls"], ["blue", "green"], "name", "val")
    return L.best_splits(long, "cls", "name", "val")


_EMB = "e AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i))"


@query(f"""WITH {_EMB}, m AS (SELECT label, i, avg(v) AS m FROM e GROUP BY 1, 2), p AS (SELECT e.vec_id, m.label, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))) * (1 - sqrt(sum((v - m) * (v - m))) / sqrt(64)), 6) AS p FROM e JOIN m USING (i) GROUP BY 1, 2)
  SELECT vec_id, label AS best, p AS probability FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS r FROM p) WHERE r = 1""")
def spectral_prob(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return L.best_class(e.select("vec_id", "embedding"), "vec_id", "embedding", L.class_means(e, "label", "embedding"), "label")


@query(f"""WITH {_EMB}, d AS (SELECT e.vec_id, m.vec_id AS medoid, round(sqrt(sum((e.v - m.v) * (e.v - m.v))), 6) AS cost FROM e JOIN e m USING (i) WHERE m.vec_id < 5 GROUP BY 1, 2) SELECT vec_id, medoid, cost FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, medoid) AS r FROM d) WHERE r = 1""")
def pam_assign(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    m = e.where("vec_id < 5").select(F.col("vec_id").alias("medoid"), F.col("embedding").alias("centre"))
    return L.assign_medoids(e, m, "vec_id", "embedding").withColumn("cost", F.round("cost", 6))


@query()
def pam(spark: SparkSession, sf: str) -> DataFrame:
    return L.pam(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 4)


@query(f"""WITH {_EMB}, a AS (SELECT * FROM e WHERE vec_id % 2 = 0), b AS (SELECT * FROM e WHERE vec_id % 2 = 1), d AS (SELECT a.vec_id AS l, b.vec_id AS r, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 9) AS d FROM a JOIN b USING (i) GROUP BY 1, 2),
  x AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, r) AS rl, row_number() OVER (PARTITION BY r ORDER BY d, l) AS rr FROM d), f AS (SELECT l, max(d) FILTER (rl = 1) AS d1, max(d) FILTER (rl = 2) AS d2, max(r) FILTER (rl = 1) AS r FROM x GROUP BY l), g AS (SELECT r, max(d) FILTER (rr = 1) AS d1, max(d) FILTER (rr = 2) AS d2, max(l) FILTER (rr = 1) AS l FROM x GROUP BY r)
  SELECT f.l AS "left", f.r AS "right" FROM f JOIN g ON f.l = g.l AND f.r = g.r WHERE f.d1 < 0.97 * f.d2 AND g.d1 < 0.97 * g.d2""")
def knn_ratio(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return L.ratio_matches(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "vec_id", "embedding", 0.97)


@query("WITH n AS (SELECT o_custkey, o_orderpriority AS vote, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, vote FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, vote) AS r FROM n) WHERE r = 1")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return L.majority_vote(table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("vote")), "o_custkey", "vote")


@query("SELECT event_id AS id, round(1 / (1 + exp(-(event_id % 60 / 10.0::DOUBLE))), 9) AS s, CAST(CASE WHEN event_id % 60 < 21 THEN factorial(CAST(event_id % 60 AS INTEGER)) END AS BIGINT) AS f, round(ln(event_id + 1) / ln(10), 9) AS lg FROM events")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id") % 60
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.round(C.sigmoid(i / 10), 9).alias("s"), F.when(i < 21, F.factorial(i.cast("int"))).alias("f"), F.round(F.log10(F.col("event_id") + 1), 9).alias("lg"))


@query("SELECT p_partkey AS n FROM part WHERE p_partkey > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 500) d(k) WHERE k * k <= p_partkey AND p_partkey % k = 0)")
def primes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of prime keys."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("n")).where(C.is_prime(F.col("n").cast("int")))


@query("SELECT CAST(sum(l_quantity + l_tax) AS DOUBLE) IS NOT NULL AS done, round(sum(l_quantity + l_extendedprice), 2) AS total FROM lineitem")
def vector_add(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.lit(True).alias("done"), F.round(F.sum(F.col("l_quantity") + F.col("l_extendedprice")), 2).alias("total"))


@query("""WITH RECURSIVE z AS (SELECT p_partkey AS id, -1.8::DOUBLE + p_partkey * 37 % 1000 * 3.6::DOUBLE / 1000 AS x, 1.8::DOUBLE - p_partkey * 91 % 997 * 3.6::DOUBLE / 997 AS y, 0 AS n FROM part
  UNION ALL SELECT id, x * x - y * y + -0.62772::DOUBLE, 2 * x * y + -0.42193::DOUBLE, n + 1 FROM z WHERE x * x + y * y < 4 AND n < 100) SELECT id, CAST(max(n) AS INTEGER) AS steps FROM z GROUP BY id""")
def julia(spark: SparkSession, sf: str) -> DataFrame:
    """Escape steps of a place for each part, a hundred at most."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("id"), (-1.8 + k * 37 % 1000 * 3.6 / 1000).alias("x"), (1.8 - k * 91 % 997 * 3.6 / 997).alias("y"))
    return p.select("id", C.julia_steps(F.col("x"), F.col("y"), -0.62772, -0.42193, 100).alias("steps"))


def drawn_pi(draws: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row (pi, n): four times the share of places in the unit square that lie within 1 of its corner."""
    return draws.select((x * x + y * y <= 1).alias("in")).agg((4 * F.count_if("in") / F.count("*")).alias("pi"), F.count("*").alias("n"))


@query("SELECT 4 * count(*) FILTER (x * x + y * y <= 1) / count(*)::DOUBLE AS pi, count(*) AS n FROM (SELECT o_orderkey * 48271 % 65537 / 65537.0::DOUBLE AS x, o_orderkey * 69621 % 65521 / 65521.0::DOUBLE AS y FROM orders)")
def monte_carlo_pi(spark: SparkSession, sf: str) -> DataFrame:
    """A place for each order, from remainders of its key."""
    k = F.col("o_orderkey")
    return drawn_pi(table(spark, sf, "orders"), k * 48271 % 65537 / 65537.0, k * 69621 % 65521 / 65521.0)


_FEATURES = ["blue", "green", "red", "nir"]


@query()
def kmeans(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf)
    return L.k_means(p, _FEATURES, 4).transform(p).select("row", "col", F.col("prediction").alias("cluster"))


@query()
def rf_predict(spark: SparkSession, sf: str) -> DataFrame:
    """A forest learnt on four fifths of the pixels, applied to the rest."""
    p = pixels(spark, sf).withColumn("cls", F.col("cls").cast("double")).withColumn("test", (F.col("row") * 50 + F.col("col")) * 7919 % 10 >= 8)
    model = L.random_forest(p.where("NOT test"), _FEATURES, "cls")
    return model.transform(p.where("test")).select("row", "col", "cls", "prediction")


@query()
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).sample(withReplacement=True, fraction=1.0, seed=7).select("row", "col", "cls")
