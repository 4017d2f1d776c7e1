"""Registry of queries, and views of the driver's tables as pixels and series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: part as a raster of 50 columns: pixels with bands, a class and a value. The same view in SQL.
PIXELS_SQL = """px AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, CAST(p_size AS BIGINT) AS v, p_partkey % 7 AS zone, p_partkey % 5 AS cls,
  CAST(p_size * 20 + 100 AS BIGINT) AS blue, p_partkey * 37 % 1500 + 200 AS green, p_partkey * 53 % 1800 + 150 AS red, p_partkey * 71 % 4000 + 500 AS nir,
  p_partkey * 61 % 2500 + 300 AS re1, p_partkey * 67 % 3000 + 400 AS re2, p_partkey * 73 % 3500 + 450 AS re3, p_partkey * 79 % 3800 + 480 AS re4 FROM part)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    bands = {"green": (37, 1500, 200), "red": (53, 1800, 150), "nir": (71, 4000, 500), "re1": (61, 2500, 300), "re2": (67, 3000, 400), "re3": (73, 3500, 450), "re4": (79, 3800, 480)}
    return table(spark, sf_dir, "part").select(
        F.floor(k / 50).alias("row"), (k % 50).alias("col"), F.col("p_size").cast("long").alias("v"), (k % 7).alias("zone"), (k % 5).alias("cls"),
        (F.col("p_size") * 20 + 100).cast("long").alias("blue"), *[(k * a % b + c).alias(n) for n, (a, b, c) in bands.items()],
    )


#: events with epoch seconds.
EVENTS_SQL = "ev AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
