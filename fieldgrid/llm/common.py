"""Helpers that the operators share: the shared folder, cut lineage, held-out folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all runs on one machine a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldgrid-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends there.

    A lost executor then costs a re-read of that table instead of the work above it.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot with more than this share of all rows, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
#: Rows of ids that may be broadcast; a larger table meets the other by a shuffle.
BROADCAST_ROWS = 1_000_000


def join_unique(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``unique``, which has each key once; rows of hot keys stay where they are.

    The values of hot keys, fewer than 1 / HOT_SHARE, are broadcast; only the other rows are shuffled.
    """
    most = HOT_SHARE * rows.count()
    hot = rows.groupBy(key).count().where(F.col("count") > max(most, 1000)).select(key)
    if hot.isEmpty():
        return rows.join(unique, key)
    hot = cut(unique.join(hot, key))
    few = F.broadcast(hot)
    cold = rows.join(few, key, "left_anti").join(unique.join(few, key, "left_anti"), key)
    return rows.join(few, key).unionByName(cold)


def small(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast if it has BROADCAST_ROWS rows or fewer."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name
