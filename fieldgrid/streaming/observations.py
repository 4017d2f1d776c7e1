"""Observations as streams: deduplicated, aggregated in event time, upserted, cut into runs of a state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.relational import upsert

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def observations(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, delay: str = "2 hours") -> DataFrame:
    """A stream of the files of a folder, or of what a path pattern matches, with a watermark on ``ts``."""
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def unseen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Observations whose keys have not come before within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def daily(stream: DataFrame, by: str) -> DataFrame:
    return stream.groupBy(F.window("ts", "1 day").alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))


def moving(stream: DataFrame, by: str, length: str = "8 hours", step: str = "1 hour") -> DataFrame:
    return stream.groupBy(F.window("ts", length, step).alias("w"), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


class StateRuns(StatefulProcessor):
    """Runs of one state of each key, in event time.

    Rows wait in the state until the watermark has passed them, as rows of later batches may still come before; then they
    join runs in order of time. A run is emitted when a later row has another state. A key has one timer to wait for, at
    its earliest waiting row or, if that comes first, at its run's last row plus ``idle``: it takes all rows that the
    watermark has passed at once, closes the run if it has passed that, and is then set anew, until the key's state ends.
    Rows behind the watermark are late and left out.
    """

    def __init__(self, idle: float) -> None:
        self.idle = round(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "state string, start long, last long, n long")
        self.waiting = handle.getListState("waiting", "ms long, event_id long, state string")
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, ms: int) -> None:
        """A timer at a time, unless an earlier one is set."""
        if not self.due.exists() or ms < self.due.get()[0]:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        came = []
        for batch in rows:
            ids = [None if pd.isna(i) else int(i) for i in batch["event_id"]]
            came += [(ms, i, s) for ms, i, s in zip(batch["ms"].tolist(), ids, batch["event_type"].tolist(), strict=True) if ms >= passed]
        if came:
            self.waiting.appendList(came)
            self._wake(min(ms for ms, _, _ in came) + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = timerValues.getCurrentWatermarkInMs()  # what lies behind it is final, whichever timer came first
        waiting = list(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        due = sorted((w for w in waiting if w[0] < at), key=_order)
        now = list(self.run.get()) if self.run.exists() else None
        out = []
        for ms, _, state in due:
            if now and (now[0] != state or ms > now[2] + self.idle):
                out.append(now)
                now = None
            now = [state, now[1], ms, now[3] + 1] if now else [state, ms, ms, 1]
        if due:
            later = [w for w in waiting if w[0] >= at]
            self.waiting.put(later) if later else self.waiting.clear()
        else:
            later = waiting
        if now and now[2] + self.idle < at:
            out.append(now)
            now = None
        self.run.update(tuple(now)) if now else self.run.clear()
        self.due.clear()
        if now or later:
            self._wake(min([w[0] + 1 for w in later] + ([now[2] + self.idle + 1] if now else [])))
        if out:
            yield pd.DataFrame([(key[0], state, start // 1000, last // 1000, n) for state, start, last, n in out], columns=["user_id", "state", "start", "last", "n"])

    def close(self) -> None:
        pass


def _order(row: tuple) -> tuple:
    """By time, then id, nulls first, then state."""
    return row[0], row[1] is not None, row[1] or 0, row[2] or ""


def state_runs(stream: DataFrame, idle: float = 86_400.0) -> DataFrame:
    """Runs of ``event_type`` of each user that another state or ``idle`` seconds without a row have ended: (user_id, state, start, last, n), times as epoch seconds.

    The stream has a watermark on ``ts``. Needs the state store provider of ``session.STATE_STORE``, which sessions made by
    ``session.session`` have.
    """
    rows = stream.where(F.col("ts").isNotNull()).select("user_id", "event_id", "event_type", F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(StateRuns(idle), "user_id long, state string, start long, last long, n long", "Append", "EventTime")


_LOG = "_generations"


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_into`` keeps at a path: of each bucket its newest generation."""
    whole = spark.read.parquet(path)
    newest = whole.groupBy("bucket").agg(F.max("generation").alias("generation"))  # a row for each bucket
    return whole.join(F.broadcast(newest), ["bucket", "generation"]).drop("bucket", "generation")


def upsert_into(stream: DataFrame, path: str, keys: list[str], version: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """A stream merged into a Parquet table, the last version of each key; ``latest`` reads it.

    Keys are dealt to buckets by hash. A batch writes a new generation of the buckets that it touches, and reads these only.
    Generations are numbered for the table: a batch takes the next number and notes it, with its checkpoint's and its own,
    in the table's folder before it writes, so a batch that runs again writes the same generation anew, and streams of
    other checkpoints merge into the same table, one at a time. Of each bucket the newest two generations are kept: one to read, and
    the one that a batch that runs again starts from. Rows of equal keys and versions: the one whose other columns are the largest.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        best = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, F.to_json(F.struct(*sorted(rest))))).alias("_m")).select(*keys, *(f"_m.{c}" for c in rest))
        new = best.select(*batch.columns).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        new = new.persist()
        try:
            touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # bucket numbers
            if not touched:
                return
            generation = _generation(spark, path, checkpoint, number)
            stored, newest = new.limit(0), {}
            if generation and _exists(spark, path):
                before = spark.read.parquet(path).where(F.col("bucket").isin(touched) & (F.col("generation") < generation))
                newest = {r["bucket"]: r["generation"] for r in before.groupBy("bucket").agg(F.max("generation").alias("generation")).collect()}
                kept = F.coalesce(*(F.when(F.col("bucket") == b, F.col("generation") == g) for b, g in newest.items()), F.lit(False))
                stored = before.where(kept).select(*new.columns)
            merged = upsert(stored, new, keys, version).withColumn("generation", F.lit(generation))
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "generation").parquet(path)
            for bucket, g in newest.items():
                _drop_older(spark, f"{path}/bucket={bucket}", g)
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str) -> tuple:
    """A path of the table's file system, and that."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at a path."""
    folder, fs = _folder(spark, path)
    return fs.exists(folder) and any(f.getPath().getName().startswith("bucket=") for f in fs.listStatus(folder))


def _generation(spark: SparkSession, path: str, checkpoint: str, number: int) -> int:
    """The number of a batch's generation: noted if it has run before, else the next one of the table."""
    log, fs = _folder(spark, f"{path}/{_LOG}")
    fs.mkdirs(log)
    batch = f"{hashlib.sha256(checkpoint.rstrip('/').encode()).hexdigest()[:32]}-{number}"
    noted = [f.getPath().getName().split("-", 1) for f in fs.listStatus(log)]
    for g, name in noted:
        if name == batch:
            return int(g)
    generation = max((int(g) for g, _ in noted), default=-1) + 1
    fs.mkdirs(_folder(spark, f"{path}/{_LOG}/{generation}-{batch}")[0])
    return generation


def _drop_older(spark: SparkSession, path: str, generation: int) -> None:
    """Remove a bucket's generations before one."""
    folder, fs = _folder(spark, path)
    for f in fs.listStatus(folder):
        if int(f.getPath().getName().removeprefix("generation=")) < generation:
            fs.delete(f.getPath(), True)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is available now to Parquet, and stop; a later call goes on from the checkpoint."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
