"""Keyed merges into database tables: a staged table and one set-based statement in one transaction for each batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUOTE = '"'


@contextmanager
def _connection(spark: SparkSession, url: str, properties: dict[str, str]) -> Iterator[Any]:
    """A connection of the driver; what isn't committed is undone."""
    given = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        if k != "driver":
            given.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, given)
    connection.setAutoCommit(False)
    try:
        yield connection
    finally:
        connection.rollback()
        connection.close()


def _run(connection: Any, sql: str) -> int:
    statement = connection.createStatement()
    try:
        return statement.executeUpdate(sql)
    finally:
        statement.close()


def _has(connection: Any, name: str) -> bool:
    """Whether a query of the table works."""
    statement = connection.createStatement()
    try:
        statement.executeQuery(f"SELECT 1 FROM {name} WHERE 1 = 0").close()
        return True
    except Exception:  # noqa: BLE001 - the driver's errors for a missing table differ
        return False
    finally:
        statement.close()


def _applied(connection: Any, log: str, stream: str, batch: int) -> bool:
    statement = connection.prepareStatement(f"SELECT 1 FROM {log} WHERE stream_id = ? AND batch_id = ?")
    try:
        statement.setString(1, stream)
        statement.setLong(2, batch)
        found = statement.executeQuery()
        return found.next()
    finally:
        statement.close()


def merge_statement(name: str, staged: str, columns: Sequence[str], keys: Sequence[str], version: str) -> str:
    """One MERGE: rows of known keys are updated where the staged version is as new or newer, others are inserted."""
    q = lambda c: f"{QUOTE}{c}{QUOTE}"
    rest = [c for c in columns if c not in keys]
    on = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
    newer = f"(t.{q(version)} IS NULL OR s.{q(version)} >= t.{q(version)})"
    changes = ", ".join(f"{q(c)} = s.{q(c)}" for c in rest)
    return (
        f"MERGE INTO {name} AS t USING {staged} AS s ON {on} WHEN MATCHED AND {newer} THEN UPDATE SET {changes} "
        f"WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, columns))}) VALUES ({', '.join(f's.{q(c)}' for c in columns)})"
    )


def upsert_jdbc(fresh: DataFrame, url: str, name: str, keys: Sequence[str], version: str, properties: dict[str, str], stream: str | None = None, batch: int = 0) -> bool:
    """Merge rows into a database table, for each key the row of the largest version; of equal ones the fresh row. Whether it was done.

    Fresh rows are reduced to one a key and written by all tasks to a table of their own; one MERGE then touches the keys
    that they have, and no others are read or written. The merge and a note of (stream, batch) are one transaction: a failure leaves the table as
    it was, and a batch of a stream that has been noted is left out. Rows with a null key are left out. A table
    that isn't there is made. The database must know MERGE (SQL:2003).
    """
    spark = fresh.sparkSession
    rest = [c for c in fresh.columns if c not in keys]
    known = fresh.dropna(subset=list(keys))
    order = F.struct(F.col(version), F.to_json(F.struct(*sorted(rest))))
    one = known.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_m")).select(*keys, *(f"_m.{c}" for c in rest)).select(*fresh.columns)
    staged, log = f"{name}_s{uuid.uuid4().hex[:12]}", f"{name}_batches"
    with _connection(spark, url, properties) as connection:
        missing, unnoted = not _has(connection, name), not _has(connection, log)
        if stream is not None and not unnoted and _applied(connection, log, stream, batch):
            return False
    if missing:
        fresh.limit(0).write.jdbc(url, name, mode="append", properties=properties)
    one.write.jdbc(url, staged, mode="overwrite", properties=properties)
    try:
        with _connection(spark, url, properties) as connection:
            if stream is not None and unnoted:
                _run(connection, f"CREATE TABLE {log} (stream_id VARCHAR(200) NOT NULL, batch_id BIGINT NOT NULL, PRIMARY KEY (stream_id, batch_id))")
                connection.commit()
            _run(connection, merge_statement(name, staged, fresh.columns, keys, version))
            if stream is not None:
                note = connection.prepareStatement(f"INSERT INTO {log} VALUES (?, ?)")
                note.setString(1, stream)
                note.setLong(2, batch)
                note.executeUpdate()
                note.close()
            connection.commit()
    finally:
        with _connection(spark, url, properties) as connection:
            _run(connection, f"DROP TABLE {staged}")
            connection.commit()
    return True


def upsert_stream(stream: DataFrame, url: str, name: str, keys: Sequence[str], version: str, properties: dict[str, str], checkpoint: str) -> StreamingQuery:
    """A stream merged into a database table, a transaction a batch; batches that run again change nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        upsert_jdbc(batch, url, name, keys, version, properties, checkpoint[-200:], number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
