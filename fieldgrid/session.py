"""Sessions with the engine's settings; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Streams that keep state of their own need this provider.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def session(app: str = "fieldgrid", cores: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``cores``: a local one, with as many shuffle partitions."""
    b = SparkSession.builder.appName(app)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"} | dict([STATE_STORE])
    if cores:
        b = b.master(f"local[{cores}]")
        conf |= {"spark.sql.shuffle.partitions": cores, "spark.driver.memory": "8g", "spark.ui.enabled": "false"}
    for k, v in (conf | settings).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
