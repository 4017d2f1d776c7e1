"""Sources on the driver's tables: pages, JSON properties, names, and the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as C
from ..operators.tables import shared_root
from ..session import STATE_STORE
from ..sources import files, web
from ..streaming import observations as O
from .registry import query, table


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS INTEGER) AS words, md5(text) AS digest FROM documents")
def word_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", C.word_count(F.col("text")).alias("words"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 2) AS part FROM pages")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    part = F.coalesce(F.try_element_at(C.url_parts(F.col("url")), F.lit(2)), F.lit(""))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), part.alias("part"))


@query("""WITH f AS (SELECT page_id, url, regexp_extract_all(html, 'href=["'']([^"''#]+)["'']', 1) AS l FROM pages), u AS (SELECT page_id, url, l[i] AS link, i FROM f, range(1, 100000) t(i) WHERE i <= len(l))
  SELECT page_id, link, regexp_extract(link, '^[a-z]+://([^/]+)', 1) IN ('', regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS internal FROM (SELECT page_id, url, link FROM u GROUP BY 1, 2, 3)""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return web.links(table(spark, sf, "pages")).select("page_id", "link", "internal")


@query("""SELECT page_id, len(regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1)) AS n FROM pages WHERE len(regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1)) > 0""")
def page_tables(spark: SparkSession, sf: str) -> DataFrame:
    return web.table_cells(table(spark, sf, "pages").select("page_id", "html")).groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, lower(split_part(c_name, '#', 1)) AS head, CAST(split_part(c_name, '#', 2) AS VARCHAR) AS tail, base64(encode(c_name)) AS b64, regexp_matches(c_name, '^[A-Z].*[0-9]$') AS valid FROM customer")
def name_parts(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda i: F.coalesce(F.try_element_at(F.split("c_name", "#"), F.lit(i)), F.lit(""))
    return table(spark, sf, "customer").select("c_custkey", F.lower(part(1)).alias("head"), part(2).alias("tail"), F.base64(F.col("c_name").cast("binary")).alias("b64"), F.col("c_name").rlike("^[A-Z].*[0-9]$").alias("valid"))


@query("SELECT event_id, user_id % 90 + 0.5::DOUBLE AS lat, user_id % 170 + 0.25::DOUBLE AS lon, round(value, 2) AS aqi, CASE WHEN event_id % 2 = 0 THEN round(value / 2, 3) END AS pm25 FROM events WHERE event_id % 5 <> 0")
def api_rows(spark: SparkSession, sf: str) -> DataFrame:
    """API documents built from events, parsed back to rows; those with another status are dropped."""
    e, v = table(spark, sf, "events"), F.col("value")
    number = lambda x: F.struct(x.alias("v"))
    iaqi = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("pm25"), number(F.round(v / 2, 3)))).otherwise(F.create_map(F.lit("o3"), number(v)))
    data = F.struct(F.round(v, 2).alias("aqi"), F.col("event_id").alias("idx"), F.struct(F.lit("x").alias("name"), F.array(F.col("user_id") % 90 + 0.5, F.col("user_id") % 170 + 0.25).alias("geo")).alias("city"), iaqi.alias("iaqi"))
    docs = e.select(F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, "ok").otherwise("error").alias("status"), data.alias("data"))).alias("value"))
    return web.air_quality(docs).select(F.col("station").alias("event_id"), "lat", "lon", "aqi", "pm25")


@query("SELECT CAST(p_partkey AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, p_name AS name FROM part")
def geojson_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), F.col("p_name").alias("name"))
    features = files.to_geojson(p, ["name"]).select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "value", F.lit("]}")).alias("value"))
    return files.geojson_points(features).select("x", "y", F.col("properties")["name"].alias("name"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def xml_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return files.xml_texts(files.to_xml(n, ["k", "name"]), ["k", "name"]).select(F.col("k").cast("int").alias("k"), "name")


def _paths(spark: SparkSession) -> tuple[str, str]:
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


@query("WITH d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT * FROM d WHERE (day + 1) * 86400 <= (SELECT max(epoch(ts)) - 7200 FROM events)")
def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the watermark has closed, once all that is available was read."""
    out, checkpoint = _paths(spark)
    O.run_available(O.daily(O.observations(spark, f"{sf}/events.parquet*"), "event_type"), out, checkpoint)
    return spark.read.parquet(out).select(F.floor(F.unix_timestamp("w.start") / 86400).alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT count(DISTINCT user_id * 100 + hour(ts)) AS n FROM events")
def stream_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """One observation for each user and hour of day within the watermark's delay of forty days."""
    out, checkpoint = _paths(spark)
    s = O.observations(spark, f"{sf}/events.parquet*", delay="40 days").withColumn("h", F.hour("ts"))
    O.run_available(O.unseen(s, ["user_id", "h"]), out, checkpoint)
    return spark.read.parquet(out).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS version, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    out, checkpoint = _paths(spark)
    s = O.observations(spark, f"{sf}/events.parquet*").select("user_id", "event_type", "ts", "value")
    O.upsert_into(s, out, ["user_id", "event_type"], "ts", checkpoint).awaitTermination()
    return O.latest(spark, out).select("user_id", "event_type", F.unix_timestamp("ts").alias("version"), "value")


@query("""WITH e AS (SELECT user_id, event_type, ts, epoch_us(ts) // 1000 AS ms, (SELECT max(epoch_us(ts)) // 1000 - 7200000 FROM events) AS passed FROM events),
  c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER u AND ms - lag(ms) OVER u <= 86400000 THEN 0 ELSE 1 END AS c FROM e WHERE ms < passed WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
  r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM c),
  g AS (SELECT user_id, run, any_value(event_type) AS state, min(ms) AS a, max(ms) AS b, count(*) AS n, max(run) OVER (PARTITION BY user_id) AS top, any_value(passed) AS passed FROM r GROUP BY user_id, run)
SELECT user_id, state, a // 1000 AS start, b // 1000 AS last, n FROM g WHERE run < top OR b + 86400000 < passed""")
def stream_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a state that another has ended, or a day without a row."""
    out, checkpoint = _paths(spark)
    name, provider = STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        O.run_available(O.state_runs(O.observations(spark, f"{sf}/events.parquet*")), out, checkpoint)
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(out).select("user_id", "state", "start", "last", "n")


@query("""WITH e AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, value FROM events), w AS (SELECT event_type, h - k AS h, value FROM e, range(0, 8) t(k))
  SELECT h, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM w WHERE (h + 8) * 3600 <= (SELECT max(epoch(ts)) - 7200 FROM events) GROUP BY 1, 2""")
def stream_moving(spark: SparkSession, sf: str) -> DataFrame:
    """Means of eight hours, each hour anew; those that the watermark has closed."""
    out, checkpoint = _paths(spark)
    O.run_available(O.moving(O.observations(spark, f"{sf}/events.parquet*"), "event_type"), out, checkpoint)
    return spark.read.parquet(out).select(F.floor(F.unix_timestamp("w.start") / 3600).alias("h"), "event_type", "n", (F.floor(F.col("mean") * 1e6 + 0.5) / 1e6).alias("mean"))
