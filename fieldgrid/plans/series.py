"""Time series of events: regular grids, moving windows, runs, daily rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import physics as P
from ..functions import scalar as C
from ..operators import timeseries as T
from .registry import EVENTS_SQL, events, query, table


@query("""WITH h AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, hour(ts) AS h, min(value) AS v, max(value) AS mx, min(value) AS mn FROM events GROUP BY 1, 2, 3)
  SELECT user_id, day, round(CASE WHEN count(*) FILTER (h IN (2, 8, 14, 20)) = 4 THEN sum(v) FILTER (h IN (2, 8, 14, 20)) / 4 ELSE (max(mx) + min(mn)) / 2 END, 6) AS mean FROM h GROUP BY 1, 2""")
def daily_mean_rule(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).groupBy("user_id", F.to_date("ts").cast("string").alias("day"))
    return e.agg(F.round(T.daily_mean(F.hour("ts"), F.col("value")), 6).alias("mean"))


@query("SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_total(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, year(ts) ORDER BY ts ROWS UNBOUNDED PRECEDING), 3) AS total FROM events")
def cum_rain(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("year", F.year("ts"))
    return T.running_total(e, ["user_id", "year"], ["ts"], "value", "total", F.dayofyear("ts")).select("event_id", "total")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) / 8, 6) AS mean FROM events")
def moving_avg8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(T.moving_average(["user_id"], ["ts"], "value", 8), 6).alias("mean"))


@query("""WITH h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1),
  m AS (SELECT h, avg(v) OVER (ORDER BY h RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS m FROM h) SELECT h // 24 AS day, round(max(m) + 1e-9, 4) AS most FROM m GROUP BY 1""")
def daily_o3_max(spark: SparkSession, sf: str) -> DataFrame:
    """The largest mean of eight hours in each day; hours are pre-aggregated, then days meet the seven hours before them."""
    h = events(spark, sf).where("event_type = 'view'").groupBy(F.floor(F.col("t") / 3600).alias("h")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    ahead = h.select(F.explode(F.sequence(F.col("h"), F.col("h") + 7)).alias("at"), (F.col("s") / F.col("n")).alias("v"))
    mean = ahead.groupBy("at").agg(F.avg("v").alias("m")).join(h.select(F.col("h").alias("at")), "at")
    return mean.groupBy(F.floor(F.col("at") / 24).alias("day")).agg(F.round(F.max("m") + 1e-9, 4).alias("most"))


@query("""WITH p AS (SELECT event_id, user_id, ts, event_id % 90 AS lat, event_id % 170 AS lon FROM events), l AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts))
  SELECT event_id, round(2 * 6372.8 * asin(sqrt(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2))), 4) AS km FROM l""")
def lag_distance(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    p = table(spark, sf, "events").withColumns({"lat": F.col("event_id") % 90, "lon": F.col("event_id") % 170})
    p = p.withColumns({"la": F.lag("lat").over(w), "lo": F.lag("lon").over(w)})
    return p.select("event_id", F.round(C.haversine_km(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 4).alias("km"))


@query(f"""WITH {EVENTS_SQL}, l AS (SELECT user_id, abs(value - lag(value) OVER w) AS d, (t - lag(t) OVER w) / 3600.0::DOUBLE AS h FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, round(max(d / nullif(h, 0)), 4) AS speed FROM l GROUP BY user_id""")
def max_speed(spark: SparkSession, sf: str) -> DataFrame:
    d, h = T.since_last(["user_id"], ["ts"], "value"), T.since_last(["user_id"], ["ts"], "t") / 3600.0
    e = events(spark, sf).select("user_id", F.abs(d).alias("d"), h.alias("h"))
    return e.groupBy("user_id").agg(F.round(F.max(F.try_divide("d", "h")), 4).alias("speed"))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 0 ELSE 1 END AS c FROM ev), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM c)
  SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, max(t) - min(t) AS lasts FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def state_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = T.state_runs(events(spark, sf), ["user_id"], ["ts"], "event_type")
    return r.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("lasts")).where("n > 1")


@query(f"WITH {EVENTS_SQL} SELECT event_id, (t + 900) // 1800 * 1800 AS rounded FROM ev")
def round_hour(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", C.rounded_time(F.col("ts"), 30).alias("rounded"))


_GRID = f"""{EVENTS_SQL}, s AS (SELECT event_type, t // 3600 AS h, max(struct_pack(t := epoch_us(ts), v := value)).v AS value FROM ev GROUP BY 1, 2),
 g AS (SELECT event_type, unnest(range(min(h), max(h) + 1)) AS h FROM s GROUP BY 1), r AS (SELECT g.event_type, g.h, s.value FROM g LEFT JOIN s ON s.event_type = g.event_type AND s.h = g.h)"""


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("h", F.floor(F.col("t") / 3600))
    return T.regular(e, ["event_type"], "h", 1, "value", "ts")


@query(f"WITH {_GRID} SELECT event_type, h, value FROM r")
def regular_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf).select("event_type", "h", "value")


@query(f"""WITH {_GRID}, n AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN h END) OVER (PARTITION BY event_type ORDER BY h ROWS UNBOUNDED PRECEDING) AS ha, min(CASE WHEN value IS NOT NULL THEN h END) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hb FROM r)
  SELECT n.event_type, n.h, round(coalesce(n.value, a.value + (b.value - a.value) * (n.h - ha) / CAST(hb - ha AS DOUBLE)), 6) AS value FROM n LEFT JOIN r a ON a.event_type = n.event_type AND a.h = ha LEFT JOIN r b ON b.event_type = n.event_type AND b.h = hb""")
def interp_linear(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf).select("event_type", "h", F.round(T.interpolated(["event_type"], "h", "value"), 6).alias("value"))


@query("SELECT isodow(ts) AS weekday, CAST(dayofyear(ts) AS INTEGER) AS day, CAST(date_diff('day', DATE '2024-01-05', CAST(ts AS DATE)) AS INTEGER) AS since, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H') AS east, event_id FROM events")
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    east = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.col("ts")), "yyyy-MM-dd HH")
    return table(spark, sf, "events").select(C.weekday_number(F.col("ts")).cast("long").alias("weekday"), F.dayofyear("ts").alias("day"), F.datediff(F.to_date("ts"), F.lit("2024-01-05").cast("date")).alias("since"), east.alias("east"), "event_id")


@query("SELECT CASE WHEN grouping(wd) = 0 THEN 'weekday' ELSE 'month' END AS kind, coalesce(wd, mo) AS k, round(avg(value), 6) AS mean FROM (SELECT isodow(ts) AS wd, month(ts) AS mo, value FROM events) GROUP BY GROUPING SETS ((wd), (mo))")
def mean_by_calendar(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(C.weekday_number(F.col("ts")).cast("long").alias("weekday"), F.month("ts").cast("long").alias("month"), "value")
    of = lambda k: e.groupBy(F.lit(k).alias("kind"), F.col(k).alias("k")).agg(F.round(F.avg("value"), 6).alias("mean"))
    return of("weekday").unionByName(of("month"))


@query(f"WITH {EVENTS_SQL}, m AS (SELECT user_id, max(t // 3600) FILTER (event_id % 2 = 0) AS top FROM ev GROUP BY 1) SELECT event_id FROM ev JOIN m USING (user_id) WHERE event_id % 2 = 1 AND t // 3600 > top")
def missing_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Fresh observations later than the last stored hour of their station."""
    e = events(spark, sf).withColumn("h", F.floor(F.col("t") / 3600))
    stored = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("h").alias("top"))
    return e.where("event_id % 2 = 1").join(stored, "user_id").where("h > top").select("event_id")


@query("SELECT event_type, round(regr_slope(y, x), 6) AS b, round(regr_intercept(y, x), 4) AS a, round(regr_r2(y, x), 6) AS r2 FROM (SELECT event_type, value AS x, value * 2 + event_id % 13 AS y, quantile_cont(value, 0.1) OVER (PARTITION BY event_type) AS lo, quantile_cont(value, 0.9) OVER (PARTITION BY event_type) AS hi FROM events) WHERE x BETWEEN lo AND hi GROUP BY 1")
def ols_r2(spark: SparkSession, sf: str) -> DataFrame:
    """A line fitted between two quantiles."""
    e = table(spark, sf, "events").select("event_type", F.col("value").alias("x"), (F.col("value") * 2 + F.col("event_id") % 13).alias("y"))
    q = e.groupBy("event_type").agg(F.percentile("x", 0.1).alias("lo"), F.percentile("x", 0.9).alias("hi"))
    kept = e.join(F.broadcast(q), "event_type").where("x BETWEEN lo AND hi").groupBy("event_type")
    return kept.agg(F.round(F.regr_slope("y", "x"), 6).alias("b"), F.round(F.regr_intercept("y", "x"), 4).alias("a"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


@query(f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sqrt(avg(pow(value - 100, 2))), 6) AS rmse FROM events GROUP BY 1")
def rmse(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.col("value") - 100
    return table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"))


@query("""WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, avg(value) AS pm FROM events GROUP BY 1, 2) SELECT user_id, day, round(pm, 6) AS pm, CAST(CASE WHEN pm <= 35 THEN 1 WHEN pm <= 75 THEN 2 WHEN pm <= 115 THEN 3 WHEN pm <= 150 THEN 4 WHEN pm <= 250 THEN 5 ELSE 6 END AS INTEGER) AS level FROM d""")
def aqi_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly readings cleaned to days, and the level of the day."""
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.avg("value").alias("pm"))
    return d.select("user_id", "day", F.round("pm", 6).alias("pm"), P.aqi({"pm2_5_24h": F.col("pm")})[2].alias("level"))
