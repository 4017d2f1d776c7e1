"""Pages and API documents as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Readings of an air-quality document: those that it may lack are null.
READINGS = ["pm25", "pm10", "so2", "no2", "o3", "co", "h", "t", "r", "w"]


def links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(…, link, internal, place): each link of a page once, in order of first occurrence; internal if it stays on the host."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit("href=[\"']([^\"'#]+)[\"']"), F.lit(1)))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("place", "link"))
    host = F.regexp_extract("link", "^[a-z]+://([^/]+)", 1)
    own = F.regexp_extract(F.col(url), "^[a-z]+://([^/]+)", 1)
    return rows.withColumn("internal", (host == "") | (host == own))


def embedded_json(pages: DataFrame, variable: str, schema: str, html: str = "html") -> DataFrame:
    """The JSON that a script assigns to a variable, parsed; null where there is none. The parser finds its end, over line breaks and inside texts."""
    text = F.regexp_extract(F.col(html), rf"(?s)\b{variable}\s*=\s*(\{{.*)", 1)
    return pages.withColumn(variable, F.from_json(F.nullif(text, F.lit("")), schema))


def table_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """(…, row, cells): the rows of a page's tables as arrays of texts without tags."""
    rows = F.regexp_extract_all(F.col(html), F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(F.regexp_extract_all(F.col("_r"), F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(rows).alias("row", "_r")).withColumn("cells", cells).drop("_r")


def air_quality(documents: DataFrame, value: str = "value") -> DataFrame:
    """(time, zone, city, station, lat, lon, aqi, readings …) of API documents; those whose status is not ok are left out."""
    schema = "status string, data struct<aqi:double, idx:long, city:struct<name:string, geo:array<double>>, time:struct<s:string, tz:string>, iaqi:map<string,struct<v:double>>>"
    d = documents.select(F.from_json(value, schema).alias("d")).where("d.status = 'ok'").select("d.data.*")
    return d.select(
        F.col("time.s").alias("time"), F.col("time.tz").alias("zone"), F.col("city.name").alias("city"), F.col("idx").alias("station"), F.try_element_at("city.geo", F.lit(1)).alias("lat"), F.try_element_at("city.geo", F.lit(2)).alias("lon"),
        "aqi", *[F.try_element_at("iaqi", F.lit(k))["v"].alias(k) for k in READINGS],
    )
