"""Files as DataFrames. Sentinels of missing values become null here and only sinks put them back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Columns of a decision tree's node table: inner nodes have a feature and a threshold, leaves a label.
TREE = "id int, feature string, threshold double, left int, right int, label int"


def pixel_table(spark: SparkSession, path: str, bands: Sequence[str], rows: tuple[int, int] | None = None) -> DataFrame:
    """Chosen bands and rows of a Parquet pixel table: columns and row groups that aren't asked for aren't read."""
    df = spark.read.parquet(path).select("row", "col", *bands)
    return df if rows is None else df.where(F.col("row").between(*rows))


def write_pixels(df: DataFrame, path: str, lines: int = 300) -> None:
    """A pixel table partitioned by strips of ``lines`` lines, sorted in each file."""
    strip = df.withColumn("strip", F.floor(F.col("row") / lines))
    strip.repartition("strip").sortWithinPartitions("row", "col").write.partitionBy("strip").parquet(path)


def csv_samples(spark: SparkSession, path: str, n_bands: int) -> DataFrame:
    """Header-less samples: bands, then the label."""
    schema = ", ".join([f"b{i} double" for i in range(1, n_bands + 1)] + ["label int"])
    return spark.read.csv(path, schema=schema)


def csv_parts(spark: SparkSession, folder: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """All tables of a folder and those below it as one, with the name of each row's file."""
    df = spark.read.csv(folder, schema=schema, pathGlobFilter=pattern, recursiveFileLookup=True)
    return df.select("*", F.col("_metadata.file_name").alias("file"))


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, name, length) of the files of a folder and those below it whose names match; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def layers(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(layer, rows, columns) of Parquet layers by name: rows are counted from the files' footers."""
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    one = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("layer"), "rows", F.lit(len(df.columns)).cast("long").alias("columns")) for name, df in read.items()]
    return reduce(DataFrame.unionByName, one)


def label_names(spark: SparkSession, path: str) -> DataFrame:
    """``name,id`` lines, blanks dropped."""
    return spark.read.csv(path, schema="name string, id int").where(F.col("id").isNotNull() & (F.trim("name") != ""))


def csv_points(spark: SparkSession, path: str, x: str, y: str) -> DataFrame:
    """A table with a header as points (x, y)."""
    df = spark.read.csv(path, header=True)
    return df.withColumns({"x": F.col(x).try_cast("double"), "y": F.col(y).try_cast("double")}).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def daily_weather(spark: SparkSession, path: str, date: str, columns: dict[str, str], fmt: str = "yyyy-M-d") -> DataFrame:
    """Chosen columns of a daily weather table as doubles by date; rows that miss any are left out."""
    df = spark.read.csv(path, header=True)
    out = df.select(F.to_date(F.try_to_timestamp(F.col(f"`{date}`"), F.lit(fmt))).alias("date"), *[F.col(f"`{c}`").try_cast("double").alias(k) for k, c in columns.items()])
    return out.dropna()


def hourly_weather(lines: DataFrame, name: Column, value: str = "value") -> DataFrame:
    """(date, hour, temperature, rain) of white-space tables; -999 is missing; the date is at the end of the file's name."""
    part = F.split(F.trim(F.col(value)), r"\s+")
    day = F.try_to_date(F.regexp_extract(name, r"(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d")
    at = lambda i, kind: F.try_element_at(part, F.lit(i)).try_cast(kind)
    out = lines.select(day.alias("date"), at(1, "int").alias("hour"), F.nullif(at(2, "double"), F.lit(-999.0)).alias("temperature"), F.nullif(at(4, "double"), F.lit(-999.0)).alias("rain"))
    return out.where(F.col("hour").isNotNull() & F.col("temperature").isNotNull())


def coefficient_files(spark: SparkSession, path: str) -> DataFrame:
    """(scene, band, xa, xb, xc) of five-line text files named by scene; bands count from 1 in line order."""
    lines = spark.read.text(path, wholetext=True).withColumn("scene", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))
    rows = lines.select("scene", F.posexplode(F.filter(F.split(F.trim("value"), r"\r?\n"), lambda x: F.trim(x) != "")).alias("band", "line"))
    part = F.split(F.trim("line"), r"\s+")
    return rows.select("scene", (F.col("band") + 1).alias("band"), *[F.try_element_at(part, F.lit(i)).try_cast("double").alias(k) for i, k in enumerate(("xa", "xb", "xc"), 1)])


def spectra(spark: SparkSession, path: str) -> DataFrame:
    """Mean by wavelength of repeated two-column spectra."""
    part = F.split(F.trim("value"), r"[\s,]+")
    df = spark.read.text(path).select(F.try_element_at(part, F.lit(1)).try_cast("double").alias("wavelength"), F.try_element_at(part, F.lit(2)).try_cast("double").alias("value"))
    return df.dropna().groupBy("wavelength").agg(F.avg("value").alias("value"))


def paste(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Tables of CSV lines side by side by the numbers of their rows: columns ``t0_c0``, ``t0_c1``, ..., ``t1_c0``, ...; texts.

    The number of a row is its file's place and its own in the file, so no task counts a whole table; shorter ones are filled up with nulls.
    """
    out = None
    for k, path in enumerate(paths):
        lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
        lines = lines.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
        parts = lines.groupBy("_part").agg(F.count("*").alias("_n"), F.min(F.struct("_file", "_start")).alias("_order"))
        before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")  # a row a task
        one = lines.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_at")).alias("row"), F.from_csv("value", ", ".join(f"t{k}_c{c} string" for c in range(_width(spark, path)))).alias("_r")).select("row", "_r.*")
        out = one if out is None else out.join(one, "row", "full")
    return out


def _width(spark: SparkSession, path: str) -> int:
    """Columns of the first line."""
    return len(spark.read.csv(path).columns)


def geojson_points(documents: DataFrame, value: str = "value") -> DataFrame:
    """(x, y, properties) of the point features of FeatureCollection documents."""
    feature = "struct<geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>"
    f = documents.select(F.explode(F.from_json(value, f"features array<{feature}>")["features"]).alias("f")).where(F.col("f.geometry.type") == "Point")
    return f.select(F.try_element_at("f.geometry.coordinates", F.lit(1)).alias("x"), F.try_element_at("f.geometry.coordinates", F.lit(2)).alias("y"), F.col("f.properties").alias("properties"))


def to_geojson(points: DataFrame, properties: Sequence[str]) -> DataFrame:
    """A feature for each point (x, y)."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def xml_texts(documents: DataFrame, tags: Sequence[str], value: str = "value") -> DataFrame:
    """The first text of each tag."""
    return documents.select("*", *[F.xpath_string(F.col(value), F.lit(f"//{t}[1]")).alias(t) for t in tags])


def to_xml(df: DataFrame, columns: Sequence[str], row: str = "row") -> DataFrame:
    return df.select(F.to_xml(F.struct(*columns), {"rowTag": row}).alias("value"))


def split_layer(df: DataFrame, path: str, key: str) -> None:
    """One folder for each value of an attribute."""
    df.write.partitionBy(key).parquet(path)


def append_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str]) -> None:
    """Append to a database table; credentials come from the caller."""
    df.write.jdbc(url, name, mode="append", properties=properties)


def write_tree(spark: SparkSession, nodes: Sequence[tuple], path: str) -> None:
    """A decision tree, as ``operators.learning.cart`` makes it, as a table of nodes."""
    spark.createDataFrame(list(nodes), TREE).coalesce(1).write.mode("overwrite").parquet(path)


def read_tree(spark: SparkSession, path: str) -> list[tuple]:
    """The nodes of a written tree, in order of their numbers."""
    return [tuple(r) for r in spark.read.schema(TREE).parquet(path).orderBy("id").collect()]
