"""Readers of uploaded documents, geographic files, lists and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The keys under which an uploaded document may carry its text, in order.
TEXT_KEYS = ("text", "body", "content", "article_text")


def json_documents(spark: SparkSession, path: str, *, keys: tuple[str, ...] = TEXT_KEYS, multi_line: bool = False) -> DataFrame:
    """(file, text, problem): one row for each document; `problem` says why a bad one has no text.

    The schema is fixed, so reading infers nothing, and a broken record is a row, not a failure.
    """
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in keys), T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("multiLine", multi_line).option("pathGlobFilter", "*.json").json(path)
    text = F.coalesce(*(F.nullif(F.trim(k), F.lit("")) for k in keys))
    found = rows.select(F.col("_metadata.file_name").alias("file"), text.alias("text"), F.col("_broken").isNotNull().alias("broken"))
    return found.select("file", F.when(~F.col("broken"), F.col("text")).alias("text"), F.when(F.col("broken"), "not json").when(F.col("text").isNull(), "no text").alias("problem"))


def features(raw: DataFrame, column: str = "feature") -> DataFrame:
    """(properties, kind, coordinates) of GeoJSON features in a text column; a collection gives a row for each geometry, none drops."""
    geometry = "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>"
    parsed = raw.withColumn("__f", F.from_json(column, f"struct<properties:map<string,string>,geometry:{geometry}>"))
    single = F.array(F.struct(F.col("__f.geometry.type").alias("type"), F.col("__f.geometry.coordinates").alias("coordinates")))
    parts = F.when(F.col("__f.geometry.type") == "GeometryCollection", F.col("__f.geometry.geometries")).otherwise(single)
    out = parsed.filter(F.col("__f.geometry").isNotNull()).select(*raw.columns, F.col("__f.properties").alias("properties"), F.explode(parts).alias("g"))
    return out.select(*raw.columns, "properties", F.col("g.type").alias("kind"), F.col("g.coordinates").alias("coordinates")).filter("coordinates is not null")


def property_keys(found: DataFrame) -> DataFrame:
    """(key): the keys that any feature's properties have."""
    return found.select(F.explode(F.map_keys("properties")).alias("key")).distinct()


def csv_list(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A headed CSV whose named columns are read as the given types; values that are none become null."""
    rows = spark.read.option("header", True).csv(path)
    known = {c.lower(): c for c in rows.columns}
    cell = lambda c, t: F.col(known[c]).try_cast(t) if c in known else F.lit(None).cast(t)
    return rows.select(*(cell(c, t).alias(c) for c, t in columns.items()))


def remapped(rows: DataFrame, ids: DataFrame, *references: str) -> DataFrame:
    """Imported rows with `references` turned to the ids they got here (`ids`: old, new); references to nothing imported become null."""
    for r in references:
        m = ids.select(F.col("old").alias(r), F.col("new").alias("__new"))
        rows = rows.join(m, r, "left").withColumn(r, F.col("__new")).drop("__new")
    return rows


def fresh_ids(rows: DataFrame, key: Column, namespace: str) -> DataFrame:
    """(old, new): a new id for each imported one, the same whenever it is made again for this import."""
    return rows.select(key.alias("old")).distinct().withColumn("new", F.sha2(F.concat_ws("/", F.lit(namespace), F.col("old").cast("string")), 256).substr(1, 32))


def source_file_parts(path: str) -> Column:
    """struct(day, article_id, update_key) of an export's path: the first date in it, and the two ten-sign keys at the end of its name."""
    text = F.col(path)
    found = lambda source, pattern: F.nullif(F.regexp_extract(source, pattern, 1), F.lit(""))
    key = "[a-zA-Z0-9]{10}"
    name = F.replace(text, F.lit("-output.json"), F.lit(".json"))
    return F.struct(
        found(text, r"(\d{4}-\d{2}-\d{2})").alias("day"),
        found(text, rf"-({key})-{key}\.json$").alias("article_id"),
        found(name, rf"-({key})\.json$").alias("update_key"),
    )
