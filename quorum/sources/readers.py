"""Scans of JSON documents, keyed objects, JSON Lines, CSV and id lists, always with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_list(spark: SparkSession, path: str | list[str], field: str, item: str) -> DataFrame:
    """The rows of one list inside whole-file JSON documents."""
    whole = spark.read.schema(f"`{field}` array<{item}>").option("multiLine", True).json(path)
    return whole.select(F.explode(field).alias("r")).select("r.*")


def json_array(spark: SparkSession, path: str | list[str], ddl: str) -> DataFrame:
    """Files that are one JSON array of rows."""
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def keyed_object(spark: SparkSession, path: str | list[str], item: str, key: str = "id") -> DataFrame:
    """Files that are one JSON object of id to row."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{item}>")).alias(key, "r")).select(key, "r.*")


def json_lines(spark: SparkSession, path: str | list[str], ddl: str, name: str | None = None) -> DataFrame:
    """JSON Lines, whatever the suffix (S2, S5); ``name`` adds a column with the file's stem."""
    rows = spark.read.schema(ddl).json(path)
    return rows if name is None else rows.withColumn(name, F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^/.]*)?$", 1))


def csv_table(spark: SparkSession, path: str | list[str], ddl: str) -> DataFrame:
    """CSV with a header; columns are found by name and cast (S3)."""
    fields = spark.createDataFrame([], ddl).schema
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields))


def id_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One id a line; blank lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def optional(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON Lines that may be missing: then no rows, with the schema."""
    return json_lines(spark, path, ddl) if exists(spark, path) else spark.createDataFrame([], ddl)
