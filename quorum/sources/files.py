"""Scans of image files: found ones by listing, without their contents, and sizes from their headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a PNG file begins with; width and height follow its first chunk's name (a fixed format).
PNG = "89504E470D0A1A0A"


def file_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """image_id (the name without suffix), path, length of all files below a folder. Only the listing is read, no contents.

    The engine lists no empty files, so these count as missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^/.]*)?$", 1).alias("image_id"), "path", "length")


def with_files(rows: DataFrame, files: DataFrame, key: str = "image_id", least: float = 0.95) -> DataFrame:
    """The rows whose file was found, with ``path`` and ``length``; an error if too few of the distinct keys have one.

    Of several files with one name the first path counts, so no row multiplies. Null keys have no file.
    """
    one = files.groupBy("image_id").agg(F.min(F.struct("path", "length")).alias("file"))
    known = rows.select(key).distinct().join(one.select(F.col("image_id").alias(key), F.lit(True).alias("found")), key, "left")
    every, found = known.agg(F.count(F.lit(1)), F.count("found")).first()
    if found < least * every:
        some = [r[0] for r in known.where("found is null").orderBy(key).limit(5).collect()]
        raise ValueError(f"files for {found} of {every} images, at least {least:.0%} are expected; missing are {some}")
    return rows.join(one.withColumnRenamed("image_id", key), key).select(*rows.columns, F.col("file.path").alias("path"), F.col("file.length").alias("length"))


def _number(header: Column, at: int) -> Column:
    return F.conv(F.substring(header, 2 * at + 1, 8), 16, 10).cast("int")


def png_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height of PNG files by their headers; null for files that are none or are cut short (empty ones are not listed)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    header = F.hex(F.substring("content", 1, 24))
    whole = (F.length(header) == 48) & header.startswith(PNG)
    return files.select("path", header.alias("h"), whole.alias("whole")).select("path", *(F.when(F.col("whole"), _number(F.col("h"), at)).alias(name) for name, at in (("width", 16), ("height", 20))))
