"""Image files as rows ready for a vision model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions.text import image_media_type
from cliploom.sources.files import list_files, read_files
from cliploom.sources.scratch import materialize

MAX_BYTES = 5 * 1024 * 1024


def image_rows(files: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(images, oversize) from (path, length, content); oversize files are listed without content."""
    tagged = files.withColumn("media_type", image_media_type(F.col("path")))
    fits = tagged.filter(F.col("length") <= max_bytes).select("path", "media_type", "length", F.regexp_replace(F.base64("content"), r"\s", "").alias("data"))
    return fits, tagged.filter(F.col("length") > max_bytes).select("path", "media_type", "length")


def image_catalog(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """``image_rows`` of all files below ``path``, which are listed when called; the content of oversize ones is not read."""
    files = materialize(list_files(spark, path), "files")
    fits, _ = image_rows(read_files(files.filter(F.col("length") <= max_bytes)), max_bytes)
    return fits, image_rows(files.withColumn("content", F.lit(None).cast("binary")), max_bytes)[1]
