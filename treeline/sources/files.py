"""File sources: uploads as bytes, request bodies as JSON, and relations kept for reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 5 << 20
# The image types of file names.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}


def uploads(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, mime, content) of the images in a folder that are not too large.

    Sizes and names are filtered before any content is read.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.create_map(*(F.lit(x) for pair in IMAGE_TYPES.items() for x in pair))[suffix]
    return files.select("path", mime.alias("mime"), "content").where(F.startswith("mime", F.lit("image/")))


def bodies(spark: SparkSession, path: str, schema: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """JSON bodies, one a line, of at most so many bytes; one that does not parse has null fields."""
    lines = spark.read.text(path).where(F.octet_length("value") <= most_bytes)
    return lines.select(F.from_json("value", schema).alias("body")).select("body.*")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` cached under a view name, for queries that ask for it again."""
    df.cache().createOrReplaceTempView(name)
    return df
