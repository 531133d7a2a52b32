"""Images of a folder as data URLs, read by Spark's own readers."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def media_type(path: Column) -> Column:
    """By the file name's ending; all else is taken for JPEG."""
    ending = F.lower(F.regexp_extract(path, r"\.[A-Za-z]+$", 0))
    known = {k: v for k, v in mimetypes.types_map.items() if v.startswith("image/")}
    kinds = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(kinds[ending], F.lit("image/jpeg"))


def data_url(content: Column, path: Column) -> Column:
    return F.concat(F.lit("data:"), media_type(path), F.lit(";base64,"), F.base64(content))


def load_images(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path, n_bytes, image (a data URL) of each file, wherever Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        files = files.option("pathGlobFilter", glob)
    return files.load(path).select("path", F.col("length").alias("n_bytes"), data_url(F.col("content"), F.col("path")).alias("image"))


def image_bytes(image: Column) -> Column:
    """The bytes of a data URL, or of bare base64; null where it is neither."""
    return F.try_to_binary(F.when(F.instr(image, ",") > 0, F.regexp_extract(image, r"(?s)^[^,]*,(.*)$", 1)).otherwise(image), F.lit("base64"))
