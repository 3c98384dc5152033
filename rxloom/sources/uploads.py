"""Uploaded images: reading and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.functions import fixed
from rxloom.settings import Settings

_ENDINGS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "bmp": "bmp", "tif": "tiff", "tiff": "tiff"}


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Path, mime (by ending), length, content of the files below ``path``."""
    ending = F.lower(F.substring_index("path", ".", -1))
    mime = F.lit("application/octet-stream")
    for end, kind in _ENDINGS.items():
        mime = F.when(ending == end, f"image/{kind}").otherwise(mime)
    return spark.read.format("binaryFile").load(path).select("path", mime.alias("mime"), "length", "content")


def validated(uploads: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds status_code: 415 for other media types, then 413 for too large, 400 for too small, else 200.

    Only ``mime`` and ``length`` are looked at, so content is read for accepted rows alone.
    """
    code = F.when(~F.coalesce(F.col("mime").isin(fixed.MEDIA_TYPES), F.lit(False)), 415)
    code = code.when(F.col("length") > settings.max_upload_mb * 1024 * 1024, 413).when(F.col("length") < settings.min_upload_bytes, 400)
    return uploads.withColumn("status_code", code.otherwise(200))
