"""The image boundary: what is decided about images without decoding them, and the contract for engines that do.

Image decoding and recognition (I1, I2, I7-I10, O1, O8) need libraries that Spark does
not have. An engine is a function for ``mapInPandas`` from ``VARIANTS`` to ``DETECTIONS``
or ``WORDS``; the arithmetic around it is here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One row per prepared image; names in the order in which they are made.
VARIANT_NAMES = ["grayscale_clahe_adaptive", "bilateral_sharpen", "grayscale_otsu", "deskewed_original"]
VARIANTS = "rx_id long, variant_idx int, variant_name string, content binary"
DETECTIONS = "rx_id long, variant_idx int, box_idx int, bbox array<struct<x:double,y:double>>, text string, conf double"
WORDS = "rx_id long, variant_idx int, word_idx int, text string, conf int, line_num int"


def text_region(boxes: DataFrame) -> DataFrame:
    """The region to crop to, from contour boxes (rx_id, width, height, x, y, w, h); null where the image stays whole.

    Small boxes go. The union of the others is not used when it covers over 90 %
    of the image, or when it is narrower than a tenth and lower than 8 % of it;
    a tenth of its longer side and 12 pixels are added on each side.
    """
    least = F.greatest(F.lit(80), F.floor(F.col("width") * F.col("height") * 3e-5))
    kept = boxes.filter((F.col("w") * F.col("h") >= least) & (F.col("w") >= 10) & (F.col("h") >= 8))
    union = kept.groupBy("rx_id", "width", "height").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    unused = (w * h / (F.col("width") * F.col("height")) > 0.90) | ((w < F.floor(F.col("width") * 0.10)) & (h < F.floor(F.col("height") * 0.08)))
    pad = F.floor(F.greatest(w, h) * 0.10) + 12
    crop = F.struct(
        F.greatest(F.lit(0), F.col("x1") - pad).alias("x1"), F.greatest(F.lit(0), F.col("y1") - pad).alias("y1"),
        F.least("width", F.col("x2") + pad).alias("x2"), F.least("height", F.col("y2") + pad).alias("y2"),
    )
    return union.select("rx_id", F.when(~unused, crop).alias("crop"))


def upscale(width: Column, height: Column) -> Column:
    """I4: the factor for small images, at most 3 and 1.0 where it would be 1.05 or less."""
    wanted = F.least(F.greatest(900.0 / height, 1200.0 / width), F.lit(3.0))
    return F.when((height < 900) | (width < 1200), F.when(wanted > 1.05, wanted).otherwise(1.0)).otherwise(1.0)


def downscale(width: Column, height: Column) -> Column:
    """The factor that brings the longer side to 2400 at most."""
    return F.least(F.lit(1.0), 2400.0 / F.greatest(width, height))


def skew(lines: DataFrame) -> DataFrame:
    """By image the exact median of line angles between -15 and 15 degrees; 0.0 under half a degree or without lines."""
    near = F.when((F.col("angle") > -15) & (F.col("angle") < 15), F.col("angle"))
    rows = lines.groupBy("rx_id").agg(F.coalesce(F.median(near), F.lit(0.0)).alias("m"))
    return rows.select("rx_id", F.when(F.abs("m") < 0.5, 0.0).otherwise(F.col("m")).alias("skew"))


def quality(variance: Column) -> Column:
    """The variance of the Laplacian of variant 0, in thousands, 1 at most."""
    return F.least(variance / 1000.0, F.lit(1.0))


def recognised(variants: DataFrame, engine: Callable, schema: str = DETECTIONS) -> DataFrame:
    """What ``engine`` (an iterator of pandas frames to another) reads; it gives no rows for what it cannot read."""
    return variants.mapInPandas(engine, schema)
