"""Medicine lines from a stream of recognised texts.

Splitting, filtering and extraction look at one line at a time, so they run on a
streaming DataFrame as they are, without state. What needs a whole document (lenient
pass, warnings) is left to a batch over what this stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rxloom.operators.extract import medicine_lines
from rxloom.operators.frequency import Codes
from rxloom.operators.lines import split_lines, strict_lines

TEXTS = "rx_id long, text string, ocr_conf double"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts from Parquet files as they arrive below ``path``."""
    return spark.readStream.schema(TEXTS).parquet(path)


def strict_medicines(texts: DataFrame, codes: Codes) -> DataFrame:
    """Strict medicine lines of ``texts``, streaming or not."""
    return medicine_lines(strict_lines(split_lines(texts)), codes)
