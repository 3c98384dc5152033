"""Reading the dictionaries, and merging new rows into them."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.functions import fixed
from rxloom.operators.frequency import Codes
from rxloom.operators.linkage import first_by

CODES = "ord int, code string, full_name string, times_per_day int, default_times array<string>"
#: Codes a dictionary may have to be turned into expressions.
MOST_CODES = 1000


def _read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame | None:
    """The columns of a Parquet table, which is read once to see whether it can be; None where it cannot, whatever the reason."""
    try:
        rows = spark.read.parquet(path).select(*columns)
        rows.agg(*[F.bit_xor(F.xxhash64(c)) for c in columns]).collect()
    except (PySparkException, Py4JJavaError):
        return None
    return rows


def medicine_names(spark: SparkSession, path: str, fallback: list[str] | None = None) -> DataFrame:
    """(dict_idx, name) of a Parquet dictionary; of ``fallback`` where it cannot be read."""
    rows = _read(spark, path, ["dict_idx", "name"])
    if rows is None and fallback is None:
        return spark.read.parquet(path).select("dict_idx", "name")  # fails as it should
    return spark.createDataFrame(list(enumerate(fallback)), "dict_idx long, name string") if rows is None else rows


def frequency_codes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The frequency dictionary, null lists as empty ones; the built-in one without a readable path."""
    rows = _read(spark, path, [c.split()[0] for c in CODES.split(", ")]) if path else None
    if rows is None:
        rows = spark.createDataFrame(fixed.FREQUENCIES, CODES)
    return rows.withColumn("default_times", F.coalesce("default_times", F.expr("cast(array() as array<string>)")))


def code_rows(codes: DataFrame) -> Codes:
    """The dictionary on the driver, for generated expressions; it has a few dozen rows and is refused beyond MOST_CODES."""
    rows = codes.orderBy("ord").limit(MOST_CODES + 1).collect()
    if len(rows) > MOST_CODES:
        raise ValueError(f"a frequency dictionary may have at most {MOST_CODES} codes")
    return [(r["ord"], r["code"], r["full_name"], r["times_per_day"], list(r["default_times"])) for r in rows]


def upserted(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``new`` rows, and ``old`` ones whose key is not among them; of equal new keys the last in ``order``.

    Applying it again changes nothing.
    """
    latest = first_by(new, [key], [F.desc(c) for c in order])
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


def size(dictionary: DataFrame) -> int:
    """C8, S15."""
    return dictionary.count()
