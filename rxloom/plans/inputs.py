"""Prescription-shaped inputs derived from the star schema.

Expressions are SQL that Spark and DuckDB read alike, so that both engines see the same
rows. An order is a prescription and its line items are its lines; ``line_no`` numbers
them in an order without ties, because (l_orderkey, l_linenumber) is not a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.operators.rasters import STRIP, mapped

_PICK = lambda by, values: f"(CASE {by} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END)"
_TEXTS = lambda *words: [f"'{w}'" for w in words]

RANK = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)"
MIX = "(l_partkey + 3 * l_suppkey + 5 * line_no)"
MARK = _PICK("k % 5", ["concat(cast(line_no AS string), '. ')", "'- '", "''"])
FORM = _PICK("k % 6", _TEXTS("Tab ", "Cap. ", "Inj ", "Syrup ", ""))
DOSE = _PICK("k % 8", ["concat(cast(50 * (1 + k % 9) AS string), 'mg')", "concat(cast(1 + k % 4 AS string), '.5 g')", "'60,000 IU'", "'0.5%'", "'10ml'", "'250 MCG'", "''"])
FREQ = _PICK("k % 19", _TEXTS("OD", "BD", "TDS", "1-0-1", "1 - 1 - 1", "2-0-2", "twice a day", "twice daily", "at bedtime", "SOS", "Q6H", "weekly", "every morning", "hs", "daily", "four times", "0-0-1", "STAT", ""))
SPAN = _PICK("k % 11", _TEXTS("x 5 days", "for 2 weeks", "1 month", "5/7", "1/52", "10 d", "x7d", "3 months", "for 12 days", ""))
WHEN = _PICK("k % 7", _TEXTS("after food", "before breakfast", "with water", "with meal", "before sleep", ""))
LINE = (
    "CASE WHEN rx_id % 13 = 0 THEN concat('Tab ', p_name) WHEN k % 31 = 0 THEN 'Tel: 555-0100 ext 12' WHEN k % 37 = 0 THEN '*** refill twice ***' "
    "WHEN k % 41 = 0 THEN 'Page 2 of 3' WHEN k % 43 = 0 THEN 'Address 12 Main Street 500mg' WHEN k % 47 = 0 THEN 'ab' "
    f"ELSE concat({MARK}, {FORM}, p_name, ' ', {DOSE}, ' ', {FREQ}, ' ', {SPAN}, ' ', {WHEN}) END"
)
CONF = "CAST(50 + rx_id % 50 AS double) / 100"
LETTERS = "translate(cast({} AS string), '0123456789', 'abcdefghij')"
HEAD = (
    f"concat('Dr. S', {LETTERS.format('o_orderkey % 100')}, chr(10), 'Patient: P', {LETTERS.format('o_custkey')}, ' Q', {LETTERS.format('o_orderkey % 7')}, chr(10), "
    "'Date: ', cast(1 + o_orderkey % 28 AS string), '/', cast(1 + o_orderkey % 12 AS string), '/2024', chr(10), "
    "CASE o_orderkey % 3 WHEN 0 THEN 'City Hospital Ward 4, Main Road' WHEN 1 THEN 'Health Centre' ELSE '' END)"
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rx_id, line_no, line, ocr_conf."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_partkey", "l_suppkey", f"{RANK} AS line_no")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey AS rx_id", "line_no", f"{MIX} AS k", "p_name")
    # exploding one value keeps later filters from writing out the long expression again
    return rows.selectExpr("rx_id", "line_no", f"explode(array(trim({LINE}))) AS line", f"{CONF} AS ocr_conf")


LINES_SQL = f"""lines AS (
  SELECT rx_id, line_no, trim({LINE}) AS line, {CONF} AS ocr_conf FROM (
    SELECT l_orderkey AS rx_id, line_no, {MIX} AS k, p_name
    FROM (SELECT *, CAST({RANK} AS INTEGER) AS line_no FROM lineitem) JOIN part ON l_partkey = p_partkey))"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rx_id, text (header and lines), ocr_conf, start_date of all orders."""
    body = lines(spark, sf_dir).groupBy("rx_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("body"))
    heads = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS rx_id", f"{HEAD} AS head", "CAST(o_orderdate AS date) AS start_date")
    return heads.join(body, "rx_id", "left").selectExpr("rx_id", "concat(head, chr(10), coalesce(body, '')) AS text", f"{CONF} AS ocr_conf", "start_date")


DOCUMENTS_SQL = f"""{LINES_SQL},
docs AS (
  SELECT rx_id, concat(head, chr(10), coalesce(body, '')) AS text, {CONF} AS ocr_conf, start_date
  FROM (SELECT o_orderkey AS rx_id, {HEAD} AS head, CAST(o_orderdate AS date) AS start_date FROM orders)
  LEFT JOIN (SELECT rx_id, string_agg(line, chr(10) ORDER BY line_no) AS body FROM lines GROUP BY rx_id) USING (rx_id))"""


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dict_idx, name: the distinct part names, numbered by their smallest key."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("dict_idx")).select("dict_idx", "name")


#: jittered confidence; the word engine reads nothing of some prescriptions, and some are read badly by both
WORD_CONF = "CAST(CASE WHEN rx_id % 3 = 0 THEN -1 WHEN rx_id % 7 = 6 THEN (rx_id + 7 * line_no + 11 * i + 13 * variant) % 49 ELSE (rx_id + 7 * line_no + 11 * i + 13 * variant) % 102 - 1 END AS int)"
#: words of each line; the engine's line number repeats every four lines
WORDS_SQL = f"""{LINES_SQL},
words AS (
  SELECT rx_id, CAST(variant AS INTEGER) AS variant_idx, CAST(line_no * 100 + i AS INTEGER) AS word_idx, w AS text,
    {WORD_CONF} AS conf, CAST(line_no // 2 % 4 AS INTEGER) AS line_num
  FROM (SELECT rx_id, line_no, variant, unnest(string_split(line, ' ')) AS w, unnest(range(0, len(string_split(line, ' ')))) AS i
    FROM lines, (SELECT unnest(range(0, 2)) AS variant)))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rx_id, variant_idx, word_idx, text, conf, line_num: two variants of the words of all prescriptions."""
    # lines come together by prescription before they become words, so that words needn't be dealt out; a fixed number of parts, as they grow
    rows = lines(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rx_id")
    rows = rows.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.select("rx_id", "line_no", "variant", F.posexplode(F.split("line", " ")).alias("i", "w"))
    return rows.selectExpr("rx_id", "variant AS variant_idx", "line_no * 100 + i AS word_idx", "w AS text", f"{WORD_CONF} AS conf", "CAST(line_no div 2 % 4 AS int) AS line_num")


#: the same words as boxes: lines 20 apart, jitter within a line, words from left to right
BOX = {"x0": "CAST(word_idx % 100 * 40 AS double)", "y0": "CAST(word_idx // 100 * 20 + (rx_id + word_idx * 3) % 7 AS double)"}
BOXES_SQL = f"""{WORDS_SQL},
boxes AS (SELECT rx_id, variant_idx, word_idx AS box_idx, {BOX["x0"]} AS x, {BOX["y0"]} AS y, CAST(10 + word_idx % 5 AS double) AS tall, text, CAST(greatest(conf, 0) AS double) / 100 AS conf FROM words)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words(spark, sf_dir).selectExpr("rx_id", "variant_idx", "word_idx AS box_idx", f"{BOX['x0']} AS x", f"{BOX['y0'].replace('//', 'div')} AS y", "CAST(10 + word_idx % 5 AS double) AS tall", "text", "CAST(greatest(conf, 0) AS double) / 100 AS conf")
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return rows.select("rx_id", "variant_idx", "box_idx", F.array(corner(0, 0), corner(30, 0), corner(30, F.col("tall")), corner(0, F.col("tall"))).alias("bbox"), "text", "conf")


#: a grey image a supplier: slanted lines of dark blocks and a long rule on a ground that darkens to the right; every tenth is empty, every eleventh of one value
RASTER_WIDTH, RASTER_HEIGHT = 160, 64
SLANT = "(y + (x * (k % 7 - 3) + 4000) div 40 - 100 + 8)"
INK = f"(k % 10 <> 0 AND (x >= 12 AND x < 12 + 60 + k % 80 AND {SLANT} % 16 >= 6 AND {SLANT} % 16 < 10 AND (x div 5 + {SLANT} div 16 * 3 + k) % 4 <> 0 OR x >= 4 AND x < 156 AND k % 3 < 2 AND ({SLANT} = 46 + k % 4 OR {SLANT} = 47 + k % 4)))"
PIXEL = f"CAST(CASE WHEN k % 11 = 0 THEN 128 WHEN {INK} THEN 40 + (x * 7 + y * 3 + k) % 31 ELSE 205 + (x + 2 * y + k) % 23 - x div 8 END AS int)"
RASTERS_SQL = f"""pixels AS MATERIALIZED (
  SELECT k AS image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {PIXEL.replace("div", "//")} AS v
  FROM (SELECT s_suppkey AS k FROM supplier), (SELECT unnest(range({RASTER_WIDTH})) AS x), (SELECT unnest(range({RASTER_HEIGHT})) AS y))"""


#: Images that a task makes.
IMAGES = 128


def pixels(keys: np.ndarray) -> np.ndarray:
    """PIXEL of all places of the images, by (image, y, x). Quotients are cut and remainders have their sign, as in SQL, where numbers below 0 matter."""
    if keys.min(initial=0) < 0:
        rem, quo = np.fmod, lambda a, b: (a - np.fmod(a, b)) // b
    else:
        # slants below 0 aren't ink either way
        rem, quo = lambda a, b: a - a // b * b, np.floor_divide
    k, y, x = keys.astype(np.int64)[:, None, None], np.arange(RASTER_HEIGHT)[None, :, None], np.arange(RASTER_WIDTH)[None, None, :]
    slant = y + (quo(x * (rem(k, 7) - 3) + 4000, 40) - 92)
    row, within = quo(slant, 16), rem(slant, 16)
    block = (x >= 12) & (x < 72 + rem(k, 80)) & (within >= 6) & (within < 10) & (rem(x // 5 + row * 3 + k, 4) != 0)
    rule = 46 + rem(k, 4)
    ink = (rem(k, 10) != 0) & (block | (x >= 4) & (x < 156) & (rem(k, 3) < 2) & ((slant == rule) | (slant == rule + 1)))
    out = np.where(ink, 40 + rem(x * 7 + y * 3 + k, 31), 205 + rem(x + 2 * y + k, 23) - x // 8)
    return np.where(rem(k, 11) == 0, 128, out).astype(np.int32)


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height, y, px: a strip for each line of the images. Keys are few bytes for many pixels, so they are dealt out by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for at in range(0, t.num_rows, 32):
                keys = t["k"].slice(at, 32).to_numpy()
                lines = len(keys) * RASTER_HEIGHT
                px = pa.ListArray.from_arrays(pa.array(np.arange(0, (lines + 1) * RASTER_WIDTH, RASTER_WIDTH, dtype=np.int32)), pa.array(pixels(keys).ravel()))
                sizes = [pa.array(np.full(lines, n, dtype=np.int32)) for n in (RASTER_WIDTH, RASTER_HEIGHT)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, RASTER_HEIGHT)), *sizes, pa.array(np.tile(np.arange(RASTER_HEIGHT, dtype=np.int32), len(keys))), px], ["image_id", "width", "height", "y", "px"])

    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    return mapped(keys.repartition(max(1, -(-keys.count() // IMAGES))), run, STRIP)
