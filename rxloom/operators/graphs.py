"""Connected components of links that are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected(links: DataFrame, folder: str) -> DataFrame:
    """(node, component) of every end of ``links`` (a, b): component is the smallest node that it reaches.

    Each round hangs the neighbours of a node on the smallest of them, larger ones
    first and smaller ones then, until the links stay as they are; a round moves each
    link once, keyed by a node. Rounds are written to ``folder``, which cuts the
    lineage. Null ends and loops are left out.
    """
    spark = links.sparkSession

    def kept(rows: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        rows.filter("a > b").distinct().write.mode("overwrite").parquet(f"{folder}/{k % 2}")
        rows = spark.read.parquet(f"{folder}/{k % 2}")
        return rows, tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    def hung(rows: DataFrame) -> DataFrame:
        """Each neighbour of a node, and the node, on the smallest of them; of links (node, other)."""
        least = rows.groupBy("node").agg(F.min("other").alias("low"))
        return rows.join(least.select("node", F.least("node", "low").alias("low")), "node")

    k = 0
    rows, state = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), k)
    while state[0]:
        k += 1
        both = rows.select(F.col("a").alias("node"), F.col("b").alias("other")).union(rows.select("b", "a"))
        large = hung(both).filter("other > node").select(F.col("other").alias("a"), F.col("low").alias("b"))
        small = hung(large.distinct().select(F.col("a").alias("node"), F.col("b").alias("other")))
        pairs = F.array(F.struct(F.col("node").alias("a"), F.col("low").alias("b")), F.struct(F.col("other").alias("a"), F.col("low").alias("b")))
        rows, now = kept(small.select(F.explode(pairs).alias("p")).select("p.a", "p.b"), k)
        if now == state:
            break
        state = now
    return rows.select(F.col("a").alias("node"), F.col("b").alias("component")).union(rows.select("b", "b").distinct())
