"""Shared pieces of the corpus operators: tables, scratch space, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Edges that are connected in one step, by one task; more take the rounds of ``components``.
FEW_EDGES = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="rxloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Intermediate tables in the shared folder.

    Writing one cuts the lineage, so a lost executor costs a reread and no
    recomputation. They go when the application ends, or with ``drop``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._fs("deleteOnExit", self.base)

    def _fs(self, call: str, path: str, *more: bool) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(where) if call == "deleteOnExit" else None
        getattr(fs, call)(where, *more)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it read again."""
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, name: str) -> None:
        """Deletes a table that nothing will read any more."""
        self._fs("delete", f"{self.base}/{name}", True)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the edges (u, v) of a task each node with the smallest of its component."""
    up: dict[int, int] = {}

    def root(n: int) -> int:
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            low, high = sorted((root(up.setdefault(u, u)), root(up.setdefault(v, v))))
            up[high] = low
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(up), [root(n) for n in up])], ["node", "component"])


def components(scratch: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (node, component), component being the smallest node.

    Alternates the large-star and small-star steps until the edges no longer
    change. Each step moves every edge once and keys it by a node, so a hub
    is an ordinary skewed join, which adaptive execution splits. Nodes without
    links don't appear; null ends and loops are ignored. Up to FEW_EDGES edges
    are connected by one task instead: each round's plans stay in the driver's
    memory for a while, whatever their size.
    """
    edges = scratch.save(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges-0"
    )

    def state(df: DataFrame) -> tuple:
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()

    seen, step = state(edges), 0
    if seen[0] <= FEW_EDGES:
        return scratch.save(edges.coalesce(1).mapInArrow(_stars, "node long, component long"), "components")
    while seen[0]:
        step += 1
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = scratch.save(small.select("e.*").filter("u > v").distinct(), f"edges-{step}")
        scratch.drop(f"edges-{step - 1}")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return scratch.save(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()), "components")
