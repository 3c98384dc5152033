"""Logged conversations as training text, without the snapshots that longer ones contain.

A log keeps a conversation after every turn, so that most rows repeat the beginning of a
longer conversation. Rolling hashes of turn prefixes find them: a conversation whose whole
hash is the hash of a proper prefix of another is dropped by an anti-join, and of equal
conversations the one of the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one conversation that are sorted together.
BLOCK = 256


def _hashes(rank: str = "pos") -> list[Column]:
    """Two 64-bit hashes of a turn at its place; prefixes are hashed by xor over these. Nulls are told from any text by a flag."""
    turn = [F.col(rank), *[x for c in ("role", "text") for x in (F.isnull(c), F.coalesce(c, F.lit("")))]]
    return [F.xxhash64(*turn).alias("h1"), F.xxhash64(F.lit("second"), *turn).alias("h2")]


def numbered(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, turn, role, text with pos (from 0, by turn, role, text) and blk.

    Positions are ranks within blocks of turn numbers plus the sizes of the
    blocks before, so that a conversation of any length is sorted piece by piece.
    """
    rows = turns.withColumn("blk", F.floor(F.coalesce("turn", F.lit(-1)) / block))
    sizes = rows.groupBy("conv", "blk").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("conv").orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    sizes = sizes.select("conv", "blk", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv", "blk").orderBy("turn", "role", "text"))
    rows = rows.withColumn("inside", inside - 1).join(sizes, ["conv", "blk"])
    return rows.select("conv", "turn", "role", "text", "blk", (F.col("before") + F.col("inside")).alias("pos"))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, pos, p1, p2: the hash of the turns up to each position, by blocks like ``numbered``."""
    rows = rows.select("conv", "blk", "pos", *_hashes())
    whole = rows.groupBy("conv", "blk").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    earlier = Window.partitionBy("conv").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv", "blk", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"e{c[1]}") for c in ("b1", "b2")])
    upto = Window.partitionBy("conv", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv", "blk", "pos", *[F.bit_xor(c).over(upto).alias(c) for c in ("h1", "h2")])
    return rows.join(whole, ["conv", "blk"]).select("conv", "pos", F.col("h1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("e2")).alias("p2"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def maximal(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """conv, turn, pos, role, text of the conversations that are no prefix of another.

    A conversation is its turns in order of (turn, role, text), compared by place,
    role and text; turn numbers themselves may differ. Repeated rows are turns
    of their own; null turns come first, a null role or text equals only a null;
    rows without a conversation id belong to none and are left out.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = numbered(rows.filter("conv is not null"), block)
    ends = rows.select("conv", "pos", *_hashes()).groupBy("conv").agg(F.max("pos").alias("last"), F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"))
    steps = prefixes(rows)
    inner = steps.join(ends.select("conv", "last"), "conv").filter("pos < last").select("p1", "p2", F.col("pos").alias("last")).distinct()
    kept = ends.groupBy("p1", "p2", "last").agg(F.min("conv").alias("conv")).join(inner, ["p1", "p2", "last"], "left_anti")
    return rows.join(kept.select("conv"), "conv", "left_semi").select("conv", "turn", "pos", "role", "text")


def op4_chat_format(spark, sf_dir) -> DataFrame:
    """conv_id, pos, role, rendered: the maximal conversations of all of ``conversations``, a row per turn.

    A conversation's text is its rows' ``rendered`` in order of ``pos``; rows stay
    apart because a conversation may be of any length.
    """
    found = maximal(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.select(F.col("conv").alias("conv_id"), "pos", "role", rendered(F.col("role"), F.col("text")).alias("rendered"))


OP4_SQL = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, list(struct_pack(rn := role IS NULL, r := coalesce(role, ''), xn := text IS NULL, x := coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY pos) AS l, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
e AS (SELECT l, min(conv_id) AS conv_id FROM p WHERE pos = n - 1 GROUP BY l),
k AS (SELECT conv_id FROM e WHERE l NOT IN (SELECT l FROM p WHERE pos < n - 1))
SELECT conv_id, pos, role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered FROM t WHERE conv_id IN (SELECT conv_id FROM k)
"""
