"""Interleaving sources to target weights as a Pfair schedule of blocks.

Each source is cut into blocks of ``block_chars`` characters. With weight w out of a
total W, block j of a source is released at slot floor(j * W / w) and due by slot
ceil((j + 1) * W / w); each slot takes, of the released blocks, the one that is due
first. Every block then runs within its window, so after any number of slots each
source is less than one block away from its target share. A document longer than what
is left of its block goes on in the next ones, so it is given out in parts, one for each
of its blocks; read by parts, the mix stays within one block after every part. Weights are whole numbers,
so the schedule repeats after W slots: one such period is worked out from the weights
alone, and the slot of any block of any document follows by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Target weights of the registered query; every other source, or none, shares OTHER.
WEIGHTS = {f"src{k}": 1 + k % 4 for k in range(20)}
OTHER = 1
BLOCK_CHARS = 1 << 16
#: Rows that one sorted bucket of one source holds at most, about, and buckets that are summed up together.
BUCKET_ROWS, BUCKETS = 1_000, 1_000


def release(block: int, weight: int, total: int) -> int:
    return block * total // weight


def deadline(block: int, weight: int, total: int) -> int:
    return -(-(block + 1) * total // weight)


def period(weights: list[int]) -> list[int]:
    """For each of sum(weights) slots the index of the source that runs; ties in deadline go to the first source."""
    if not weights or min(weights) < 1:
        raise ValueError("weights must be whole numbers of at least 1")
    total, done, out = sum(weights), [0] * len(weights), []
    for slot in range(total):
        ready = [i for i, w in enumerate(weights) if done[i] < w and release(done[i], w, total) <= slot]
        pick = min(ready, key=lambda i: (deadline(done[i], weights[i], total), i))
        done[pick] += 1
        out.append(pick)
    return out


def before(sums: DataFrame, keys: list[str], at: str, value: str, together: int = BUCKETS) -> DataFrame:
    """``sums`` (keys, at, value) with ``before``: the sum of the values of smaller ``at`` of the same keys.

    Runs of ``together`` places are summed first, so that no task orders more than a fraction of a key's rows.
    """
    sums = sums.withColumn("run_", F.floor(F.col(at) / together))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.groupBy(*keys, "run_").agg(F.sum(value).alias("whole_"))
    runs = runs.select(*keys, "run_", F.coalesce(F.sum("whole_").over(upto(*keys).orderBy("run_")), F.lit(0)).alias("runs_"))
    inside = F.coalesce(F.sum(value).over(upto(*keys, "run_").orderBy(at)), F.lit(0))
    return sums.withColumn("inside_", inside).join(runs, [*keys, "run_"]).select(*keys, at, (F.col("runs_") + F.col("inside_")).alias("before"))


def mixed(rows: DataFrame, weights: dict[str, int], other: int = OTHER, block_chars: int = BLOCK_CHARS, id_col: str = "id", source_col: str = "source", chars_col: str = "chars") -> DataFrame:
    """``rows`` with start (the row's first character within its source), block and slot, last_block and last_slot, and parts.

    A row begins in the block of its first character and ends in that of its
    last; one without characters is where it starts. ``parts`` has slot, offset
    and chars of what each of its blocks holds of it: together all of it, in order.
    The order within a source is a fixed scatter of the id, then the id, then the
    length. Reading all parts by (slot, start + offset, id) is the mix; sources
    without a row get no slots, those that end early leave theirs empty, and no
    character is dropped or repeated. Null or unlisted sources share the weight
    ``other``; null lengths count as 0 and null ids as id 0; repeated rows
    follow each other. Names of other columns may be any but those added here.

    A source may hold any share of the rows: each is dealt into buckets by
    ranges of the scattered id, sums of buckets give offsets, and only rows of
    one bucket are sorted together.
    """
    spark = rows.sparkSession
    names = [*weights, None]
    sizes = [*weights.values(), other]

    index = F.lit(len(weights))
    for i, name in enumerate(names[:-1]):
        index = F.when(F.col(source_col) == name, i).otherwise(index)
    # as many rows as there are weights at most
    counts = dict(rows.groupBy(index.alias("i")).count().collect())
    buckets, present = max(1, -(-sum(counts.values()) // BUCKET_ROWS)), sorted(counts) or [0]
    total, own = sum(sizes[i] for i in present), {i: [] for i in present}
    for slot, k in enumerate(period([sizes[i] for i in present])):
        own[present[k]].append(slot)
    # a row for each weight; together they have as many numbers as the weights sum up to
    slots = F.broadcast(spark.createDataFrame(list(own.items()), "mix_source int, mix_slots array<bigint>"))
    at = F.pmod(F.pmod(F.coalesce(F.col(id_col), F.lit(0)).cast("long"), F.lit(1 << 31)) * 2654435761, F.lit(1 << 32))
    rows = rows.withColumns({"mix_source": index, "mix_at": at, "mix_chars": F.coalesce(F.col(chars_col), F.lit(0)).cast("long")})
    rows = rows.withColumn("mix_bucket", F.expr(f"mix_at * {buckets} div {1 << 32}"))
    sums = before(rows.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_chars").alias("mix_sum")), ["mix_source"], "mix_bucket", "mix_sum")
    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_at", id_col, "mix_chars").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("mix_inside", F.sum("mix_chars").over(inside) - F.col("mix_chars"))
    rows = rows.join(sums.withColumnRenamed("before", "mix_before"), ["mix_source", "mix_bucket"]).withColumn("start", F.col("mix_before") + F.col("mix_inside"))
    rows = rows.withColumns({"block": F.expr(f"start div {block_chars}"), "last_block": F.expr(f"(start + greatest(mix_chars, 1) - 1) div {block_chars}")})
    slot = "{0} div size(mix_slots) * " + str(total) + " + element_at(mix_slots, cast({0} % size(mix_slots) as int) + 1)"
    first, last = f"greatest(b * {block_chars}, start)", f"least((b + 1) * {block_chars}, start + mix_chars)"
    parts = f"transform(sequence(block, last_block), b -> struct({slot.format('b')} as slot, {first} - start as offset, {last} - {first} as chars))"
    rows = rows.join(slots, "mix_source").withColumns({"slot": F.expr(slot.format("block")), "last_slot": F.expr(slot.format("last_block")), "parts": F.expr(parts)})
    return rows.drop("mix_source", "mix_at", "mix_chars", "mix_bucket", "mix_before", "mix_inside", "mix_slots")


def op10_source_mixing(spark, sf_dir) -> DataFrame:
    """doc_id, source, start, block, slot, last_block, last_slot, parts (slot:offset:chars of each) of all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    found = mixed(docs, WEIGHTS, id_col="doc_id", chars_col="n_chars")
    told = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["slot"], p["offset"], p["chars"])), ",")
    return found.select("doc_id", "source", "start", "block", "slot", "last_block", "last_slot", told.alias("parts"))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their columns and mix_start, mix_block, mix_slot, mix_last_slot and mix_parts, which replace columns of these names."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "n_chars")
    found = mixed(packed, WEIGHTS, id_col="doc_id", chars_col="n_chars")
    added = {"mix_start": "start", "mix_block": "block", "mix_slot": "slot", "mix_last_slot": "last_slot", "mix_parts": "parts"}
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in added]
    return found.select(*kept, *[F.col(v).alias(k) for k, v in added.items()])


_SIZES = [*WEIGHTS.values(), OTHER]
OP10_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(n_chars, 0) AS c,
    CASE source {" ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(WEIGHTS, 1))} ELSE {len(_SIZES)} END AS src,
    ((coalesce(doc_id, 0) & 2147483647) * 2654435761) & 4294967295 AS h
  FROM documents),
w AS (SELECT ws, list_sum(ws) AS total FROM (SELECT list_transform(range(1, {len(_SIZES) + 1}), lambda i: CASE WHEN list_contains(here, i) THEN {_SIZES}[i] ELSE 0 END) AS ws FROM (SELECT list(DISTINCT src) AS here FROM d))),
s(t, n, pick) AS (
  SELECT 0, list_transform(ws, lambda x: 0), 0 FROM w
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(ws) + 1), lambda i: n[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT t, n, ws, list_min(list_transform(range(1, len(ws) + 1), lambda i:
      CASE WHEN ws[i] > 0 AND n[i] * total // ws[i] <= t THEN (((n[i] + 1) * total + ws[i] - 1) // ws[i]) * 1000 + i ELSE 1000000000 END)) % 1000 AS p
    FROM s, w WHERE t < total)),
slots AS (SELECT pick AS src, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j, t - 1 AS slot FROM s WHERE t > 0),
b AS (SELECT *, CAST(sum(c) OVER (PARTITION BY src ORDER BY h, doc_id NULLS FIRST, c ROWS UNBOUNDED PRECEDING) - c AS BIGINT) AS start FROM d),
e AS (SELECT *, start // {BLOCK_CHARS} AS block, (start + greatest(c, 1) - 1) // {BLOCK_CHARS} AS last_block, ws[src] AS wt, total FROM b, w)
SELECT doc_id, source, start, block, CAST(block // wt * total + f.slot AS BIGINT) AS slot, last_block, CAST(last_block // wt * total + l.slot AS BIGINT) AS last_slot,
  (SELECT string_agg(CAST(b // wt * total + p.slot AS BIGINT) || ':' || (greatest(b * {BLOCK_CHARS}, start) - start) || ':' || (least((b + 1) * {BLOCK_CHARS}, start + c) - greatest(b * {BLOCK_CHARS}, start)), ',' ORDER BY b)
    FROM (SELECT unnest(range(block, last_block + 1)) AS b) JOIN slots p ON p.src = e.src AND p.j = b % wt) AS parts
FROM e JOIN slots f ON e.src = f.src AND f.j = e.block % e.wt JOIN slots l ON e.src = l.src AND l.j = e.last_block % e.wt
"""
