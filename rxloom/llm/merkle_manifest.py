"""A Merkle manifest of a dataset: a tree per language over document hashes, and one over the languages.

Leaves are ranked by Spark. Aligned buckets of ``BUCKET`` nodes, a power of the fan-out,
are whole subtrees; an executor gets one as an Arrow table, and DuckDB hashes it level by
level with ``string_agg`` in order and ``sha256``. The roots of buckets are the nodes of
the next round, of which there are as many as the logarithm of the largest language, and
the roots of languages those of the last. On the way down each node's path (what stands
to its left and right among its siblings, by level) is joined with that of its bucket,
and in a second pass DuckDB adds the outer path to the inner one and folds every leaf.
"""

from __future__ import annotations

from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxloom.llm.common import Scratch

FAN = 8
#: Nodes of a bucket: a power of FAN, so that buckets are aligned with the tree.
BUCKET = FAN**4
_HEX = 64
PATH = "array<struct<l:string,r:string>>"
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """UTF-8 byte count, colon and value; a dash for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(row: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(row[c]) for c in LEAF_COLUMNS]).cast("binary"), 256))


def height(nodes: int, fan: int = FAN) -> int:
    """Levels above ``nodes`` nodes until one remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fan), levels + 1
    return levels


def ranked(scratch: Scratch, rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with i, the place in ``order`` among those of a ``group``, and n, how many there are.

    Rows are dealt by ranges, so a group of any size is in as many tasks as its share
    of the rows; counts by range and group give the offsets. ``rows`` must be slim.
    """
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(rows.repartitionByRange(parts, F.col(group).asc_nulls_first(), *order).withColumn("part_", F.spark_partition_id()), name)
    sizes = dealt.groupBy(group, "part_").agg(F.count(F.lit(1)).alias("n_"))
    # a row for each range that a group is in
    whole = Window.partitionBy(group)
    sizes = sizes.select(F.col(group).alias("g_"), F.col("part_").alias("p_"), F.coalesce(F.sum("n_").over(whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("n_").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "part_").orderBy(*order)) - 1
    placed = dealt.withColumn("inside_", inside).join(sizes, F.col(group).eqNullSafe(F.col("g_")) & (F.col("part_") == F.col("p_")))
    return placed.withColumn("i", F.col("inside_") + F.col("before_")).drop("inside_", "before_", "g_", "p_", "part_")


@cache
def _engine() -> duckdb.DuckDBPyConnection:
    """One in-memory DuckDB a worker, on the task's own thread; it has nowhere to spill."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "512MB"})


def _levels(db: duckdb.DuckDBPyConnection, nodes: pa.Table, levels: int, fan: int) -> None:
    """Tables level1 to level<levels>: i, s (the children's hashes joined in order) and h."""
    db.register("level0", nodes)
    for k in range(1, levels + 1):
        db.execute(f"CREATE OR REPLACE TEMP TABLE level{k} AS SELECT i, s, sha256(s) AS h FROM (SELECT i // {fan} AS i, string_agg(h, '' ORDER BY i) AS s FROM level{k - 1} GROUP BY i // {fan})")


def _sides(k: int, i: str, fan: int) -> tuple[str, str]:
    """SQL for what stands left and right of node ``i`` of level ``k - 1`` in the string of its parent, level ``k``."""
    at = f"({i} % {fan}) * {_HEX}"
    return f"substring(level{k}.s, 1, {at})", f"substring(level{k}.s, {at} + {_HEX} + 1)"


def climbed(nodes: DataFrame, bucket: int, fan: int) -> DataFrame:
    """One round: of nodes (g, i, h, n) those with their path within the bucket, and i and h of the bucket's root as up, root."""
    steps = height(bucket, fan)

    def work(batch: pa.Table) -> pa.Table:
        db, size = _engine(), batch["n"][0].as_py()
        levels = min(steps, height(size, fan))
        _levels(db, batch.select(["i", "h"]), levels, fan)
        pairs, joins = [], []
        for k in range(1, levels + 1):
            left, right = _sides(k, f"(b.i // {fan ** (k - 1)})", fan)
            pairs.append(f"{{'l': {left}, 'r': {right}}}")
            joins.append(f"JOIN level{k} ON level{k}.i = b.i // {fan**k}")
        path = f"[{', '.join(pairs)}]" if pairs else "CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[])"
        root = f"(SELECT h FROM level{levels})"
        db.register("b", batch)
        return db.sql(f"SELECT b.g, b.i, {path} AS path, b.i // {bucket} AS up, {root} AS root, b.n FROM b {' '.join(joins)}").to_arrow_table()

    rows = nodes.select("g", "i", "h", "n").withColumn("bucket", F.expr(f"i div {bucket}"))
    return rows.groupBy("g", "bucket").applyInArrow(work, f"g long, i long, path {PATH}, up long, root string, n long")


def rooted(nodes: DataFrame, bucket: int, fan: int) -> DataFrame:
    """(g, i, h, n) of the roots of the buckets of ``nodes``; only they leave the task."""
    steps = height(bucket, fan)

    def work(batch: pa.Table) -> pa.Table:
        db, size = _engine(), batch["n"][0].as_py()
        levels = min(steps, height(size, fan))
        _levels(db, batch.select(["i", "h"]), levels, fan)
        g, i = batch["g"][0].as_py(), batch["i"][0].as_py() // bucket
        ((h,),) = db.execute(f"SELECT h FROM level{levels}").fetchall()
        return pa.table({"g": pa.array([g], pa.int64()), "i": pa.array([i], pa.int64()), "h": [h], "n": pa.array([-(-size // bucket)], pa.int64())})

    rows = nodes.select("g", "i", "h", "n").withColumn("bucket", F.expr(f"i div {bucket}"))
    return rows.groupBy("g", "bucket").applyInArrow(work, "g long, i long, h string, n long")


def _to_root(scratch: Scratch, nodes: DataFrame, rounds: int, bucket: int, fan: int, name: str) -> DataFrame:
    """(g, i, path, root) of ``nodes`` (g, i, h, n): paths up to the root of their group, after ``rounds`` rounds."""
    layers = []
    for k in range(rounds):
        layers.append(scratch.save(climbed(nodes, bucket, fan), f"{name}-{k}"))
        firsts = layers[-1].filter(f"i % {bucket} = 0")
        nodes = firsts.select("g", F.col("up").alias("i"), F.col("root").alias("h"), F.expr(f"(n + {bucket} - 1) div {bucket}").alias("n"))
    whole = layers[-1].select("g", "i", "path", "root")
    for low in reversed(layers[:-1]):
        high = whole.select("g", F.col("i").alias("up"), F.col("path").alias("more"), F.col("root").alias("top"))
        whole = low.join(high, ["g", "up"]).select("g", "i", F.concat("path", "more").alias("path"), F.col("top").alias("root"))
    return whole


def folded(leaves: DataFrame, outer: DataFrame, bucket: int, fan: int) -> DataFrame:
    """One row per leaf (g, i, n, h, t, doc_id): doc_id, leaf, subroot, root, proof (hash of all siblings), folded (the root from t, or else h, and the siblings).

    ``outer`` (g, bucket, path, subroot, root) has what is above the buckets.
    """
    steps = height(bucket, fan)

    def work(batch: pa.Table, above: pa.Table) -> pa.Table:
        db = _engine()
        levels = min(steps, height(batch["n"][0].as_py(), fan))
        _levels(db, batch.select(["i", "h"]), levels, fan)
        db.register("b", batch)
        db.execute("CREATE OR REPLACE TEMP TABLE f0 AS SELECT i, coalesce(t, h) AS cur, '' AS proof FROM b")
        for k in range(1, levels + 1):
            left, right = _sides(k, f"(f.i // {fan ** (k - 1)})", fan)
            db.execute(f"CREATE OR REPLACE TEMP TABLE f1 AS SELECT f.i, sha256({left} || f.cur || {right}) AS cur, f.proof || {left} || {right} AS proof FROM f0 f JOIN level{k} ON level{k}.i = f.i // {fan**k}")
            db.execute("CREATE OR REPLACE TEMP TABLE f0 AS FROM f1")
        pairs, cur = [(x["l"], x["r"]) for x in above["path"][0].as_py()], "cur"
        for _ in pairs:
            cur = f"sha256(? || {cur} || ?)"
        # the lowest level's sides stand innermost, so they come in the order of the question marks
        values = [a for a, _ in reversed(pairs)] + [b for _, b in pairs]
        values += ["".join(a + b for a, b in pairs), above["subroot"][0].as_py(), above["root"][0].as_py()]
        return db.sql(f"SELECT doc_id, h AS leaf, {cur} AS folded, sha256(proof || ?) AS proof, ? AS subroot, ? AS root FROM f0 JOIN b USING (i)", params=values).to_arrow_table()

    kind = leaves.schema["doc_id"].dataType.simpleString()
    rows = leaves.withColumn("bucket", F.expr(f"i div {bucket}"))
    return rows.groupBy("g", "bucket").cogroup(outer.groupBy("g", "bucket")).applyInArrow(work, f"doc_id {kind}, leaf string, folded string, proof string, subroot string, root string")


def manifest(docs: DataFrame, tampered: Column | None = None, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof, folded, verified.

    ``tampered`` says of which documents the text's A-Z are lowered before folding.
    Null values hash as a dash. Languages go null first, then bytewise; documents of
    one by doc_id, null first, and equal ids by leaf, so repeated rows follow each
    other. Without documents there is no row. Other columns are not read. Texts are
    hashed where they are read, and never shuffled.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    row = {c: F.col(c) for c in LEAF_COLUMNS}
    lowered = F.when(F.lit(False) if tampered is None else tampered, F.translate("text", _UPPER, _LOWER))
    slim = docs.select("doc_id", "lang", leaf(row).alias("h"), F.when(lowered != F.col("text"), leaf(row | {"text": lowered})).alias("t"))
    # written before it is dealt by ranges, which reads its input twice
    leaves = ranked(scratch, scratch.save(slim, "hashes"), "lang", [F.col("doc_id").asc_nulls_first(), F.col("h").asc()], "ranges")

    names = scratch.save(scratch.spark.read.parquet(f"{scratch.base}/ranges").groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "sizes")
    names = ranked(scratch, names.withColumn("all_", F.lit(0)), "all_", [F.col("lang").asc_nulls_first()], "languages")
    names = scratch.save(names.select(F.col("lang").alias("lang_"), F.col("i").alias("g"), F.col("n").alias("langs"), "size"), "names")
    most, langs = names.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("langs"), F.lit(0))).first()
    rounds = lambda n: max(1, height(n, bucket))

    known = names.select("lang_", "g")
    nodes = leaves.join(known, leaves["lang"].eqNullSafe(known["lang_"])).select("g", "i", "n", F.lower(F.hex("h")).alias("h"), F.lower(F.hex("t")).alias("t"), "doc_id")
    nodes = scratch.save(nodes, "nodes")
    roots = scratch.save(rooted(nodes, bucket, fan), "roots")
    paths = scratch.save(_to_root(scratch, roots, max(1, rounds(most) - 1), bucket, fan, "buckets"), "paths")
    tops = paths.filter("i = 0").select("g", F.col("root").alias("h")).join(names.select("g", F.col("langs").alias("n")), "g")
    tops = _to_root(scratch, tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), "h", "n"), rounds(langs), bucket, fan, "tops")
    tops = tops.select(F.col("i").alias("g"), F.col("path").alias("more"), F.col("root").alias("whole"))
    outer = paths.join(tops, "g").select("g", F.col("i").alias("bucket"), F.concat("path", "more").alias("path"), F.col("root").alias("subroot"), F.col("whole").alias("root"))
    return folded(nodes, scratch.save(outer, "outer"), bucket, fan).withColumn("verified", F.col("folded") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of all of ``documents``; null ids aren't tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, tampered).withColumnsRenamed({"proof": "proof_sha256", "folded": "folded_root"})


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c if c != "text" else text) for c in LEAF_COLUMNS) + ")"
#: CRC-32 of the decimal doc_id, a bit at a time
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, b: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"


def _sql_tree(name: str, start: str, levels: int) -> tuple[str, list[str]]:
    """Levels of a tree over ``start`` (g, i, h), where a level of one node stays; and each level's runs (g, i, s, c: strings and how many nodes)."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT g, i // {FAN} AS i, string_agg(h, '' ORDER BY i) AS s, max(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}{k}) GROUP BY g, i // {FAN})")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, i, CASE WHEN c > 1 THEN sha256(s) ELSE s END AS h FROM {name}r{k})")
    return ",\n".join(out), [f"{name}r{k}" for k in range(levels)]


def _sql_fold(name: str, start: str, runs: list[str], g: str, i: str) -> str:
    """cur and proof of ``start`` carried up through ``runs``."""
    out = []
    for k, run in enumerate(runs):
        at = f"({i} // {FAN**k} % {FAN}) * {_HEX}"
        left, right = f"substring(r.s, 1, {at})", f"substring(r.s, {at} + {_HEX} + 1)"
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (cur, proof), CASE WHEN r.c > 1 THEN sha256({left} || cur || {right}) ELSE cur END AS cur, proof || {left} || {right} AS proof FROM {start if not k else f'{name}{k}'} f JOIN {run} r ON r.g = {g} AND r.i = {i} // {FAN ** (k + 1)})")
    return ",\n".join(out)


_SQL_LEVELS, _SQL_TOPS = 11, 4
_TREE, _RUNS = _sql_tree("t", "SELECT g, i, h FROM ids", _SQL_LEVELS)
_TOP_TREE, _TOP_RUNS = _sql_tree("u", f"SELECT 0 AS g, g AS i, h FROM t{_SQL_LEVELS}", _SQL_TOPS)
#: Trees of up to 8^11 documents a language and 8^4 languages, level by level, on whole tables.
OP12_SQL = f"""
WITH leaves AS MATERIALIZED (SELECT doc_id, lang, {_LEAF("text")} AS h, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS t FROM documents),
ids AS MATERIALIZED (SELECT doc_id, h, t, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves),
{_TREE},
{_TOP_TREE},
f0 AS (SELECT *, coalesce(t, h) AS cur, '' AS proof FROM ids),
{_sql_fold("f", "f0", _RUNS, "f.g", "f.i")},
{_sql_fold("z", f"f{_SQL_LEVELS}", _TOP_RUNS, "0", "f.g")}
SELECT doc_id, z.h AS leaf, s.h AS subroot, w.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = w.h AS verified
FROM z{_SQL_TOPS} z JOIN t{_SQL_LEVELS} s ON s.g = z.g JOIN u{_SQL_TOPS} w ON true
"""
