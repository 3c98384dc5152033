"""Near-duplicate embeddings by NN-descent.

1. A neighbour graph with ``K`` neighbours a vector starts from runs of vectors that are
   sorted by random hyperplanes, and is refined by local joins: vectors that share a
   neighbour are compared, and the better ones replace the worst on each other's lists.
2. A list that is full of links says nothing of further links. The vectors of such lists
   descend again among themselves with lists twice as long, until no list is full or
   lists have ``LONGEST`` neighbours. That loses nothing: a pair with one unsaturated
   vector is on that vector's list.
3. Vectors that still have more links are dense. Links from dense to dense vectors of one
   component are counted block by block, so that no pair of them is written out.
4. An audit compares fresh vectors, more of them in larger tables, with all others. What
   it finds are links of the result. While too few of them were known, lists become longer
   and the descent goes on; where that doesn't help, all vectors are compared in blocks.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxloom.llm.common import Scratch, components

COSINE = 0.9
K, LONGEST = 16, 64
#: Sorts by random hyperplanes, and rows of such a sort that are compared at the start.
SORTS, RUN, PLANES = 6, 64, 24
#: The descent goes on while more than this share of the edges is new.
LEAST_NEW = 0.01
#: Of what a local join offers a vector, the nearest 16, or half of a list, are sent to it; it takes part in as many joins as have it.
OFFERS = 16
#: Vectors of the audit: the larger of a number and a multiple of the table's square root, but no more bytes than are sent to each task.
AUDITED, AUDITED_ROOT, AUDITED_BYTES = 2048, 16, 64 << 20
#: Share of the audited links that must be known, and how often lists are made longer for it before everything is compared.
RECALL, LONGER = 0.98, 3
#: Vectors of a block, two of which are compared in a task.
BLOCK = 2048
#: What vectors in half precision can be off: 2 * 2 ** -11 for rounding, and less than as much for sums in single precision.
MARGIN = 0.004
_NEAR = COSINE - MARGIN
_LOG = logging.getLogger("rxloom")


def _doubles(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _units(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """(c, unit, q): the vector of length one in doubles, and in half precision."""
    for b in batches:
        lists = b.column(1)
        x = np.zeros((b.num_rows, dim))
        sizes = np.diff(lists.offsets.to_numpy())
        at = np.arange(dim)[None, :] < sizes[:, None]
        x[at] = lists.flatten().to_numpy(zero_copy_only=False)
        if len(x):
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["c", "unit", "q"])


def _halves(column: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float16).reshape(-1, dim).astype(np.float32)


def _tree(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of ``near`` that connect whatever it connects, one a row at most."""
    left, xs, ys = near.any(axis=1), [], []
    while left.any():
        seen = np.zeros(len(near), dtype=bool)
        seen[int(np.argmax(left))] = True
        front = seen
        while front.any():
            at = np.nonzero(front)[0]
            fresh = near[at].any(axis=0) & ~seen
            y = np.nonzero(fresh)[0]
            xs.append(at[near[at][:, y].argmax(axis=0)])
            ys.append(y)
            seen, front = seen | fresh, fresh
        left &= ~seen
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ys])


def _start(vectors: DataFrame, dim: int, k: int, size: int, seed: int) -> DataFrame:
    """u, v, sim, bridge: neighbours within runs of vectors that are sorted by the sides of random planes.

    Bridges connect what the links of a run connect, even where lists are full
    of nearer vectors. Partitions are ranges of (code, scattered key), so that
    equal codes split.
    """
    run = max(RUN, 2 * k)
    deal = max(1, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (16 * run)))

    def codes(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).normal(size=(dim, PLANES))
        for b in batches:
            code = ((_halves(b.column(1).to_pylist(), dim) @ planes > 0) @ (1 << np.arange(PLANES)[::-1])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code), b.column(0), b.column(1)], ["code", "c", "q"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), _halves(b.column(1).to_pylist(), dim)
            for at in range(0, len(ids), run):
                own, part = ids[at : at + run], x[at : at + run]
                sims = part @ part.T
                np.fill_diagonal(sims, -2)
                n = min(k, len(own) - 1)
                if n < 1:
                    continue
                best = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                sure, maybe = _tree(sims >= COSINE + MARGIN), np.nonzero(np.triu((sims >= _NEAR) & (sims < COSINE + MARGIN)))
                i, j = np.concatenate([np.repeat(np.arange(len(own)), n), sure[0], maybe[0]]), np.concatenate([best.ravel(), sure[1], maybe[1]])
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j]), pa.array(sims[i, j]), pa.array(np.arange(len(i)) >= best.size)], ["u", "v", "sim", "bridge"])

    out = None
    for sort in range(SORTS):
        coded = vectors.select("c", "q").mapInArrow(lambda it, s=seed * SORTS + sort: codes(it, s), "code long, c long, q binary")
        dealt = coded.repartitionByRange(deal, "code", "c").sortWithinPartitions("code", "c").select("c", "q")
        found = dealt.mapInArrow(runs, "u long, v long, sim float, bridge boolean")
        out = found if out is None else out.union(found)
    return out


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each u; ``new`` is kept only where no old copy of the edge exists."""
    edges = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return edges.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _round(graph: DataFrame, vectors: DataFrame, dim: int, k: int) -> DataFrame:
    """u, v, sim, new: candidates of one local join, better than the worst on u's list.

    Lists hold at most k neighbours and k vectors that name this one, so that
    no group can grow with the data.
    """
    worst = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) < k, F.lit(-2.0)).otherwise(F.min("sim")).cast("float").alias("worst"))
    named = graph.select(F.col("v").alias("m"), F.col("u").alias("c"), "new")
    named = named.withColumn("r", F.row_number().over(Window.partitionBy("m").orderBy(F.desc("new"), F.xxhash64("m", "c")))).filter(F.col("r") <= k).drop("r")
    near = graph.select(F.col("u").alias("m"), F.col("v").alias("c"), "new").union(named)
    near = near.groupBy("m", "c").agg(F.max("new").alias("new"))
    known = vectors.select("c", "q").join(worst.withColumnRenamed("u", "c"), "c", "left").select("c", "q", F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst"))
    lists = near.join(known, "c").groupBy("m").agg(F.collect_list(F.struct("c", "new", "worst", "q")).alias("l")).select("l")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // (4 * k * k))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                lists = whole.column(0).slice(at, step)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                if not len(flat):
                    continue
                wide, rows = sizes.max(), len(sizes)
                place = np.arange(wide)[None, :] < sizes[:, None]

                def spread(values: np.ndarray, fill: float, place=place) -> np.ndarray:
                    out = np.full(place.shape + values.shape[1:], fill, dtype=values.dtype)
                    out[place] = values
                    return out

                ids = spread(flat.field(0).to_numpy(), -1)
                new = spread(flat.field(1).to_numpy(zero_copy_only=False).astype(bool), False)
                worst = spread(flat.field(2).to_numpy(zero_copy_only=False), 9)
                x = spread(_halves(flat.field(3).to_pylist(), dim), 0)
                sims = x @ x.transpose(0, 2, 1)
                good = (sims > worst[:, :, None]) & (new[:, :, None] | new[:, None, :]) & place[:, None, :] & (ids[:, :, None] != ids[:, None, :])
                most, sims = max(OFFERS, k // 2), np.where(good, sims, -9)
                if wide > most:
                    nearest = np.argpartition(-sims, most - 1, axis=2)[:, :, :most]
                    r, i, j = np.nonzero(np.take_along_axis(sims, nearest, axis=2) > -9)
                    j = nearest[r, i, j]
                else:
                    r, i, j = np.nonzero(good)
                # in a group of lists the same pair comes up often
                local = np.unique(ids, return_inverse=True)[1].reshape(ids.shape)
                once = np.unique(local[r, i] << 32 | local[r, j], return_index=True)[1]
                r, i, j = r[once], i[once], j[once]
                yield pa.RecordBatch.from_arrays([pa.array(ids[r, i]), pa.array(ids[r, j]), pa.array(sims[r, i, j].astype(np.float32))], ["u", "v", "sim"])

    return lists.mapInArrow(join, "u long, v long, sim float").withColumn("new", F.lit(True))


def descend(scratch: Scratch, vectors: DataFrame, dim: int, k: int, graph: DataFrame | None, label: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph (u, v, sim) of ``vectors`` (c, q), from ``graph`` or from scratch, and the bridges (u, v) seen at the start."""
    start = scratch.save(_start(vectors, dim, k, vectors.count(), seed), f"{label}-start")
    lists = start.filter("not bridge").select("u", "v", "sim", F.lit(True).alias("new"))
    graph = scratch.save(_best(lists if graph is None else lists.union(graph.select("u", "v", "sim", F.lit(True))), k), f"{label}-0")
    size = graph.count()
    step, going = 0, True
    while going:
        step += 1
        more = _round(graph, vectors, dim, k)
        graph = scratch.save(_best(graph.withColumn("new", F.lit(False)).union(more), k), f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
        going = graph.filter("new").count() > LEAST_NEW * size
    return graph.select("u", "v", "sim"), start.filter("bridge").select("u", "v")


def neighbours(scratch: Scratch, vectors: DataFrame, dim: int, k: int, graph: DataFrame | None, label: str, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graph of lists of k, possible links u, v of all lists, dense vectors c).

    Each turn takes the vectors whose lists are full of links, and doubles their lists.
    """
    first, edges, level = None, None, 0
    while True:
        graph, bridges = descend(scratch, vectors, dim, k, graph, f"{label}-{level}", seed + level)
        first = graph if first is None else first
        near = graph.filter(F.col("sim") >= _NEAR).select("u", "v").union(bridges)
        edges = near if edges is None else edges.union(near)
        full = graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("worst")).filter((F.col("n") >= k) & (F.col("worst") >= _NEAR))
        full = scratch.save(full.select(F.col("u").alias("c")), f"{label}-full-{level}")
        if full.isEmpty() or k >= LONGEST:
            return first, edges, full
        k, level = 2 * k, level + 1
        vectors = scratch.save(vectors.join(full, "c", "left_semi"), f"{label}-vectors-{level}")
        graph = graph.join(full.withColumnRenamed("c", "u"), "u", "left_semi").join(full.withColumnRenamed("c", "v"), "v", "left_semi").select("u", "v", "sim")


def confirmed(edges: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """a, b (a < b) of the edges whose cosine in double precision reaches COSINE."""
    pairs = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    both = pairs.join(vectors.select(F.col("c").alias("a"), F.col("unit").alias("x")), "a").join(vectors.select(F.col("c").alias("b"), F.col("unit").alias("y")), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cos = np.einsum("ij,ij->i", _doubles(b.column(2), dim), _doubles(b.column(3), dim))
            yield b.filter(pa.array(cos >= COSINE)).select(["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(keep, "a long, b long")


def audited(scratch: Scratch, vectors: DataFrame, links: DataFrame, dense: DataFrame, dim: int, label: str, seed: int) -> DataFrame:
    """Links (a, b, known) of fresh vectors, half of them such as have links, to all others.

    ``dense``: c, comp. Pairs of dense vectors in one component are counted later
    and left out; of those in different components one a batch is enough.
    """
    n = min(max(AUDITED, int(AUDITED_ROOT * vectors.count() ** 0.5)), max(64, AUDITED_BYTES // (8 * dim)))
    rows = vectors.select("c", "unit").join(dense, "c", "left").select("c", "unit", F.coalesce("comp", F.lit(-1)).alias("g"))
    linked = rows.join(links.select(F.col("a").alias("c")).union(links.select("b")).distinct(), "c", "left_semi")
    taken = {r["c"]: r for part in (linked, rows) for r in part.orderBy(F.xxhash64("c", F.lit(seed))).limit(n // 2).collect()}.values()
    ids, groups = (np.array([r[k] for r in taken], dtype=np.int64) for k in ("c", "g"))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, groups, np.frombuffer(b"".join(bytes(r["unit"]) for r in taken), dtype=np.float64).reshape(-1, dim)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, x = shared.value
        for b in batches:
            own, y, g = b.column(0).to_numpy(), _doubles(b.column(1), dim), b.column(2).to_numpy()
            for at in range(0, len(ids), BLOCK):
                part, h = ids[at : at + BLOCK], groups[at : at + BLOCK]
                r, k = np.nonzero(y @ x[at : at + BLOCK].T >= COSINE)
                keep = (own[r] != part[k]) & ((g[r] != h[k]) | (g[r] < 0))
                r, k = r[keep], k[keep]
                both = (g[r] >= 0) & (h[k] >= 0)
                one = np.unique(k[both], return_index=True)[1]
                r, k = np.concatenate([r[~both], r[both][one]]), np.concatenate([k[~both], k[both][one]])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(part[k], own[r])), pa.array(np.maximum(part[k], own[r]))], ["a", "b"])

    truth = rows.mapInArrow(compare, "a long, b long").distinct()
    return scratch.save(truth.join(links.select("a", "b", F.lit(True).alias("known")), ["a", "b"], "left").select("a", "b", F.coalesce("known", F.lit(False)).alias("known")), label)


def compared(vectors: DataFrame, dim: int) -> DataFrame:
    """a, b: links that connect what the links between all ``vectors`` connect.

    A table of n vectors has n / BLOCK blocks; a task compares two blocks, and
    sends back at most one link a vector.
    """
    blocks = -(-vectors.count() // BLOCK)
    rows = vectors.select("c", "unit", F.pmod(F.xxhash64("c", F.lit(9)), F.lit(blocks)).cast("int").alias("blk"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "c", "unit")

    def compare(t: pa.Table) -> pa.Table:
        ids, x = t.column("c").to_numpy(), _doubles(t.column("unit").combine_chunks(), dim)
        near = x @ x.T >= COSINE
        np.fill_diagonal(near, False)
        i, j = _tree(near)
        return pa.table({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])})

    return rows.groupBy("i", "j").applyInArrow(compare, "a long, b long")


def counted(members: DataFrame, dim: int) -> DataFrame:
    """c, linked: the weight of the other members of a vector's component with cosine >= COSINE.

    ``members``: comp, c, w, unit. A component of m members has m / BLOCK blocks;
    a task compares two blocks, and sends back one sum a vector.
    """
    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = members.join(sizes, "comp").withColumn("blk", F.pmod(F.xxhash64("c", F.lit(9)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("comp", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), (F.col("blk") <= F.col("o")).alias("left"), (F.col("blk") >= F.col("o")).alias("right"), "c", "w", "unit")

    def compare(t: pa.Table) -> pa.Table:
        x = _doubles(t.column("unit").combine_chunks(), dim)
        ids, w, left, right = (t.column(k).to_numpy() for k in ("c", "w", "left", "right"))
        near = x[left] @ x[right].T >= COSINE
        near &= ids[left][:, None] != ids[right][None, :]
        if (left & right).any():
            return pa.table({"c": ids[left], "linked": near @ w[right]})
        return pa.table({"c": np.concatenate([ids[left], ids[right]]), "linked": np.concatenate([near @ w[right], near.T @ w[left]])})

    return rows.groupBy("comp", "i", "j").applyInArrow(compare, "c long, linked long").groupBy("c").agg(F.sum("linked").alias("linked"))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``table``: id, n_links, component_id, kept.

    Equal vectors are folded into one before the descent, however many there
    are; repeated rows count as vectors of their own. Vectors that are null,
    zero or hold null or non-finite components have no links and are their own
    component; shorter vectors are padded with zeros; a null id names no
    component (kept is false). Other columns are not read. How many of the
    audited links were known is logged.
    """
    scratch = Scratch(table.sparkSession, "vectors")
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    fine = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    # -0.0 + 0.0 is 0.0
    rows = rows.select("id", F.when(F.coalesce(fine, F.lit(False)), F.transform("x", lambda v: v + 0.0)).alias("x"))
    fit_ = F.col("x").isNotNull()
    digest = [F.when(fit_, F.xxhash64("x")).otherwise(F.xxhash64("id")).alias("h1"), F.xxhash64(F.lit("second"), "x").alias("h2")]
    fit = rows.filter(fit_).select("id", "x", *digest)
    dim = fit.agg(F.max(F.size("x"))).first()[0]
    if dim is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    classes = fit.groupBy("h1", "h2").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("w"), F.min("id").alias("rep"))
    classes = scratch.save(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    vectors = scratch.save(classes.select("c", "x").mapInArrow(lambda it: _units(it, dim), "c long, unit binary, q binary"), "units")

    def connected(links: DataFrame, label: str) -> DataFrame:
        found = components(Scratch(table.sparkSession, "vectors"), links)
        return scratch.save(found.select(F.col("node").alias("c"), F.col("component").alias("comp")), label)

    k, graph, links = K, None, None
    for turn in range(LONGER + 1):
        graph, edges, dense = neighbours(scratch, vectors, dim, k, graph, f"graph-{turn}", 10 * turn)
        more = confirmed(edges, vectors, dim)
        links = scratch.save(more if links is None else links.union(more).distinct(), f"links-{turn}")
        comps = connected(links, f"components-{turn}")
        truth = audited(scratch, vectors, links, dense.join(comps, "c"), dim, f"audit-{turn}", turn)
        there, known = truth.agg(F.count(F.lit(1)), F.count_if("known")).first()
        _LOG.info("near vectors: %d of %d audited links were known with lists of %d", known, there, k)
        if known < there:
            links = scratch.save(links.union(truth.filter("not known").select("a", "b")), f"links-audited-{turn}")
            comps = connected(links, f"components-audited-{turn}")
        if known >= RECALL * there:
            break
        k = k * 3 // 2
    else:
        comps, dense = connected(compared(vectors, dim), "components-compared"), vectors.select("c")
    dense = scratch.save(dense.join(comps, "c"), "dense")
    inside = counted(dense.join(classes.select("c", "w"), "c").join(vectors.select("c", "unit"), "c").select("comp", "c", "w", "unit"), dim)
    # links of two dense vectors are counted in blocks, all others from the verified edges
    ends = links.select(F.col("a").alias("c"), F.col("b").alias("o")).union(links.select("b", "a"))
    ends = ends.join(dense.select("c", F.lit(1).alias("dc")), "c", "left").join(dense.select(F.col("c").alias("o"), F.lit(1).alias("do")), "o", "left").filter("dc is null or do is null")
    outside = ends.join(classes.select(F.col("c").alias("o"), "w"), "o").groupBy("c").agg(F.sum("w").alias("linked"))
    linked = inside.union(outside).groupBy("c").agg(F.sum("linked").alias("linked"))
    members = classes.select("c", "h1", "h2", "w", "rep").join(comps, "c", "left")
    least = members.filter("comp is not null").groupBy("comp").agg(F.min("rep").alias("least"))
    settled = members.join(least, "comp", "left").join(linked, "c", "left")
    settled = settled.select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("least", "rep").alias("least"))
    out = rows.select("id", fit_.alias("fit"), *digest).join(settled, ["h1", "h2"], "left")
    least_id = F.when(F.col("fit"), F.col("least")).otherwise(F.col("id"))
    return out.select("id", F.when(F.col("fit"), F.col("n")).otherwise(0).cast("long").alias("n_links"), least_id.alias("component_id"), F.coalesce(F.col("id") == least_id, F.lit(False)).alias("kept"))


def op9_embedding_dedup(spark, sf_dir) -> DataFrame:
    """vec_id, n_links, component_id, kept of all of ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
