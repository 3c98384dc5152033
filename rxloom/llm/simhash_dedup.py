"""Near-duplicate documents by SimHash with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. When two fingerprints
differ at no more than two bits, one of the segments differs at no more than one.
So each fingerprint is indexed under its two plain segments and under each segment
with one bit struck out (2 + 64 keys); fingerprints that share a key are compared
bit by bit. Buckets that are too full for that are cut again by striking bits out
of the other segment until whole fingerprints are fixed, which is exact as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.llm.common import Scratch, components

SEED = 42
MAX_BITS = 2
#: Members of a bucket that are compared with each other; fuller buckets are cut again.
BUCKET = 64
#: Words of a shingle in the stage, and the Jaccard similarity 4/5 by sizes: 9 * common >= 4 * (one + other).
STAGE_WORDS, ALIKE, OF_SIZES = 5, 9, 4
#: Of two texts with Jaccard similarity j, one band or more is equal with 1 - (1 - j ** ROWS) ** BANDS: 0.99997 at 0.8.
BANDS, ROWS = 20, 4
#: Minima of BANDS * ROWS in which close sketches agree: of pairs at 0.8, 3 in 100,000 agree in fewer.
CLOSE = 50
#: Turns in which the texts of a key are compared with one of them; further bands that cut a full bucket.
TURNS, DEEP = 2, 1
#: Texts that are compared with one in a task, and texts of a full bucket that are compared at a time.
PART, BLOCK = 256, 256
#: Numbers of 64 bits in the bitmap that tells which rows to shuffle.
SIEVE = 1 << 18
_CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8) * 256)[None, :]


def _hashes(text: bytes | None, words: int) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles, in chunks; a shorter text is one shingle."""
    found = (text or b"").lower().split()
    if not found:
        return
    joined, size = b" ".join(found), len(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, size)
    spans = list(zip(starts[: size - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    for at in range(0, len(spans), _CHUNK):
        part = spans[at : at + _CHUNK]
        yield np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in part), dtype=np.uint64, count=len(part))


def _simhash(chunks: Iterable[np.ndarray]) -> int:
    counts, size = np.zeros((8, 8), dtype=np.int64), 0
    for h in chunks:
        tally = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
        counts += tally.reshape(8, 256) @ _BITS
        size += len(h)
    ones = (counts.ravel() * 2 > size).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit integer."""
    return _simhash(_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) of every row; null and wordless texts get fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _keyed(fps: DataFrame) -> DataFrame:
    """(key, z, fp): v below 2 is a plain segment; else one with bit (v - 2) % 32 struck out, whose value is z."""
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("v"))
    rows = rows.selectExpr("fp", "v", "shiftrightunsigned(fp, if(v < 2, v, (v - 2) div 32) * 32) & 4294967295 as seg", "(v - 2) % 32 as b")
    return rows.selectExpr("shiftleft(cast(v as bigint), 32) | if(v < 2, seg, seg & ~shiftleft(1L, b)) as key", "if(v < 2, 0, shiftrightunsigned(seg, b) & 1) as z", "fp")


def close_pairs(scratch: Scratch, fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints that differ at one or two bits.

    Two fingerprints meet under a plain segment, or under a struck-out bit at
    which they differ. Buckets of two are settled by the aggregate itself. In a
    plain bucket of over ``bucket`` members the other segment has two bits struck
    out in every way (496 keys), in a struck-out one it has one (32 keys): then
    keys hold four fingerprints at most, however large the bucket was.
    """
    # a scan packs millions of eight-byte rows in a task, each of which becomes 66
    keyed = _keyed(fps.repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), "fp"))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("n1"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    groups = scratch.save(groups.filter("n > 1 and (key < 8589934592 or (n1 > 0 and n1 < n))"), "groups")
    near = "bit_count(a ^ b) <= 2"
    two = groups.filter("n = 2").filter(near).select("a", "b")

    some = groups.filter(f"n > 2 and n <= {bucket}").select("key")
    members = keyed.join(some, "key")
    other = members.select("key", F.col("z").alias("z2"), F.col("fp").alias("fp2"))
    met = members.join(other, "key").filter("if(key < 8589934592, fp < fp2, z < z2) and bit_count(fp ^ fp2) <= 2")
    met = met.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"))

    full = keyed.join(groups.filter(f"n > {bucket}").select("key"), "key")
    # shift of the segment that the bucket left free
    free = full.selectExpr("key", "fp", "if(if(key < 8589934592, shiftrightunsigned(key, 32), (shiftrightunsigned(key, 32) - 2) div 32) = 0, 32, 0) as s", "key < 8589934592 as plain")
    masks = "transform(sequence(0, 31), i -> shiftleft(1L, i))"
    pairs = "flatten(transform(sequence(1, 31), i -> transform(sequence(0, i - 1), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    cut = free.selectExpr("key", "fp", "s", f"explode(if(plain, {pairs}, {masks})) as m").selectExpr("key", "m", "fp & ~shiftleft(m, s) & if(s = 0, 4294967295, -4294967296) as rest", "fp")
    few = cut.groupBy("key", "m", "rest").agg(F.collect_set("fp").alias("f")).filter("size(f) > 1")
    deep = few.select(F.explode("f").alias("a"), "f").select("a", F.explode("f").alias("b")).filter(f"a < b and {near}")
    return two.union(met).union(deep).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: id, fp (long), component (smallest id it reaches by links).

    Copies share a fingerprint and are folded into one node before anything is
    joined. Null or wordless texts have fingerprint zero and link like others;
    repeated rows stay and share a component; an id with several texts doesn't link
    them, and has the component of each; a null id is kept, and never names
    a component that has another id. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = scratch.save(rows.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    comps = components(scratch, close_pairs(scratch, classes.select("fp")))
    settled = classes.join(comps, classes.fp == comps.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))
    settled = settled.join(settled.groupBy("group").agg(F.min("rep").alias("component")), "group").select("fp", "component")
    return rows.join(settled, "fp", "left").select("id", "fp", "component")


def op5_simhash_dedup(spark, sf_dir) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_components(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def sketch(own: np.ndarray) -> bytes:
    """Sixteen bits of each of BANDS * ROWS minima of a text's distinct hashes: as many are equal, in part, as the texts are alike."""
    if not len(own):
        return b""
    mix = np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 1024):
        least = np.minimum(least, (own[at : at + 1024, None] * mix[0] + mix[1]).min(axis=0))
    return (least >> np.uint64(24)).astype(np.uint16).tobytes()


def _distinct(chunks: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(chunks)) if chunks else np.zeros(0, dtype=np.uint64)


def _shingles(text: bytes | None) -> np.ndarray:
    return _distinct(list(_hashes(text, STAGE_WORDS)))


def signatures(rows: DataFrame) -> DataFrame:
    """(digest of the set of shingles, fp, sketch) in place of the last column, t; texts without a word have an empty sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(batch.num_columns - 1):
                chunks = list(_hashes(t.as_py(), STAGE_WORDS))
                own = _distinct(chunks)
                out.append((xxhash.xxh3_128_digest(own.tobytes()), _simhash(chunks), sketch(own)))
            kinds = (pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]], [*rest, "digest", "fp", "sketch"])

    rest = rows.columns[:-1]
    return rows.mapInArrow(run, ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest] + ["digest binary", "fp long", "sketch binary"]))


def _alike(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of 0.8 or more."""
    if ALIKE * min(len(one), len(other)) < OF_SIZES * (len(one) + len(other)):
        return False
    return ALIKE * len(np.intersect1d(one, other, assume_unique=True)) >= OF_SIZES * (len(one) + len(other))


def _bands() -> Column:
    """An array of key and bit for each band; keys are equal where ROWS minima are."""
    return F.array(*[F.struct(F.xxhash64(F.lit(k), F.substring("sketch", 2 * ROWS * k + 1, 2 * ROWS)).alias("key"), F.lit(1 << k).alias("mask")) for k in range(BANDS)])


def _equal(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (one == other).sum(axis=-1)


def _minima(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, BANDS * ROWS)


def sieve(places: DataFrame) -> DataFrame:
    """(w, bits): a bitmap of the hashed places (file, at), SIEVE rows at most whatever the input, so that it may be sent to every task."""
    return places.select(*_hole()).groupBy("w").agg(F.bit_or("bit").alias("bits"))


def _hole() -> list[Column]:
    return [F.pmod(F.xxhash64("file", "at"), F.lit(SIEVE)).alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(at, file), 64) as int))").alias("bit")]


def sifted(rows: DataFrame, holes: DataFrame) -> DataFrame:
    """``rows`` (file, at, ...) with maybe: false where their place is surely not in ``holes``."""
    w, bit = _hole()
    marked = rows.withColumns({"w": w, "bit": bit}).join(F.broadcast(holes), "w", "left")
    return marked.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))).drop("w", "bit", "bits")


class _Roots:
    """Union-find over places; those of one label are together from the beginning."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.root = [first.setdefault(c, k) for k, c in enumerate(labels)]

    def find(self, n: int) -> int:
        root = self.root
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    def join(self, a: int, b: int) -> bool:
        one, other = self.find(a), self.find(b)
        self.root[one] = other
        return one != other


class _Search:
    """Links of texts with a Jaccard similarity of 0.8 or more, enough of them to connect all such pairs.

    ``classes``: node, fp, sketch of different texts; ``places``: node, file, at;
    ``rows``: file, at, t. Two steps. First groups by sketches: texts meet under the
    keys of their bands, and where their fingerprints are close; a few turns compare
    those of each key with one of them, another each turn, and what is grouped by then
    isn't compared again. The rest of each key is compared in small buckets, large ones
    being cut by further bands first, and in blocks where that doesn't help. Sketches
    are close if they agree as far as 0.8 does but for 3 in 100,000. Then the shingles:
    each turn's close pairs are compared, which connects most of a group in linear
    work, and at last, in each group, those outside of its largest part with all.
    """

    def __init__(self, scratch: Scratch, classes: DataFrame, places: DataFrame, rows: DataFrame):
        self.scratch, self.classes, self.places, self.rows = scratch, classes, places, rows
        self.close: list[DataFrame] = []
        self.links: list[DataFrame] = []
        self.comps: DataFrame | None = None
        self.names: list[str] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.names.append(f"{name}-{len(self.names)}")
        return self.scratch.save(df, self.names[-1])

    def found(self) -> None:
        keyed = self.classes.filter("length(sketch) > 0").select(F.explode(_bands()).alias("b"), "node").select("b.key", "b.mask", "node")
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
        keyed = self.save(keyed.join(shared, "key"), "keyed")
        reps = self.save(self.classes.groupBy("fp").agg(F.min("node").alias("rep")), "reps")
        near = close_pairs(self.scratch, reps.select("fp"))
        near = near.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
        near = near.select("ra", "rb").union(self.classes.join(reps, "fp").filter("node <> rep").select("rep", "node")).toDF("a", "b")
        for turn in range(TURNS):
            pairs = self.stars(keyed, turn)
            pairs = self.save(self.alike(pairs if turn else pairs.union(near).distinct()), "pairs")
            if pairs.isEmpty():
                break
            self.close.append(pairs)
            self.links.append(self.save(self.compared(pairs), "links"))
            if turn + 1 < TURNS:
                self.comps = self.save(self.linked(self.links[-1]), "linked")
        self.group(keyed)
        self.comps = self.connected(self.links) if self.links else None
        self.links.append(self.save(self.settled(), "links"))
        self.comps = self.connected(self.links)

    def linked(self, links: DataFrame) -> DataFrame:
        """(node, component) of a turn's links, in one step: equal components are connected, but not all that are connected are equal."""
        both = links.union(links.select(F.col("a"), F.col("a")).distinct()).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        return both.join(both.select(F.col("node").alias("up"), F.col("up").alias("component")), "up").select("node", "component")

    def connected(self, links: list[DataFrame]) -> DataFrame:
        every = links[0]
        for more in links[1:]:
            every = every.union(more)
        return components(Scratch(self.scratch.spark, "dedup"), every)

    def labelled(self, rows: DataFrame, comps: DataFrame | None, name: str) -> DataFrame:
        """``rows`` with the component of each node, which is the node itself where it has no link."""
        if comps is None:
            return rows.withColumn(name, F.col("node"))
        return rows.join(comps.select("node", F.col("component").alias("comp_")), "node", "left").withColumn(name, F.coalesce("comp_", "node")).drop("comp_")

    def stars(self, keyed: DataFrame, turn: int) -> DataFrame:
        """Each text of a key with the one that this turn picks, unless both are connected."""
        rows = self.labelled(keyed, self.comps, "comp")
        pick = F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(turn)))
        picks = rows.groupBy("key").agg(pick.alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "p")
        return rows.join(picks, "key").filter("comp <> p.comp").select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches are close."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                near = _equal(_minima(t["sa"]), _minima(t["sb"])) >= CLOSE
                yield pa.RecordBatch.from_arrays([t["a"], t["b"]], ["a", "b"]).filter(pa.array(near))

        own = self.classes.filter("length(sketch) > 0").select("node", "sketch")
        rows = pairs.join(own.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(own.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")

    def texts(self, needed: DataFrame) -> DataFrame:
        """``needed`` (node, ...) with the texts t. Only those that are needed, or hash like such, are shuffled."""
        needed = self.save(needed.join(self.places, "node"), "needed")  # read twice
        holes = sieve(needed.select("file", "at"))
        kept = sifted(self.rows, holes).filter("maybe").drop("maybe")
        # they grow with the documents, so they are merged at every size
        return kept.join(needed.hint("merge"), ["file", "at"])

    def compared(self, pairs: DataFrame) -> DataFrame:
        """The links among ``pairs``. The partners of a text are compared with it in parts of about PART."""

        def compare(t: pa.Table) -> pa.Table:
            own, out = t.column("own").to_pylist(), []
            a = t.column("a")[0].as_py()
            one = _shingles(t.column("t")[own.index(True)].as_py())
            for k, node in enumerate(t.column("node").to_pylist()):
                if not own[k] and _alike(one, _shingles(t.column("t")[k].as_py())):
                    out.append(node)
            return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

        sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
        rows = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("node"), F.lit(False).alias("own"))
        rows = rows.union(rows.select("a", "part", F.col("a"), F.lit(True)).distinct())
        return self.texts(rows).select("a", "part", "node", "own", "t").groupBy("a", "part").applyInArrow(compare, "a long, b long")

    def group(self, keyed: DataFrame) -> None:
        """Adds to ``close`` what connects the texts of each key whose sketches are close."""
        depth, groups = 0, self.connected(self.close) if self.close else None
        while True:
            rows = self.labelled(keyed, groups, "comp")
            open_ = rows.groupBy("key", "mask").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "mask", "n")
            rows = self.save(rows.join(open_, ["key", "mask"]), "open")
            full = rows.filter(f"n > {BUCKET}")
            last = depth == DEEP or full.isEmpty()
            # blocks of one another where a bucket is larger than a block
            self.close.append(self.save(self.blocks(rows if last else rows.filter(f"n <= {BUCKET}")), "close"))
            if last:
                break
            more = full.select("key", "mask", "node").join(self.classes.select("node", "sketch"), "node")
            cut = more.select("key", "mask", "node", F.explode(_bands()).alias("b")).filter((F.col("mask").bitwiseAND(F.col("b.mask"))) == 0)
            # a set of bands has one key, whichever of them came first
            cut = cut.select(F.col("key").bitwiseXOR(F.col("b.key")).alias("key"), F.col("mask").bitwiseOR(F.col("b.mask")).alias("mask"), "node").distinct()
            keyed, depth = self.save(cut, "cut"), depth + 1

    def blocks(self, members: DataFrame) -> DataFrame:
        """Pairs of close sketches in each bucket that connect all such pairs of it; two blocks of BLOCK texts a task."""

        def compare(t: pa.Table) -> pa.Table:
            nodes, blocks, minima, labels = t["node"].to_pylist(), np.array(t["blk"]), _minima(t["sketch"]), np.array(t["comp"])
            roots, two, out = _Roots(labels.tolist()), bool((blocks != blocks[0]).any()), []
            for x in range(1, len(nodes)):
                other = labels[:x] != labels[x]
                if two:
                    other &= blocks[:x] != blocks[x]
                others = np.flatnonzero(other)
                if len(others):
                    out += [(nodes[x], nodes[y]) for y in others[_equal(minima[others], minima[x]) >= CLOSE].tolist() if roots.join(x, y)]
            return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

        rows = self.dealt(members.select("key", "mask", "node", "comp", (F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks")))
        rows = rows.join(self.classes.select("node", "sketch"), "node").select("key", "mask", "i", "j", "blk", "node", "comp", "sketch")
        return rows.groupBy("key", "mask", "i", "j").applyInArrow(compare, "a long, b long")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` with blk, their block of ``blocks``, once for each pair of blocks i <= j that it is in."""
        rows = rows.withColumn("blk", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.withColumns({"i": F.least("blk", "o"), "j": F.greatest("blk", "o")}).drop("o", "blocks")

    def settled(self) -> DataFrame:
        """Links between the parts of each group: blocks of texts outside of its largest part with blocks of all of it."""

        def compare(t: pa.Table) -> pa.Table:
            t = t.sort_by([("out", "descending")])
            nodes, outside, minima, labels = t["node"].to_pylist(), t["out"].to_pylist(), _minima(t["sketch"]), np.array(t["comp"])
            roots, found, sets = _Roots(labels.tolist()), [], {}
            for x in range(len(nodes)):
                if not outside[x]:
                    break
                mine = None
                others = np.flatnonzero(labels != labels[x])
                for y in others[_equal(minima[others], minima[x]) >= CLOSE].tolist() if len(others) else []:
                    if nodes[x] == nodes[y] or roots.find(x) == roots.find(y):
                        continue
                    mine = _shingles(t["t"][x].as_py()) if mine is None else mine
                    if y not in sets:
                        sets[y] = _shingles(t["t"][y].as_py())
                    if _alike(mine, sets[y]):
                        roots.join(x, y)
                        found.append((nodes[x], nodes[y]))
            return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

        groups = self.connected(self.close).withColumnRenamed("component", "g")
        rows = self.save(self.labelled(groups, self.comps, "comp").groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n")), "parts")
        best = rows.groupBy("g").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"), F.max("n").alias("most")).filter("parts > 1")
        rows = self.labelled(groups, self.comps, "comp").join(best, "g").withColumn("out", F.col("comp") != F.col("main"))
        few, many = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
        rows = self.save(rows.withColumns({"few": few, "many": many}), "settling")
        deal = lambda n: F.pmod(F.xxhash64("node", F.lit(9)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = rows.filter("out").select("g", "node", "comp", F.lit(True).alias("out"), deal("few").alias("i"), each("many").alias("j"))
        all_ = rows.select("g", "node", "comp", F.lit(False).alias("out"), each("few").alias("i"), deal("many").alias("j"))
        rows = self.texts(one.union(all_).join(self.classes.select("node", "sketch"), "node"))
        return rows.select("g", "i", "j", "node", "comp", "out", "sketch", "t").groupBy("g", "i", "j").applyInArrow(compare, "a long, b long")


def placed(docs: DataFrame) -> DataFrame:
    """(doc, file, at) of a table read from Parquet: the row, and its place in a file of that hash."""
    place = docs.metadataColumn("_metadata")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"))


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that near duplicates connect: that of the smallest doc_id, null being the largest.

    Rows go by their places in the files that ``docs`` reads, so repeated and null
    ids are rows like others. Where ``docs`` isn't read from files, or places aren't
    unique, it is written first. Texts without a word are copies of each other.
    """
    scratch = Scratch(spark, "dedup")

    def signed() -> tuple[DataFrame, DataFrame]:
        rows = placed(docs)
        found = rows.select(F.monotonically_increasing_id().alias("key"), "file", "at", F.col("doc.doc_id").alias("id"), F.xxhash64("doc").alias("tie"), F.col("doc.text").cast("binary").alias("t"))
        return rows, scratch.save(signatures(found), "signatures")

    try:
        rows, found = signed()
        whole = found.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    except AnalysisException:
        whole = False
    if not whole:
        docs = scratch.save(docs, "rows")
        rows, found = signed()
    best = F.struct(F.col("id").isNull().alias("none"), "id", "tie", F.col("key").alias("node"))
    classes = found.groupBy("digest").agg(F.min(best).alias("best"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    classes = scratch.save(classes.select("best", "best.node", "fp", "sketch"), "classes")
    places = found.select(F.col("key").alias("node"), "file", "at")
    search = _Search(scratch, classes.select("node", "fp", "sketch"), places, rows.select("file", "at", F.col("doc.text").cast("binary").alias("t")))
    search.found()
    chosen = classes.select("node", "best")
    if search.comps is not None:
        chosen = chosen.join(search.comps, "node", "left").groupBy(F.coalesce("component", "node").alias("comp")).agg(F.min("best").alias("best"))
    gone = found.join(chosen.select(F.col("best.node").alias("key")), "key", "left_anti").select("file", "at")
    gone = scratch.save(gone, "gone")
    for name in (*search.names, "signatures", "classes", "groups"):
        scratch.drop(name)
    # of the rows only those that go, or hash like such, are shuffled
    sieved = sifted(rows, sieve(gone))
    kept = sieved.filter("maybe").join(gone.hint("merge"), ["file", "at"], "left_anti")
    return sieved.filter("not maybe").select("doc.*").union(kept.select("doc.*"))
