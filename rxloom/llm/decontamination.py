"""Benchmark passages in documents, by latent semantic retrieval and alignment.

1. Words of the benchmark are counted over all documents (inverse frequency).
2. TF-IDF vectors of all 64-word passages are sketched as Y = A'A.Omega with a random
   Omega; the Nystroem form of the randomised SVD turns the sum of the partitions'
   sketches into the leading right singular vectors. Only the benchmark's words are
   terms, so every matrix is bounded by the benchmark and the rank.
3. Windows of three lengths over all documents are projected and compared by cosine
   with the benchmark pieces of like length.
4. Candidates must share a longest common subsequence of words with the piece, both
   with all of it and with its last part, the answer. Paraphrases pass, chance doesn't.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from rxloom.llm.common import Scratch

BLOCK = 8
#: Window lengths in words, all multiples of BLOCK; windows start at every BLOCK-th word.
SCALES = (16, 32, 64)
PASSAGE = 64
RANK = 64
COSINE = 0.3
#: Share of a piece's length that a window must reach along the piece's direction.
REACH = 0.2
#: Terms are weighted by this power of the logarithm: common words say little about a leak.
POWER = 3
#: Shares of the piece's and of the answer's words that the common subsequence must hold.
SHARE, ANSWER = 0.6, 0.5
#: Benchmark rows, and bytes of them, whose pieces are compared in one go; more are compared in turns of as many.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 64 << 20
#: Sketches that are summed up: so many for each core, however many parts the texts have.
SKETCHES = 3
#: Words of a document whose windows are weighed against the pieces together, before each window is.
SEGMENT = 512
#: Blanks between documents that are searched together: no window's surroundings reach the next one.
APART = 3 * SCALES[-1] // 2
_STEP = 1 << 15
_PRODUCTS = 1 << 22
_SPLIT = bytes(32 if not (chr(c).isalnum() or c >= 128) else ord(chr(c).lower()) for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and bytes beyond ASCII, with A-Z lower-cased."""
    return (text or b"").translate(_SPLIT).split()


@dataclass
class Pieces:
    """The benchmark cut into pieces of at most PASSAGE words, and its words numbered from 0."""

    vocab: dict[bytes, int] = field(default_factory=dict)
    items: list[int] = field(default_factory=list)
    ids: list[list[int]] = field(default_factory=list)
    answers: list[int] = field(default_factory=list)  # words of the last part
    idf: np.ndarray | None = None
    basis: np.ndarray | None = None
    vectors: np.ndarray | None = None
    lengths: np.ndarray | None = None

    def add(self, item: int, text: str) -> None:
        found = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text.encode())]
        last = re.split(r"(?<=[.!?])\s+", text.strip())[-1]
        tail = len(words(last.encode()))
        tail = tail if 2 <= tail < len(found) else max(1, len(found) // 4)
        for at in range(0, max(1, len(found) - PASSAGE // 2), PASSAGE // 2):
            part = found[at : at + PASSAGE]
            if part:
                self.items.append(item)
                self.ids.append(part)
                self.answers.append(tail if at + PASSAGE >= len(found) and tail < len(part) else max(1, len(part) // 4))

    def scale(self, piece: int) -> int:
        return next((s for s in SCALES if len(self.ids[piece]) <= s * 1.25), SCALES[-1])


def encoded(text: bytes | None, vocab: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words; other words get len(vocab)."""
    found = words(text)
    return np.fromiter(map(vocab.get, found, repeat(len(vocab))), dtype=np.int64, count=len(found))


def streams(batches: Iterator[pa.RecordBatch], vocab: dict[bytes, int], column: int = 0) -> Iterator[np.ndarray]:
    for b in batches:
        for t in b.column(column):
            yield encoded(t.as_py(), vocab)


def in_steps(arrays: Iterator[np.ndarray], blank: int) -> Iterator[np.ndarray]:
    """The arrays end to end, each padded to whole passages, cut to steps of bounded length."""
    held, size = [], 0
    for a in arrays:
        for at in range(0, len(a), _STEP):
            part = a[at : at + _STEP]
            held.append(np.concatenate([part, np.full(-len(part) % PASSAGE, blank)]))
            size += len(held[-1])
            if size >= _STEP:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def word_counts(docs: DataFrame, vocab: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """How often each word of ``vocab`` occurs in all of ``docs``, and the number of all words."""
    shared, size = docs.sparkSession.sparkContext.broadcast(vocab), len(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, dtype=np.int64)
        for a in in_steps(streams(batches, shared.value), size):
            counts += np.bincount(a, minlength=size + 1)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["w", "n"])

    found = docs.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size + 1, dtype=np.int64)
    for r in found:
        out[r["w"]] = r["n"]
    return out[:size], int(out.sum())


def sketch_step(a: np.ndarray, weighted: np.ndarray, idf: np.ndarray, y: np.ndarray) -> None:
    """Adds A'(A.Omega) of the passages in ``a`` to ``y``; ``weighted`` is idf * Omega with a zero row at the end."""
    x = weighted[a].reshape(-1, PASSAGE, weighted.shape[1]).sum(axis=1)
    keep = np.nonzero(a < len(idf))[0]
    order = keep[np.argsort(a[keep].astype(np.uint16 if len(idf) < 1 << 16 else np.int64), kind="stable")]
    if len(order):
        w = a[order]
        first = np.nonzero(np.concatenate(([True], w[1:] != w[:-1])))[0]
        y[w[first]] += np.add.reduceat(x[order // PASSAGE], first, axis=0) * idf[w[first], None]


def randomised_svd(docs: DataFrame, vocab: dict[bytes, int], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the TF-IDF passages of all of ``docs``.

    The random matrix is drawn again from its seed in each task. A task sends
    one row per benchmark word, and so much comes to the driver.
    """
    size, rank = len(vocab), min(rank, len(vocab))
    draw = lambda: np.random.default_rng(11).normal(size=(size, rank)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, idf.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, idf = shared.value
        weighted = np.vstack([draw() * idf[:, None], np.zeros((1, rank), np.float32)])
        y = np.zeros((size, rank), dtype=np.float64)
        for a in in_steps(streams(batches, vocab), size):
            sketch_step(a, weighted, idf, y)
        at = np.nonzero(y.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(c) for c in y[at].astype(np.float32).T]], ["w", *names])

    names = [f"y{k}" for k in range(rank)]
    parts = docs.coalesce(SKETCHES * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, ", ".join(["w long", *[f"{n} float" for n in names]]))
    y = np.zeros((size, rank))
    for r in parts.groupBy("w").agg(*[F.sum(F.col(n).cast("double")).alias(n) for n in names]).toLocalIterator():
        y[r["w"]] = r[1:]
    return nystroem(y, draw().astype(np.float64))


def nystroem(y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Eigenvectors of A'A from Y = A'A.Omega."""
    shift = 1e-7 * max(np.linalg.norm(y), 1e-12)
    y = y + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-30)
    half = vectors[:, good] / np.sqrt(values[good])
    u, s, _ = np.linalg.svd(y @ half, full_matrices=False)
    return u[:, s > 1e-9 * max(s.max(), 1e-30)]


def prepare(pieces: Pieces, basis: np.ndarray) -> None:
    table = np.vstack([basis * pieces.idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
    vectors = np.array([table[i].sum(axis=0) for i in pieces.ids])
    pieces.basis = table
    pieces.lengths = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
    pieces.vectors = vectors / pieces.lengths[:, None]


def inverse_frequency(counts: np.ndarray, total: int) -> np.ndarray:
    return np.log1p((total / PASSAGE + 1) / (counts + 1)) ** POWER


def common(masks: dict[int, int], size: int, stream: list[int]) -> int:
    """Length of the longest common subsequence, bit by bit; ``masks`` has the places of each word in the piece."""
    full = (1 << size) - 1
    v = full
    for w in stream:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for at, w in enumerate(ids):
        out[w] = out.get(w, 0) | 1 << at
    return out


class Search:
    """Finds pieces in documents, of which it lays short ones end to end."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        scale = np.array([pieces.scale(i) for i in range(len(pieces.ids))])
        self.by = {s: np.nonzero(scale == s)[0] for s in SCALES}
        self.reach = {s: REACH * pieces.lengths[at] for s, at in self.by.items()}
        self.scale = scale.tolist()
        self.lut = np.full(len(pieces.vocab) + 1, -1)
        # different words of each piece, how often the piece and its answer have them
        self.bags = []
        for i, n in zip(pieces.ids, pieces.answers, strict=True):
            own, at = np.unique(i, return_inverse=True)
            self.bags.append((own, np.bincount(at), np.bincount(at[-n:], minlength=len(own))))
        # the same as rows of equal length
        shape = (len(pieces.ids), max(len(own) for own, _, _ in self.bags))
        self.words, self.count, self.answer = np.full(shape, len(pieces.vocab), np.int32), np.zeros(shape, np.int16), np.zeros(shape, np.int16)
        for i, (own, count, answer) in enumerate(self.bags):
            self.words[i, : len(own)], self.count[i, : len(own)], self.answer[i, : len(own)] = own, count, answer
        self.sizes, self.answers = np.array([len(i) for i in pieces.ids]), np.array(pieces.answers)
        self.masks = [masks_of(i) for i in pieces.ids]
        self.tails = [masks_of(i[-n:]) for i, n in zip(pieces.ids, pieces.answers, strict=True)]

    def candidates(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, first word), by piece, of the windows over COSINE, over all of ``a``."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        most = SCALES[-1]
        for at in range(0, max(len(a), 1), _STEP):
            part = a[at : at + _STEP + most]
            part = np.concatenate([part, np.full(-len(part) % BLOCK + most, len(self.p.vocab))])
            level = self.p.basis[part].reshape(-1, BLOCK, self.p.basis.shape[1]).sum(axis=1)
            size, starts = BLOCK, -(-min(_STEP, len(a) - at) // BLOCK)
            for s in SCALES:
                while size < s:
                    level = level[: -(size // BLOCK)] + level[size // BLOCK :]
                    size *= 2
                if len(self.by[s]):
                    norm = np.sqrt(np.einsum("ij,ij->i", level[:starts], level[:starts]))
                    large = np.nonzero(norm >= self.reach[s].min())[0]
                    for few in np.array_split(large, -(-len(large) * len(self.by[s]) // _PRODUCTS)) if len(large) else ():
                        along = level[few] @ self.p.vectors[self.by[s]].T
                        rows, cols = np.nonzero((along >= COSINE * norm[few, None]) & (along >= self.reach[s]))
                        out.append(self.by[s][cols] << 40 | (at + few[rows] * BLOCK))
        found = np.unique(np.concatenate(out))
        return found >> 40, found & ((1 << 40) - 1)

    def held(self, pieces: np.ndarray, starts: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Which candidates' segments, with the words that their surroundings reach, have enough of the piece and of its answer, in any order."""
        segment, keep, pad = starts // SEGMENT, np.zeros(len(starts), dtype=bool), SCALES[-1] // 2
        order = np.argsort(segment, kind="stable")
        cuts = np.nonzero(np.diff(segment[order], prepend=-1, append=-1))[0]
        bag = np.zeros(len(self.p.vocab) + 1, dtype=np.int16)
        for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = order[first:end]
            at = int(segment[some[0]]) * SEGMENT
            own, have = np.unique(a[max(0, at - pad) : at + SEGMENT + 3 * pad], return_counts=True)
            bag[own] = have
            # candidates come by piece
            near = np.concatenate(([True], np.diff(pieces[some]) != 0))
            p = pieces[some[near]]
            found = bag[self.words[p]]
            enough = (np.minimum(found, self.count[p]).sum(axis=1) / self.sizes[p] >= SHARE) & (np.minimum(found, self.answer[p]).sum(axis=1) >= ANSWER * self.answers[p])
            keep[some] = enough[np.cumsum(near) - 1]
            bag[own] = 0
        return keep

    def possible(self, piece: int, starts: np.ndarray, padded: np.ndarray) -> np.ndarray:
        """Those of the ``starts`` whose words around, in any order, have enough of the piece and of its answer: no subsequence is longer.

        ``padded`` has the words after SCALES[-1] blanks, and as many pairs of blanks after them.
        """
        own, count, answer = self.bags[piece]
        self.lut[own] = np.arange(len(own))
        s, n = self.scale[piece], self.p.answers[piece]
        keep = []
        for at in range(0, len(starts), 4096):
            part = starts[at : at + 4096]
            near = self.lut[padded[part[:, None] + np.arange(2 * s) + (SCALES[-1] - s // 2)]]
            rows, cols = np.nonzero(near >= 0)
            bags = np.bincount(rows * len(own) + near[rows, cols], minlength=len(part) * len(own)).reshape(len(part), len(own))
            enough = (np.minimum(bags, count).sum(axis=1) / len(self.p.ids[piece]) >= SHARE) & (np.minimum(bags, answer).sum(axis=1) >= ANSWER * n)
            keep.append(part[enough])
        self.lut[own] = -1
        return np.concatenate(keep)

    def matches(self, a: np.ndarray) -> dict[int, float]:
        """The matches of one document."""
        return self.matches_of([a])[0]

    def matches_of(self, docs: Iterable[np.ndarray]) -> list[dict[int, float]]:
        """For each document, item: share of the piece's words in the best common subsequence, for the items that pass."""
        out: list[dict[int, float]] = []
        held, size = [], 0
        for a in docs:
            held.append(a)
            size += len(a) + APART
            if size >= _STEP:
                out += self.together(held)
                held, size = [], 0
        return out + self.together(held)

    def together(self, docs: list[np.ndarray]) -> list[dict[int, float]]:
        found: list[dict[int, float]] = [{} for _ in docs]
        if not docs:
            return found
        lengths = np.array([len(a) for a in docs])
        room = lengths + -lengths % BLOCK + APART
        offsets, blank = np.cumsum(room) - room, len(self.p.vocab)
        padded = np.full(room.sum() + 3 * SCALES[-1], blank)
        a = padded[SCALES[-1] : -2 * SCALES[-1]]
        for x, at in zip(docs, offsets.tolist(), strict=True):
            a[at : at + len(x)] = x
        pieces, starts = self.candidates(a)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        inside = starts - offsets[doc] < lengths[doc]  # windows start in a document, not in blanks
        pieces, starts, doc = pieces[inside], starts[inside], doc[inside]
        keep = self.held(pieces, starts, a)
        pieces, starts, doc = pieces[keep], starts[keep], doc[keep]
        cuts = np.nonzero(np.diff(pieces, prepend=-1, append=-1))[0]
        for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            piece = int(pieces[first])
            ids, pad, n, item = self.p.ids[piece], self.scale[piece] // 2, self.p.answers[piece], self.p.items[piece]
            some = self.possible(piece, starts[first:end], padded)
            for at, own in zip(some.tolist(), doc[first:end][np.searchsorted(starts[first:end], some)].tolist(), strict=True):
                stream = a[max(0, at - pad) : at + 3 * pad].tolist()
                share = common(self.masks[piece], len(ids), stream) / len(ids)
                if share >= SHARE and share > found[own].get(item, 0) and common(self.tails[piece], n, stream) >= ANSWER * n:
                    found[own][item] = share
        return found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", at_once: int = ITEMS_AT_ONCE, with_text: bool = False) -> DataFrame:
    """One row per document: id, items (array of benchmark ids found), best (largest share, 0.0 if none); with t (the text's bytes) on request.

    Words, weights and basis are those of the whole benchmark. With more than
    ``at_once`` benchmark rows, or BYTES_AT_ONCE of them, the pieces are compared in turns, each of which
    adds to the row that it reads. Null or wordless texts on either side match
    nothing; repeated documents have a row each; repeated benchmark rows count
    once. Other columns are not read.
    """
    items = benchmark.filter(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    vocab: dict[bytes, int] = {}
    n_items, n_bytes = 0, 0
    for r in items.orderBy("i", "t").toLocalIterator():
        n_items, n_bytes = n_items + 1, n_bytes + len(r["t"])
        for w in words(r["t"].encode()):
            vocab.setdefault(w, len(vocab))
    texts = docs.select(F.col(text_col).cast("binary").alias("t"))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), F.expr("cast(array() as array<long>)").alias("items"), F.lit(0.0).alias("best"))
    kept = ["id", "t", "items", "best"] if with_text else ["id", "items", "best"]
    if not vocab:
        return found.select(kept)
    counts, total = word_counts(texts, vocab)
    idf = inverse_frequency(counts, total)
    basis = randomised_svd(texts, vocab, idf)
    turns, scratch = max(1, -(-n_items // at_once), -(-n_bytes // BYTES_AT_ONCE)), Scratch(docs.sparkSession, "leaks")
    for turn in range(turns):
        pieces = Pieces(vocab=vocab, idf=idf)
        for r in sorted(items.filter(F.pmod(F.xxhash64("i"), F.lit(turns)) == turn).collect()):
            pieces.add(r["i"], r["t"])
        if not pieces.ids:
            continue
        prepare(pieces, basis)
        shared, last = docs.sparkSession.sparkContext.broadcast(pieces), turn == turns - 1
        names = kept if last else found.columns

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value)
            for b in batches:
                more = search.matches_of(encoded(t.as_py(), search.p.vocab) for t in b.column(1))
                items = [sorted({*old, *new}) for old, new in zip(b.column(2).to_pylist(), more, strict=True)]
                best = [max(old, *new.values()) if new else old for old, new in zip(b.column(3).to_pylist(), more, strict=True)]
                out = {"id": b.column(0), "t": b.column(1), "items": pa.array(items, pa.list_(pa.int64())), "best": pa.array(best, pa.float64())}
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

        kinds = {"id": docs.schema[id_col].dataType, "t": BinaryType(), "items": ArrayType(LongType()), "best": DoubleType()}
        found = found.mapInArrow(run, StructType([StructField(n, kinds[n]) for n in names]))
        if not last:
            found = scratch.save(found, f"turn-{turn}")
            if turn:
                scratch.drop(f"turn-{turn - 1}")
    return found.select(kept)


def op8_decontamination(spark, sf_dir) -> DataFrame:
    """doc_id, n_items, item_ids, best_share, contaminated of all of ``documents``."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.size("items").cast("long").alias("n_items"), F.col("items").alias("item_ids"), F.col("best").alias("best_share"), (F.size("items") > 0).alias("contaminated"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows in whose text no benchmark passage is found, whatever their ids."""
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), "text")
    found = contamination(packed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row", "text", with_text=True).filter(F.size("items") == 0)
    return found.select(*[F.col("t").cast("string").alias(c) if c == "text" else F.col(f"id.`{c}`").alias(c) for c in docs.columns])
