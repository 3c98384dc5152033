"""Removal of repeated byte strings by suffix arrays.

A byte goes when some string of ``LENGTH`` bytes that covers it also starts elsewhere in
the corpus. Suffixes are dealt out by content so that equal strings meet:

1. Every string of LENGTH bytes has an anchor, the ``GRAM`` bytes in it of the smallest
   hash. Neighbouring strings share their anchor; such a run of strings is a record.
   Equal strings have equal anchors at equal places, so only records whose anchor
   occurs again can repeat.
2. Records with the same bytes are folded into one with a count.
3. The different records of each anchor go to one task, which builds a suffix array of
   them by two-stage sorting: only suffixes that are smaller than their successors are
   sorted, all others follow from these by scanning the buckets of first bytes from the
   smallest on. Neighbours in the array with a common prefix of LENGTH bytes repeat.
4. An anchor with too many different records for a task has its strings counted one by
   one instead, by their digests, pre-aggregated before the shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxloom.llm.common import Scratch

LENGTH = 400
GRAM = 96
#: Bytes of different records that are sorted together; an anchor with more is counted by digests.
TOGETHER = 2 << 20
#: Bytes of records of several anchors that are sorted together; an anchor with more is sorted alone.
SORTED = 1 << 19
#: Bytes of texts in a bucket, and the most buckets that Spark takes.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 100_000
#: Bytes of texts that are hashed together, and starts of a long text that are taken at a time.
GROUP = 1 << 18
#: Bytes of texts that a worker takes from a batch at a time.
SLICE = 4 << 20
_POSITION = np.uint64((1 << 22) - 1)
_RNG = np.random.default_rng(2024)
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64, n at least."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, GROUP + 4096)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[0]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each place."""
    up, down = _powers(len(data) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_TABLE[data] * down[: len(data)])))
    h = (sums[gram:] - sums[:-gram]) * up[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    n = len(values)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def records(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first, last, anchor): runs of string starts first..last in a text that share their anchor.

    Texts shorter than ``length`` have none. Long texts are taken in sections
    that overlap by all but one byte of a string.
    """
    out, group, size = [], [], 0

    def flush() -> None:
        data = np.frombuffer(b"".join(t[a : b + length - 1] for _, t, a, b in group), dtype=np.uint8)
        hashes = gram_hashes(data, gram)
        keyed = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
        at = (window_least(keyed, length - gram + 1) & _POSITION).astype(np.int64)
        base = 0
        firsts, lasts, owners, shifts = [], [], [], []
        for owner, _, a, b in group:
            own = at[base : base + b - a]
            cut = np.nonzero(own[1:] != own[:-1])[0] + 1
            first = np.concatenate(([0], cut))
            firsts.append(first + base)
            lasts.append(np.concatenate((cut, [b - a])) - 1 + base)
            owners.append(np.full(len(first), owner))
            shifts.append(np.full(len(first), a - base))
            base += b - a + length - 1
        first, shift = np.concatenate(firsts), np.concatenate(shifts)
        out.append((np.concatenate(owners), first + shift, np.concatenate(lasts) + shift, hashes[at[first]].view(np.int64)))

    for owner, t in enumerate(texts):
        for a in range(0, len(t) - length + 1, GROUP):
            b = min(a + GROUP, len(t) - length + 1)
            group.append((owner, t, a, b))
            size += b - a + length
            if size >= GROUP:
                flush()
                group, size = [], 0
    if group:
        flush()
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def _words(data: np.ndarray, size: int) -> np.ndarray:
    """The eight bytes at each of the first ``size`` places as a big-endian number."""
    w = np.zeros(size, dtype=np.uint64)
    for k in range(8):
        w = (w << np.uint64(8)) | data[k : k + size]
    return w


def _depths(length: int) -> list[int]:
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]


def sort_directly(places: np.ndarray, words: np.ndarray, depths: list[int]) -> np.ndarray:
    """``places`` by the bytes that follow, eight at a time; only what is still equal is looked at again."""
    if not len(places):
        return places
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    slot, fresh = np.arange(len(order)), np.concatenate(([True], key[1:] != key[:-1]))
    for depth in depths[1:]:
        group = np.cumsum(fresh)
        alone = np.bincount(group)[group] == 1
        slot, group = slot[~alone], group[~alone]
        if not len(slot):
            break
        p = order[slot]
        key = words[p + depth]
        inner = group[1:] == group[:-1]
        mixed = np.zeros(group[-1] + 1, dtype=bool)
        mixed[group[1:][inner & (key[1:] != key[:-1])]] = True
        sub = np.nonzero(mixed[group])[0]
        if len(sub):
            o = sub[np.lexsort((key[sub], group[sub]))]
            order[slot[sub]], key[sub] = p[o], key[o]
        fresh = np.concatenate(([True], ~inner | (key[1:] != key[:-1])))
    return order


def two_stage(data: np.ndarray, wanted: np.ndarray, words: np.ndarray, depths: list[int]) -> np.ndarray:
    """The wanted suffixes of ``data`` in order, as far as the first bytes up to the last depth decide.

    Suffixes that are not smaller than their successors need those to be placed:
    with each wanted one the following up to the next smaller-than-successor
    are placed too.
    """
    n = len(wanted)
    step = np.sign(data[1 : n + 1].astype(np.int16) - data[:n].astype(np.int16))
    step[n - 1] = -1  # the end is smaller than anything
    decided = np.where(step != 0, np.arange(n), n - 1)
    rising = step[np.minimum.accumulate(decided[::-1])[::-1]] > 0
    next_rising = np.minimum.accumulate(np.where(rising, np.arange(n), n - 1)[::-1])[::-1]
    span = np.zeros(n + 1, dtype=np.int64)
    at = np.nonzero(wanted)[0]
    np.add.at(span, at, 1)
    np.add.at(span, next_rising[at] + 1, -1)
    placed = np.cumsum(span[:n]) > 0

    direct = sort_directly(np.nonzero(placed & rising)[0], words, depths)
    starts = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if placed[n - 1] and not rising[n - 1]:
        waiting[data[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front = waiting[c]
        newest = np.concatenate(front) if front else np.zeros(0, dtype=np.int64)
        bucket = [newest]
        while len(newest):
            before = newest[newest > 0] - 1
            newest = before[placed[before] & ~rising[before] & (data[before] == c)]
            bucket.append(newest)
        full = np.concatenate([*bucket, direct[starts[c] : starts[c + 1]]])
        out.append(full)
        before = full[full > 0] - 1
        before = before[placed[before] & ~rising[before] & (data[before] > c)]
        first = data[before]
        o = np.argsort(first, kind="stable")
        before, first = before[o], first[o]
        if len(first):
            cuts = np.nonzero(np.concatenate(([True], first[1:] != first[:-1], [True])))[0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                waiting[first[a]].append(before[a:b])
    order = np.concatenate(out)
    return order[wanted[order]]


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text whether the string of ``length`` bytes at each start occurs at another start of any of the texts."""
    sizes = np.array([len(t) for t in texts])
    bases = np.concatenate(([0], np.cumsum(sizes)))
    n = int(bases[-1])
    data = np.frombuffer(b"".join(texts) + bytes(length + 8), dtype=np.uint8)
    wanted = np.zeros(n, dtype=bool)
    for b, s in zip(bases, sizes, strict=False):
        wanted[b : b + max(0, s - length + 1)] = True
    depths, again = _depths(length), np.zeros(n, dtype=bool)
    if wanted.any():
        words = _words(data, n + length)
        order = two_stage(data, wanted, words, depths)
        left, right = order[:-1], order[1:]
        for depth in depths:  # the common prefix of neighbours, given up where it ends early
            same = words[left + depth] == words[right + depth]
            left, right = left[same], right[same]
        again[left] = again[right] = True
    return [again[b : b + max(0, s - length + 1)] for b, s in zip(bases, sizes, strict=False)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] - 1


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose binary ``column`` has about SLICE bytes, one row at least."""
    for b in batches:
        ends, at = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(column)]), 0
        while at < b.num_rows:
            below = ends[at - 1] if at else 0
            end = max(int(np.searchsorted(ends, below + SLICE, side="right")), at + 1)
            yield b.slice(at, end - at)
            at = end


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 2):
            row, first, last, anchor = records(b.column(2).to_pylist(), length)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), b.column(0).take(row), b.column(1).take(row), pa.array(first), pa.array(last)], ["h", "k", "d", "i", "j"])

    return run


def _members(length: int):
    """For each record of a text (k, d, t, l: array of (i, j, h)) its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(3).offsets.to_numpy())
            row, flat = np.repeat(np.arange(b.num_rows), sizes), b.column(3).flatten()
            first, last = flat.field(0).to_pylist(), flat.field(1).to_pylist()
            texts = b.column(2).to_pylist()
            found = [_digest(texts[r][i : j + length]) for r, i, j in zip(row.tolist(), first, last, strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), flat.field(2), b.column(0).take(take), b.column(1).take(take), flat.field(0), flat.field(1)], ["x", "h", "k", "d", "i", "j"])

    return run


def _cut(length: int):
    """The bytes of each record (k, d, t, l: array of (i, j, h, n))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                text, rows = b.column(2)[r].as_py(), b.column(3)[r].values
                first, last = rows.field(0).to_pylist(), rows.field(1).to_pylist()
                part = [text[i : j + length] for i, j in zip(first, last, strict=True)]
                take = pa.array([r] * len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.field(2), rows.field(3), b.column(0).take(take), b.column(1).take(take), rows.field(0), pa.array(part, pa.binary())], ["h", "n", "k", "d", "i", "s"])

    return run


def _sorted_repeats(length: int):
    """(k, d, a, b) of the repeats in records that come in order of their anchor."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list[int]] = [[], [], [], []]
        for (_, n, k, d, i, _), again in zip(rows, repeated_starts([r[5] for r in rows], length), strict=True):
            if n == 1:
                for a, b in zip(*_runs(again), strict=True):
                    for column, v in zip(out, (k, d, i + int(a), i + int(b) + length), strict=True):
                        column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["k", "d", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size, rows, held, last = [], 0, [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != last:
                    if size + held > SORTED and done:
                        yield flush(done)
                        done, size = [], 0
                    done += rows
                    size += held
                    rows, held, last = [], 0, row[0]
                rows.append(row)
                held += len(row[5])
        done += rows
        if done:
            yield flush(done)

    return run


def _digests(length: int):
    """(g, n, k, d, a): the digest of each string of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, n, k, d, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                count = len(s) - length + 1
                g = [_digest(s[o : o + length]) for o in range(count)]
                same = lambda v, m=count: pa.array([v] * m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.binary()), same(n), same(k), same(d), pa.array(range(i, i + count), pa.int64())], ["g", "n", "k", "d", "a"])

    return run


def _results(with_kept: bool):
    """From (id, t, l: array of (a, b) to be removed) the sizes, spans, digest and, on request, rest of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for t, l in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for x in sorted((x["a"], x["b"]) for x in l or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                cuts = [0, *(p for s in spans for p in s), len(t)]
                rest = b"".join(t[p:q] for p, q in zip(cuts[::2], cuts[1::2], strict=True))
                for column, v in zip(out, (len(t), len(t) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if with_kept else None), strict=True):
                    column.append(v)
            names, kinds = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns[: 5 + with_kept], names[: 5 + with_kept])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``with_kept``, kept (the remaining bytes).

    Null texts count as empty. Repeated rows repeat each other's strings like
    any other rows; a null id is an id. Other columns are not read.

    Texts are dealt out by row key once, into buckets of a bounded size, and
    written so; records are joined to them where they are. The table of buckets
    is dropped when the result, which is written too, is there.
    """
    if length < GRAM + 8:
        raise ValueError(f"strings must have at least {GRAM + 8} bytes")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "suffixes")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select(F.xxhash64("id", "t").alias("k"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("d"), "id", F.col("t").cast("binary").alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    deal, name = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-total // BUCKET_BYTES), MOST_BUCKETS)), f"texts_{uuid.uuid4().hex}"
    kind = docs.schema[id_col].dataType.simpleString()
    try:
        rows.repartition(deal, "k", "d").write.bucketBy(deal, "k", "d").option("path", f"{scratch.base}/texts").format("parquet").saveAsTable(name)
        texts = spark.table(name)
        marks = _repeats(scratch, texts, length, deal)
        told = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
        return scratch.save(texts.join(marks, ["k", "d"], "left").select("id", "t", "l").mapInArrow(_results(with_kept), told), "results")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _repeats(scratch: Scratch, texts: DataFrame, length: int, deal: int) -> DataFrame:
    """(k, d, l: array of (a, b)) of the texts with repeats."""
    anchors = texts.filter(F.length("t") >= length).select("k", "d", "t").mapInArrow(_anchors(length), "h long, k long, d long, i long, j long")
    anchors = scratch.save(anchors, "anchors")
    # written, so that the join has its own exchanges, which adaptive execution splits at a hot anchor
    again = scratch.save(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "again")
    lists = anchors.join(again, "h", "left_semi").groupBy("k", "d").agg(F.collect_set(F.struct("i", "j", "h")).alias("l"))
    members = texts.join(lists, ["k", "d"]).select("k", "d", "t", "l").mapInArrow(_members(length), "x binary, h long, k long, d long, i long, j long")
    members = scratch.save(members, "members")

    classes = members.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "d", "i", "j", "h")).alias("r")).select("x", "n", "r.*")
    classes = scratch.save(classes, "classes")
    marks = members.join(classes.filter("n > 1").select("x"), "x", "left_semi").select("k", "d", F.col("i").alias("a"), (F.col("j") + length).alias("b"))

    loads = classes.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("j") - F.col("i") + length).alias("bytes")).filter("m > 1")
    unlike = classes.join(loads, "h").select("k", "d", "i", "j", "h", "n", "bytes")
    for hot, found in ((False, f"bytes <= {TOGETHER}"), (True, f"bytes > {TOGETHER}")):
        part = unlike.filter(found).groupBy("k", "d").agg(F.collect_list(F.struct("i", "j", "h", "n")).alias("l"))
        part = texts.join(part, ["k", "d"]).select("k", "d", "t", "l")
        if hot:
            each = scratch.save(part.mapInArrow(lambda it: _digests(length)(_cut(length)(it)), "g binary, n long, k long, d long, a long"), "digests")
            twice = each.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("g")
            part = each.filter("n = 1").join(twice, "g", "left_semi").select("k", "d", "a", (F.col("a") + length).alias("b"))
        else:
            part = part.mapInArrow(_cut(length), "h long, n long, k long, d long, i long, s binary").repartition(deal, "h").sortWithinPartitions("h").mapInArrow(_sorted_repeats(length), "k long, d long, a long, b long")
        marks = marks.union(part)
    return marks.groupBy("k", "d").agg(F.collect_set(F.struct("a", "b")).alias("l"))


def op1_suffix_dedup(spark, sf_dir) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats of all of ``documents``."""
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"))
