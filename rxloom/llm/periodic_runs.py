"""Periodic runs of words, by divide and conquer with Z-functions at each midpoint.

A run is a stretch of words with smallest period q that is at least four periods and
six words long and can't be made longer. One that crosses the midpoint of a segment
reaches two periods or more to one side of it, so it begins the right half, or ends the
left one, with a square: the Z-function of the right half, or of the left one read
backwards, is q or more at q. Such a q is extended to both sides as far as it holds.
Periods go upwards, and a square that lies within the run of a smaller period is a
multiple of it, so that each stretch is kept with its smallest period. Runs that cross
no midpoint lie in one of the halves.

Each word of a run occurs four times or more in it. So words are interned, a text is
cut where a word is rarer than that, and only the pieces are divided.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Periods that a run holds at least, and words that it has at least.
PERIODS, WORDS = 4, 6
#: A run of a smaller period has no other runs in it: with period p it would have 6 words, but less than p and that period together.
SIMPLE = 4
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def interned(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal where words are."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements of ``a`` and ``b`` are equal from their beginnings on."""
    size, at, step = min(len(a), len(b)), 0, 8
    while at < size:
        end = min(size, at + step)
        unlike = a[at:end] != b[at:end]
        first = int(unlike.argmax())
        if unlike[first]:
            return at + first
        at, step = end, step * 4
    return size


def squares(half: np.ndarray) -> list[int]:
    """The q at which the Z-function of ``half`` is q or more, ascending: what begins ``half`` is there twice.

    The Z-function is zero where the first element doesn't recur, so only those places are visited.
    """
    places = np.flatnonzero(half[1 : len(half) // 2 + 1] == half[0]) + 1
    found, z, left, right = [], {}, 0, 0
    for i in places.tolist():
        known = min(z.get(i - left, 0), right - i) if i < right else 0
        if i + known >= right:
            known += common(half[known:], half[i + known :])
            left, right = i, i + known
        z[i] = known
        if known >= i:
            found.append(i)
    return found


def _crossing(ids: np.ndarray, mid: int, out: set[tuple[int, int, int]]) -> None:
    """Adds the runs (start, end, period) of the piece ``ids`` that reach two periods or more to a side of ``mid``."""
    seen: list[tuple[int, int]] = []
    for back, half in ((False, ids[mid:]), (True, ids[:mid][::-1])):
        seen.clear()
        for q in squares(half):
            first, last = (mid - 2 * q, mid) if back else (mid, mid + 2 * q)
            if any(s <= first and last <= e for s, e in seen):
                continue
            start = first - common(ids[:first][::-1], ids[: first + q][::-1])
            end = last + common(ids[last:], ids[last - q :])
            seen.append((start, end))
            if end - start >= max(WORDS, PERIODS * q):
                out.add((start, end, q))


def _pieces(ids: np.ndarray) -> list[tuple[int, int]]:
    """The stretches between words that are too rare in their stretch to be in a run, so long as one can be there."""
    todo, out = [(0, len(ids))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo < WORDS:
            continue
        _, numbers, counts = np.unique(ids[lo:hi], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[numbers] < PERIODS)
        if not len(rare):
            out.append((lo, hi))
            continue
        edges = np.concatenate(([-1], rare, [hi - lo]))
        long = np.flatnonzero(np.diff(edges) > WORDS)
        todo += [(lo + int(edges[k]) + 1, lo + int(edges[k + 1])) for k in long]
    return out


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start, then period."""
    found: list[tuple[int, int, int]] = []
    for first, last in _pieces(ids):
        piece, out, todo = ids[first:last], set(), [(0, last - first)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < WORDS:
                continue
            mid, own = (lo + hi) // 2, set()
            _crossing(piece[lo:hi], mid - lo, own)
            own = {(s + lo, e + lo, q) for s, e, q in own}
            # one that goes on beyond the segment was found at the midpoint that it crosses there
            before = lambda s, q: s == lo and s > 0 and piece[s - 1] == piece[s - 1 + q]  # noqa: B023, E731
            after = lambda e, q: e == hi and e < len(piece) and piece[e] == piece[e - q]  # noqa: B023, E731
            out |= {(s, e, q) for s, e, q in own if not before(s, q) and not after(e, q)}
            if not any(s == lo and e == hi and q < SIMPLE for s, e, q in own):
                todo += [(lo, mid), (mid, hi)]
        found += [(first + s, e - s, q) for s, e, q in out]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(size: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``size`` words stays: those after the first period of a run go."""
    change = np.zeros(size + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (array of start, length, period), collapsed.

    ``collapsed`` has the words that no run repeats, joined by one space. Null and
    empty texts have no words, no runs and an empty ``collapsed``. Rows are worked on
    each by itself, whatever else is repeated; null ids stay; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, texts = [], [], []
            for t in batch.column(1):
                words = (t.as_py() or b"").split()
                own = runs(interned(words)) if len(words) >= WORDS else []
                sizes.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                texts.append(b" ".join(_stay(words, own)).decode())
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(work, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, runs {RUN}, collapsed string")


def _stay(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    if not found:
        return words
    return [words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()]


def cycled(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document as the query's contract has them: those of every tenth id go round from some word on."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def recycled(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, the text being the words that the contract makes of it, joined by one space."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b" ".join(cycled((t.as_py() or b"").split(), i.as_py())).decode() for i, t in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def op13_periodic_runs(spark, sf_dir) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of all of ``documents``; words of null ids stay as they are."""
    found = periodic_runs(recycled(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.concat(F.lit(""), F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""))
    rows = found.select("id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"),
        F.expr("-1000 * b.l div b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
