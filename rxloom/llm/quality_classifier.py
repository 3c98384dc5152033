"""Document quality by a byte-level convolutional network in numpy.

The network reads the whole UTF-8 text. Filters of ``WIDTH`` bytes slide over every
position; the text is cut into chunks of ``CHUNK`` positions that overlap by half;
each filter is max-pooled within each chunk; the mean and the maximum of the pooled
values over all chunks are combined into one probability by a logistic layer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.llm.common import Scratch

WIDTH, FILTERS, CHUNK, HALF = 6, 16, 256, 128
#: The fit takes at most this many labelled documents of each class, and no more than so many bytes of them; it reads their whole texts.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1500, 32 << 20
#: Half chunks that are looked at together in a step of the fit.
TOGETHER = 4096
STEPS, BATCH, RATE, DECAY = 650, 64, 0.02, 1e-4
#: The fit also ends when the mean loss of a pass over the sample is below this.
ENOUGH = 0.005
THRESHOLD = 0.3
_PIECE = 64 * 1024


@dataclass
class Network:
    """filters: (WIDTH, 256, FILTERS); bias: (FILTERS,); out: (2 * FILTERS,); offset: the logit's constant."""

    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float

    def tables(self) -> list[np.ndarray]:
        """What each pair of adjacent bytes adds to the filters at its place in the window."""
        w = self.filters.astype(np.float32)
        return [(w[k][:, None, :] + w[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]


def pooled(text: bytes, net: Network, tables: list[np.ndarray]) -> np.ndarray:
    """(chunks, FILTERS): the largest value of each filter in each chunk. Texts are padded with zero bytes to one window."""
    data = np.frombuffer(text + b"\0" * max(WIDTH - len(text), 0), dtype=np.uint8)
    n = len(data) - WIDTH + 1
    halves = np.full((-(-n // HALF), FILTERS), -np.inf, dtype=np.float32)
    for at in range(0, n, _PIECE):
        part = data[at : at + _PIECE + WIDTH - 1].astype(np.int32)
        pairs, m = part[:-1] * 256 + part[1:], len(part) - WIDTH + 1
        act = tables[0][pairs[:m]]
        for k, t in enumerate(tables[1:], 1):
            act += t[pairs[2 * k : 2 * k + m]]
        halves[at // HALF : at // HALF - (-m // HALF)] = np.maximum.reduceat(act, np.arange(0, m, HALF), axis=0)
    full = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
    return full + net.bias.astype(np.float32)


def squash(x: np.ndarray) -> np.ndarray:
    return np.tanh(np.maximum(x, 0))


def score(text: bytes | None, net: Network, tables: list[np.ndarray]) -> float:
    h = squash(pooled(text or b"", net, tables).astype(np.float64))
    z = np.concatenate([h.mean(axis=0), h.max(axis=0)]) @ net.out + net.offset
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def half_chunks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, positions): rows of HALF positions of a whole text with the bytes that their windows reach, and how many of them are positions of the text."""
    n = max(len(text) - WIDTH + 1, 1)
    count = -(-n // HALF)
    data = np.frombuffer(text.ljust(count * HALF + WIDTH - 1, b"\0"), dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, HALF + WIDTH - 1)[::HALF][:count], np.minimum(n - HALF * np.arange(count), HALF)


def maxima(data: np.ndarray, valid: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(value, place) of the largest response of each filter in each half chunk, without bias."""
    tops, places = [], []
    for at in range(0, len(data), TOGETHER):
        x = data[at : at + TOGETHER].astype(np.intp)
        pairs = x[:, :-1] * 256 + x[:, 1:]
        act = np.take(tables[0], pairs[:, :HALF], axis=0, mode="clip")
        for k, t in enumerate(tables[1:], 1):
            act += np.take(t, pairs[:, 2 * k : 2 * k + HALF], axis=0, mode="clip")
        act[np.arange(HALF)[None, :] >= valid[at : at + TOGETHER, None]] = -1e9
        places.append(act.argmax(axis=1))
        tops.append(np.take_along_axis(act, places[-1][:, None, :], axis=1)[:, 0, :])
    return np.concatenate(tops).astype(np.float64), np.concatenate(places)


def loss_and_gradient(net: Network, data: np.ndarray, valid: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted logistic loss of documents of ``sizes`` half chunks, and its gradient by filters, bias, out and offset."""
    top, place = maxima(data, valid, net.tables())
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # chunks are pairs of neighbouring halves of a document, or its only half
    chunks = np.maximum(sizes - 1, 1)
    owner, starts = np.repeat(np.arange(len(sizes)), chunks), np.concatenate(([0], np.cumsum(chunks)[:-1]))
    left = np.arange(len(owner)) - starts[owner] + first[owner]
    right = np.where(sizes[owner] > 1, left + 1, left)
    take = np.where(top[left] >= top[right], left[:, None], right[:, None])
    value = np.maximum(top[left], top[right]) + net.bias
    h = squash(value)
    mean, best = np.add.reduceat(h, starts, axis=0) / chunks[:, None], np.maximum.reduceat(h, starts, axis=0)
    feats = np.hstack([mean, best])
    z = feats @ net.out + net.offset
    loss = float((weight * (np.logaddexp(0, z) - labels * z)).mean())
    dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * weight / len(sizes)
    most = h == best[owner]
    share = most / np.add.reduceat(most.astype(float), starts, axis=0)[owner]
    dh = dz[owner][:, None] * (net.out[None, :FILTERS] / chunks[owner][:, None] + net.out[None, FILTERS:] * share)
    dvalue = dh * (1 - h * h) * (value > 0)
    f = np.arange(FILTERS)[None, :]
    dtop = np.bincount((take * FILTERS + f).ravel(), weights=dvalue.ravel(), minlength=top.size).reshape(top.shape)
    grad = np.zeros(WIDTH * 256 * FILTERS)
    for k in range(WIDTH):
        byte = np.take_along_axis(data, place + k, axis=1).astype(np.int64)
        grad += np.bincount(((k * 256 + byte) * FILTERS + f).ravel(), weights=dtop.ravel(), minlength=grad.size)
    return loss, [grad.reshape(WIDTH, 256, FILTERS), dvalue.sum(axis=0), feats.T @ dz, np.array(dz.sum())]


def fit(texts: list[bytes], labels: np.ndarray, prior: float, seed: int = 7) -> Network:
    """Adam on the logistic loss of class-balanced rows, over whole texts; ``prior`` is the share of label 1 that scores assume."""
    rng = np.random.default_rng(seed)
    halves = [half_chunks(t) for t in texts]
    sizes = np.array([len(v) for _, v in halves])
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    p = [rng.normal(0, 0.1, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(())]
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    mean = np.inf
    while step < STEPS and mean > ENOUGH:
        order, losses = rng.permutation(len(texts)), []
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            data, valid = (np.concatenate([halves[d][k] for d in docs]) for k in (0, 1))
            loss, grad = loss_and_gradient(Network(p[0], p[1], p[2], float(p[3])), data, valid, sizes[docs], labels[docs], weight[docs])
            losses.append(loss)
            step += 1
            for i, g in enumerate(grad):
                g = g + DECAY * p[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        mean = np.mean(losses)
    return Network(p[0], p[1], p[2], float(p[3] + np.log(prior / (1 - prior))))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that the fit never sees: crc32 of the id as text is a multiple of five. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> Network | None:
    """Fits on a bounded sample of the labelled rows; None if there are none.

    Of each class the ``per_class`` rows with the smallest hash of doc_id take
    part, or so many of them, in that order, as have half of ``most_bytes``
    together, one at least; their ids (a bounded set) are broadcast to the
    documents. Repeated and contradicting labels of an id count as the smaller
    one, repeated documents of an id as the one of the smallest text.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return None
    picked = [known.filter(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t")).join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    rows = Scratch(spark, "labelled").save(rows.groupBy("doc_id", "y").agg(F.min("t").alias("t")), "rows")
    chosen, held = [], {0: 0, 1: 0}
    for r in rows.select("doc_id", "y", F.length("t").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        first = held[r["y"]] == 0
        held[r["y"]] += max(r["n"], 1)
        if first or held[r["y"]] <= most_bytes // 2:
            chosen.append(r["doc_id"])
    if not chosen:
        return None
    found = rows.filter(F.col("doc_id").isin(chosen)).select("doc_id", "y", "t").collect()
    found.sort(key=lambda r: r["doc_id"])
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    return fit([bytes(r["t"]) for r in found], np.array([r["y"] for r in found], dtype=float), prior)


def quality_scores(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score. Without a network every score is 0.5; null texts score as empty ones."""
    if net is None:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.5).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.value.tables()
        for b in batches:
            found = [score(t.as_py(), model.value, tables) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, score double")


def op6_quality_classifier(spark, sf_dir) -> DataFrame:
    """doc_id, held_out, score, predicted of all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = quality_scores(docs, net).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier does not reject, with all their columns."""
    net = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if net is None:
        return docs
    model, names = spark.sparkContext.broadcast(net), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.value.tables()
        for b in batches:
            texts = b.column(names.index("text"))
            keep = [score((t.as_py() or "").encode("utf-8", "replace"), model.value, tables) >= THRESHOLD for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
