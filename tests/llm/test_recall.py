"""Recall of the operators that search: planted cases, and searches that fail."""

from __future__ import annotations

import numpy as np
import pytest

from rxloom.llm import decontamination, embedding_dedup


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def planted():
    """Vectors with isolated pairs, two-lobed groups whose lobes outnumber a list, a chain, a clique that outnumbers the longest list, and copies."""
    rng, dim = np.random.default_rng(5), 48
    pairs = unit(rng.normal(size=(200, dim)))
    parts = [unit(rng.normal(size=(3000, dim))), pairs, unit(pairs + 0.06 * rng.normal(size=pairs.shape))]
    for _ in range(12):
        a, b = unit(rng.normal(size=(2, dim)))
        b = unit(b - (a @ b) * a)
        for c in (a, 0.915 * a + (1 - 0.915**2) ** 0.5 * b):
            parts.append(unit(c + 0.012 * rng.normal(size=(45, dim))))
    chain = [unit(rng.normal(size=dim))]
    for _ in range(80):
        w = rng.normal(size=dim)
        chain.append(np.cos(0.35) * chain[-1] + np.sin(0.35) * unit(w - (w @ chain[-1]) * chain[-1]))
    hot = unit(rng.normal(size=(1, dim)))
    parts += [np.array(chain), unit(unit(rng.normal(size=dim)) + 0.02 * rng.normal(size=(1100, dim))), np.repeat(hot, 500, axis=0), unit(hot + 0.03 * rng.normal(size=(20, dim)))]
    x = np.vstack(parts)
    x = x[rng.permutation(len(x))]
    near = (x @ x.T >= embedding_dedup.COSINE) & ~np.eye(len(x), dtype=bool)
    least = np.full(len(x), -1)
    for i in range(len(x)):
        if least[i] < 0:
            seen = np.arange(len(x)) == i
            front = seen
            while front.any():
                front = near[front].any(axis=0) & ~seen
                seen = seen | front
            least[seen] = i
    return x, near, least


def found_in(spark, planted):
    x = planted[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(rows).collect()}
    assert len(found) == len(x)
    return found


def test_planted_pairs_and_clusters(spark, planted, caplog):
    """Links of all that the lists hold and of dense vectors, and components; the audit says how many links were known."""
    x, near, least = planted
    with caplog.at_level("INFO", logger="rxloom"):
        found = found_in(spark, planted)
    there = [m for m in caplog.messages if "audited links" in m]
    assert there and int(there[-1].split()[4]) > 100
    n = near.sum(1)
    assert sum(found[i][0] for i in found) >= 0.999 * n.sum() and all(found[i][0] <= n[i] for i in found)
    wrong = [i for i in found if found[i] != (n[i], least[i], least[i] == i)]
    print(f"{len(wrong)} of {len(x)} vectors differ; {n.sum()} links")
    assert len(wrong) <= 0.001 * len(x)


def test_a_descent_that_finds_nothing_loses_nothing(spark, planted, monkeypatch):
    """The audit sees it, and everything is compared."""
    x, near, least = planted

    def nothing(scratch, vectors, dim, k, graph, label, seed):
        none = vectors.select("c").limit(0)
        return none.selectExpr("c u", "c v", "cast(c as float) sim"), none.selectExpr("c u", "c v"), none

    monkeypatch.setattr(embedding_dedup, "neighbours", nothing)
    found = found_in(spark, planted)
    assert found == {i: (n, c, c == i) for i, (n, c) in enumerate(zip(near.sum(1).tolist(), least.tolist(), strict=True))}


@pytest.mark.parametrize("replaced", [0.3, 0.4])
def test_candidates_of_paraphrases(spark, replaced):
    """Of passages with words replaced that alignment accepts, nine in ten at least are found at every length."""
    rows = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").filter("text is not null").collect()
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null").orderBy("doc_id").select("text").collect()]
    pieces, rng, pool = decontamination.Pieces(), np.random.default_rng(1), [w for t in texts[:200] for w in decontamination.words(t.encode())]
    for r in rows:
        pieces.add(r["item_id"], r["text"])
    size = len(pieces.vocab)
    streams = [decontamination.encoded(t.encode(), pieces.vocab) for t in texts]
    counts = sum(np.bincount(a, minlength=size + 1) for a in streams)
    pieces.idf = decontamination.inverse_frequency(counts[:size], int(counts.sum()))
    draw, y = np.random.default_rng(11).normal(size=(size, min(decontamination.RANK, size))), np.zeros((size, min(decontamination.RANK, size)))
    weighted = np.vstack([draw * pieces.idf[:, None], np.zeros((1, draw.shape[1]))]).astype(np.float32)
    for a in decontamination.in_steps(iter(streams), size):
        decontamination.sketch_step(a, weighted, pieces.idf, y)
    decontamination.prepare(pieces, decontamination.nystroem(y, draw))
    search, seen = decontamination.Search(pieces), {}
    for p, ids in enumerate(pieces.ids * 4):
        p %= len(pieces.ids)
        own, host = list(ids), [pieces.vocab.get(w, size) for w in rng.choice(pool, 200)]
        for at in rng.choice(len(own), round(replaced * len(own)), replace=False):
            own[at] = pieces.vocab.get(pool[rng.integers(len(pool))], size)
        at, n, pad = int(rng.integers(200)), pieces.answers[p], pieces.scale(p) // 2
        a = np.array(host[:at] + own + host[at:], dtype=np.int64)
        accepted = lambda s: decontamination.common(search.masks[p], len(ids), s) >= decontamination.SHARE * len(ids) and decontamination.common(search.tails[p], n, s) >= decontamination.ANSWER * n  # noqa: B023, E731
        if any(accepted(a[max(0, s - pad) : s + pieces.scale(p) + pad].tolist()) for s in range(0, len(a), decontamination.BLOCK)):
            seen.setdefault(pieces.scale(p), []).append(pieces.items[p] in search.matches(a))
    print({k: f"{sum(v)} of {len(v)}" for k, v in sorted(seen.items())})
    assert set(seen) == set(decontamination.SCALES)
    assert all(sum(v) >= 0.9 * len(v) for v in seen.values())
