"""What the corpus operators hold at a time, in the driver and in a worker."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from rxloom.llm import common, suffix_dedup
from rxloom.llm.common import Scratch, components


def _executions(spark) -> int:
    return spark._jsparkSession.sharedState().statusStore().executionsList().size()


def test_few_edges_take_one_step_and_equal_the_rounds(spark, monkeypatch):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(-7, 900), (None, 5)]
    df, before = spark.createDataFrame(links, "a long, b long"), _executions(spark)
    found = components(Scratch(spark, "few"), df)
    assert _executions(spark) - before <= 3  # edges, their count, the components
    monkeypatch.setattr(common, "FEW_EDGES", -1)
    rounds = components(Scratch(spark, "rounds"), df)
    assert sorted(found.collect()) == sorted(rounds.collect())
    assert not components(Scratch(spark, "none"), df.filter("a is null")).collect()


def _peak(work) -> float:
    """MB of Python and numpy at their most."""
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / (1 << 20)


def test_suffix_workers_hold_a_few_records_at_a_time():
    text = random.Random(1).randbytes(2_000_000)
    suffix_dedup._powers(1)
    assert _peak(lambda: suffix_dedup.records([text])) < 25  # 49 with groups of 1 MiB
    rows = [(k // 2, 1, k, 0, 0, text[k // 2 * 500 : k // 2 * 500 + 700]) for k in range(5600)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], list("hnkdis"))
    found = []
    assert _peak(lambda: found.extend(suffix_dedup._sorted_repeats(400)([batch]))) < 70  # 119 with 2 MiB at a time
    assert sorted(r[0] for b in found for r in zip(*(c.to_pylist() for c in b.columns), strict=True)) == list(range(5600))


def test_slices_keep_every_row(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 10)
    texts = [b"", b"a" * 25, b"bc", b"", b"d" * 8, b"e" * 9, b""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["k", "t"])
    parts = list(suffix_dedup._slices([batch, batch.slice(0, 0)], 1))
    assert [t for b in parts for t in b.column(1).to_pylist()] == texts and len(parts) > 2
