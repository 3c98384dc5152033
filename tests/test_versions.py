"""Upserts that are written: versions, failures, writers that meet, and what is cleared away."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rxloom.sources.shared import shared_dir
from rxloom.sources.versions import Conflict, VersionedTable


def rows(spark, *values):
    return spark.createDataFrame(values, "key string, v int, at int")


def content(df):
    return sorted((r["key"], r["v"]) for r in df.collect())


@pytest.fixture
def table(spark):
    return VersionedTable(spark, shared_dir(spark), "key", buckets=4)


def test_versions_stay_as_they_were(spark, table):
    assert table.version() == 0
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.upsert(rows(spark, ("a", 1, 1), ("b", 2, 1), (None, 9, 1)), ["at"]) == 1
    first = table.read()
    assert table.upsert(rows(spark, ("b", 3, 1), ("c", 4, 1), ("c", 5, 2)), ["at"]) == 2
    assert content(first) == content(table.read(1)) == [("a", 1), ("b", 2)]
    assert content(table.read()) == [("a", 1), ("b", 3), ("c", 5)]


def test_same_again_changes_nothing(spark, table):
    new = rows(spark, ("a", 1, 1), ("b", None, 1))
    assert [table.upsert(new, ["at"]) for _ in range(3)] == [1, 1, 1]
    assert table.upsert(rows(spark, ("b", 0, 1)), ["at"]) == 2 and table.upsert(new, ["at"]) == 3
    assert table.upsert(new.limit(0), ["at"]) == 3


def test_only_touched_buckets_are_written(spark, table):
    table.upsert(rows(spark, *[(f"k{i}", i, 1) for i in range(100)]), ["at"])
    table.upsert(rows(spark, ("k5", -1, 1)), ["at"])
    one, two = table._commit(1)["buckets"], table._commit(2)["buckets"]
    assert len(one) == 4 and sum(one[k] != two[k] for k in one) == 1
    assert content(table.read()) == sorted((f"k{i}", -1 if i == 5 else i) for i in range(100))


def test_failed_write_leaves_the_old_version(spark, table):
    table.upsert(rows(spark, ("a", 1, 1)), ["at"])
    bad = rows(spark, ("a", 2, 1)).withColumn("v", F.when(F.rand() >= 0, F.raise_error(F.lit("broken"))).cast("int"))
    with pytest.raises(Exception, match="broken"):
        table.upsert(bad, ["at"])

    def stop():
        raise RuntimeError("stopped before the commit")

    with pytest.raises(RuntimeError, match="stopped"):
        table.upsert(rows(spark, ("a", 2, 1)), ["at"], stop)
    assert table.version() == 1 and content(table.read()) == [("a", 1)] and len(table._names("data")) == 1
    assert table.upsert(rows(spark, ("a", 2, 1)), ["at"]) == 2 and content(table.read()) == [("a", 2)]


def test_two_writers(spark, table):
    """One that comes second starts again from what the first one wrote; neither is lost."""
    table.upsert(rows(spark, ("a", 1, 1)), ["at"])
    other = VersionedTable(spark, table.path, "key")
    turns = []

    def meanwhile():
        if not turns:
            turns.append(other.upsert(rows(spark, ("a", 5, 1), ("b", 7, 1)), ["at"]))

    assert table.upsert(rows(spark, ("b", 8, 1), ("c", 9, 1)), ["at"], meanwhile) == 3 and turns == [2]
    assert content(table.read()) == [("a", 5), ("b", 8), ("c", 9)]
    always = lambda: other.upsert(rows(spark, ("z", len(turns), len(turns.append(0) or turns))), ["at"])
    with pytest.raises(Conflict):
        table.upsert(rows(spark, ("q", 1, 1)), ["at"], always)
    assert "q" not in dict(content(table.read()))


def test_vacuum_keeps_what_commits_need(spark, table):
    for k in range(4):
        table.upsert(rows(spark, ("a", k, 1), ("b", k, 1)), ["at"])
    want = content(table.read()), content(table.read(3))
    assert table.vacuum(2) == 0 and content(table.read(1)) == [("a", 0), ("b", 0)]  # all are younger than a day
    assert table.vacuum(2, older_ms=0) == 2
    assert (content(table.read()), content(table.read(3))) == want and table.version() == 4


def test_columns_that_would_clash(spark, table):
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([("a", 1)], "key string, bucket_ int"), ["key"])
