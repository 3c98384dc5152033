"""What pixel queries move and where, and images of several tiles against plain arrays."""

from __future__ import annotations

import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from test_pixels import arrays, plain_contrast, strips

from rxloom.operators import rasters
from rxloom.plans import inputs, pictures


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_images_are_dealt_out(spark):
    """a small table of keys makes many pixels, by several tasks; tiles need no group of rows each in Python."""
    assert inputs.rasters(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 8
    assert "FlatMapGroups" not in plan(pictures.adaptive_images(spark, SF))


def test_pixels_equal_their_expression(spark):
    """F1."""
    for keys in (list(range(200)) + [2**40 + 7], [-1, -12, -990, 0, 5]):
        px = f"transform(sequence(0, {inputs.RASTER_WIDTH - 1}), x -> {inputs.PIXEL})"
        rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", F.explode(F.sequence(F.lit(0), F.lit(inputs.RASTER_HEIGHT - 1))).alias("y"))
        want = {(r["k"], r["y"]): r["px"] for r in rows.selectExpr("k", "y", f"{px} AS px").collect()}
        got = inputs.pixels(np.array(keys))
        assert all(got[i, y].tolist() == want[k, y] for i, k in enumerate(keys) for y in range(inputs.RASTER_HEIGHT))


def test_strips_travel_as_bytes(spark):
    """a byte a pixel where that holds them, else four; what a tile gets in parts is put in order."""
    rng = np.random.default_rng(5)
    given = {1: rng.integers(0, 256, (70, 20)), 2: rng.integers(-500, 100_000, (70, 20))}
    rows = {r["image_id"]: r for r in rasters.packed(strips(spark, given).coalesce(1).filter("y < 64"), lambda c: (c["y"] // 64, c["y"] // 64)).collect()}
    assert all(len(r["ys"]) == 64 for r in rows.values()) and len(rows[2]["px"]) == 64 * 20 * 4
    assert len(next(iter(rasters.packed(strips(spark, {1: given[1]}).coalesce(1), lambda c: (c["y"] * 0, c["y"] * 0)).collect()))["px"]) == 70 * 20
    got = arrays(rasters.stencil(strips(spark, given), 1, "edge", lambda b, *_: b[2:, 1:-1] - b[1:-1, :-2]))
    for k, p in given.items():
        b = np.pad(p, 1, mode="edge")
        assert (got[k] == b[2:, 1:-1] - b[1:-1, :-2]).all()


def plain_components(p: np.ndarray) -> np.ndarray:
    """For each pixel over 0 the first place that it hangs together with, by steps."""
    big = p.size
    label = np.where(p > 0, np.arange(big).reshape(p.shape), big)
    while True:
        b = np.pad(label, 1, constant_values=big)
        new = np.min([b[i : i + p.shape[0], j : j + p.shape[1]] for i in range(3) for j in range(3)], axis=0)
        new = np.where(p > 0, new, big)
        if (new == label).all():
            return label
        label = new


def test_components_across_tiles(spark):
    """Tiles connect their own runs, and only what touches the next tile is joined."""
    rng = np.random.default_rng(3)
    comb = np.zeros((200, 41), dtype=int)
    comb[:, ::2] = 1
    comb[199, 7] = 2  # teeth that only the last line joins
    comb[199, :] = np.maximum(comb[199, :], 1)
    snake = np.zeros((150, 30), dtype=int)
    snake[::2] = 1
    snake[1::4, -1] = snake[3::4, 0] = 1
    shapes = {1: (rng.random((190, 60)) < 0.4) * rng.integers(1, 3, (190, 60)), 2: comb, 3: snake, 4: np.zeros((130, 4), dtype=int)}
    found = rasters.labelled_runs(strips(spark, shapes)).collect()
    for k, p in shapes.items():
        label = plain_components(p)
        mine = [r for r in found if r["image_id"] == k]
        assert sum(r["x2"] - r["x1"] + 1 for r in mine) == (p > 0).sum()
        names: dict[int, int] = {}
        for r in mine:
            (first,) = set(label[r["y"], r["x1"] : r["x2"] + 1].tolist())
            assert names.setdefault(first, r["component"]) == r["component"]
            assert r["top"] == p[r["y"], r["x1"] : r["x2"] + 1].max() and r["peak"] == p[label == first].max()
        assert len(set(names.values())) == len(names)


def test_boxes_need_no_rounds_within_tiles(spark):
    """F8: images of one tile start a fixed number of jobs, whatever they hang together like."""
    snake = np.zeros((63, 60), dtype=int)
    snake[::2] = 1
    snake[1::4, -1] = snake[3::4, 0] = 1
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for p in (np.ones((63, 60), dtype=int), snake):
        spark.sparkContext.setJobGroup(f"boxes {p.sum()}", "")
        rasters.labelled_runs(strips(spark, {1: p})).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"boxes {p.sum()}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_contrast_of_several_tiles(spark):
    """fields of 100 lines, whose middles are in other tiles than their edges; curves aren't sent to every strip."""
    p = {1: np.random.default_rng(2).integers(0, 256, (797, 13)), 2: np.random.default_rng(2).integers(60, 90, (9, 130))}
    got = arrays(rasters.equalised(strips(spark, p)))
    assert all((got[k] == plain_contrast(v, 2.0, 8)).all() for k, v in p.items())
    assert "Join" not in plan(rasters.equalised(strips(spark, p)))


def test_operators_share_python_workers(spark):
    """pixels go to Python once for each time that they are dealt out, and lines are summed where they are made."""
    assert plan(pictures.scaled_images(spark, SF)).count("MapInArrow") == 2 + 1  # columns are added once to what is made
    assert plan(rasters.line_sums(rasters.sharpened(rasters.bilateral(inputs.rasters(spark, SF))))).count("MapInArrow") == 3
    assert "aggregate(" not in plan(pictures.image_variants(spark, SF)) and "Union" not in plan(pictures.reduced_images(spark, SF))
