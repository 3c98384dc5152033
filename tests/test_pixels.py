"""The pixel operators against plain arrays, and their queries against SQL."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import SF, same

from rxloom.operators import graphs, images, rasters
from rxloom.plans import pictures
from rxloom.sources.shared import shared_dir


@pytest.mark.parametrize("name", sorted(pictures.QUERIES))
def test_query_equals_sql(spark, name):
    same(pictures.QUERIES[name](spark, SF), pictures.ORACLE[name], SF)


def strips(spark, pictures_: dict[int, np.ndarray]):
    rows = [(k, p.shape[1], p.shape[0], y, line.tolist()) for k, p in pictures_.items() for y, line in enumerate(p)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, rasters.STRIP)


def arrays(df) -> dict[int, np.ndarray]:
    found: dict[int, dict] = {}
    for r in df.collect():
        assert r["y"] not in found.setdefault(r["image_id"], {})
        found[r["image_id"]][r["y"]] = r["px"]
    return {k: np.array([v[y] for y in range(len(v))]) for k, v in found.items()}


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(7)
    return {1: rng.integers(0, 256, (131, 70)), 2: rng.integers(90, 110, (5, 9)), 3: np.full((64, 65), 7), 4: np.add.outer(np.arange(129), np.arange(40)) % 256}


@pytest.mark.parametrize("tile", [3, 64])
def test_tiles_do_not_show(spark, some, tile):
    """Sums of windows over tiles of any height equal those over the whole image."""
    for border in ("edge", "reflect"):
        got = arrays(rasters.stencil(strips(spark, some), 2, border, lambda b, *_: sum(b[i : b.shape[0] - 4 + i, j : b.shape[1] - 4 + j] * (i + 5 * j) for i in range(5) for j in range(5)), tile))
        for k, p in some.items():
            b = np.pad(p, 2, mode=border)
            assert (got[k] == sum(b[i : i + p.shape[0], j : j + p.shape[1]] * (i + 5 * j) for i in range(5) for j in range(5))).all()


def plain_otsu(p: np.ndarray) -> int:
    best, at = 0.0, 0
    for t in range(256):
        low, high = p[p <= t], p[p > t]
        if low.size and high.size:
            between = low.size * high.size * (low.mean() - high.mean()) ** 2
            if between > best * (1 + 1e-12):
                best, at = between, t
    return at


def test_otsu_parts_best(spark, some):
    got = {r["image_id"]: r["threshold"] for r in rasters.otsu(rasters.histograms(strips(spark, some))).collect()}
    assert got == {k: plain_otsu(p) for k, p in some.items()} and got[3] == 0


def plain_contrast(p: np.ndarray, clip: float, grid: int) -> np.ndarray:
    """Tile by tile, in floating point."""
    h, w = p.shape
    th, tw = -(-h // grid), -(-w // grid)
    whole = np.pad(p, ((0, th * grid - h), (0, tw * grid - w)), mode="reflect")
    luts = np.zeros((grid, grid, 256))
    for ty in range(grid):
        for tx in range(grid):
            n = np.bincount(whole[ty * th : ty * th + th, tx * tw : tx * tw + tw].ravel(), minlength=256)
            limit = max(1, int(clip * th * tw / 256))
            cut = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + cut // 256
            rest = cut % 256
            for i in range(0, 256, max(1, 256 // max(rest, 1))):
                if rest:
                    n[i] += 1
                    rest -= 1
            luts[ty, tx] = np.floor(np.cumsum(n) * 255 / (th * tw) + 0.5)
    out = np.zeros_like(p)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            ly, lx = int(np.floor(fy)), int(np.floor(fx))
            a, b = fy - ly, fx - lx
            ys, xs = (max(ly, 0), min(ly + 1, grid - 1)), (max(lx, 0), min(lx + 1, grid - 1))
            v = p[y, x]
            mean = (luts[ys[0], xs[0], v] * (1 - b) + luts[ys[0], xs[1], v] * b) * (1 - a) + (luts[ys[1], xs[0], v] * (1 - b) + luts[ys[1], xs[1], v] * b) * a
            out[y, x] = int(np.floor(mean + 0.5 + 1e-9))
    return out


def test_contrast_of_images_without_whole_tiles(spark, some):
    some = {k: p for k, p in some.items() if k in (1, 3)}
    got = arrays(rasters.equalised(strips(spark, some)))
    for k, p in some.items():
        assert (got[k] == plain_contrast(p, 2.0, 8)).all()


def test_components_of_any_shape(spark):
    rng = np.random.default_rng(3)
    shapes = {1: (rng.random((60, 60)) < 0.45) * 255, 2: np.zeros((4, 4), dtype=int), 3: np.full((3, 200), 255)}
    comb = np.zeros((40, 41), dtype=int)
    comb[:, ::2] = 255  # teeth that only the last line joins
    comb[39, :] = 255
    shapes[4] = comb

    def boxes(p):
        seen, out = set(), []
        for y, x in zip(*np.nonzero(p), strict=True):
            if (y, x) not in seen:
                todo, own = [(y, x)], []
                seen.add((y, x))
                while todo:
                    a, b = todo.pop()
                    own.append((a, b))
                    for c in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                        if 0 <= c[0] < p.shape[0] and 0 <= c[1] < p.shape[1] and p[c] and c not in seen:
                            seen.add(c)
                            todo.append(c)
                ys, xs = zip(*own, strict=True)
                out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
        return sorted(out)

    found = rasters.contour_boxes(rasters.labelled_runs(strips(spark, shapes))).collect()
    for k, p in shapes.items():
        assert sorted((r["x"], r["y"], r["w"], r["h"]) for r in found if r["rx_id"] == k) == [tuple(map(int, b)) for b in boxes(p)]


def test_connected_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 100)] + [(900, 900), (None, 3), (702, 701), (701, 702)]
    got = {r["node"]: r["component"] for r in graphs.connected(spark.createDataFrame(links, "a long, b long"), shared_dir(spark)).collect()}
    assert got == {i: 0 for i in range(201)} | {500 + i: 500 for i in range(100)} | {701: 701, 702: 701}
    assert graphs.connected(spark.createDataFrame([], "a long, b long"), shared_dir(spark)).count() == 0


def test_drawn_lines_give_the_skew(spark):
    """Rules that fall by 4 in 100 pixels turn the page by 2.3 degrees; short strokes don't count."""
    page = np.full((80, 240), 230)
    for y in (20, 45):
        for x in range(20, 220):
            page[y + x * 4 // 100 : y + x * 4 // 100 + 2, x] = 20
    page[5:8, 10:60] = 20
    blank = np.full((80, 240), 230)
    got = {r["rx_id"]: r["skew"] for r in images.skew(rasters.line_angles(strips(spark, {1: page, 2: blank}))).collect()}
    assert set(got) == {1} and abs(got[1] - 2.29) < 0.5  # votes are by whole degrees


def test_other_sizes(spark, some):
    """Close to plain arithmetic in floating point, whatever the tiles; the same size changes nothing."""
    for area, size in ((False, (31, 77)), (True, (23, 10)), (True, (70, 131)), (False, (150, 290))):
        df = strips(spark, {1: some[1]}).selectExpr("*", f"{size[0]} AS to_width", f"{size[1]} AS to_height")
        (p,) = arrays(rasters.resized(df, area, tile=16)).values()
        weights = []
        for n, to in ((some[1].shape[0], size[1]), (some[1].shape[1], size[0])):
            w = np.zeros((to, n))
            for d in range(to):
                for s in range(n) if area else range(-2, n + 2):
                    if area:
                        w[d, s] += max(0.0, min((s + 1) / n, (d + 1) / to) - max(s / n, d / to)) * to
                    else:
                        x = abs((d + 0.5) * n / to - 0.5 - s)
                        c = 1.25 * x**3 - 2.25 * x**2 + 1 if x <= 1 else -0.75 * (x**3 - 5 * x**2 + 8 * x - 4) if x < 2 else 0
                        w[d, min(max(s, 0), n - 1)] += c
            weights.append(w)
        want = np.clip(weights[0] @ some[1] @ weights[1].T, 0, 255)
        assert p.shape == want.shape and np.abs(p - want).max() <= 1.01
    same = strips(spark, some).selectExpr("*", "width AS to_width", "height AS to_height")
    assert all((p == some[k]).all() for k, p in arrays(rasters.resized(same, False)).items())


def test_turning(spark, some):
    skews = spark.createDataFrame([(1, 7.5), (2, -12.0), (3, 3.0), (4, 0.0)], "rx_id long, skew double")
    got = arrays(rasters.rotated(strips(spark, some), skews, tile=10))
    assert (got[4] == some[4]).all() and (got[3] == 7).all()
    for k, angle in ((1, 7.5), (2, -12.0)):
        p, t = some[k], np.radians(angle)
        h, w = p.shape
        y, x = np.mgrid[0:h, 0:w]
        sx = np.floor(((x - w / 2) * np.cos(t) - (y - h / 2) * np.sin(t) + w / 2) * 32 + 0.5) / 32
        sy = np.floor(((x - w / 2) * np.sin(t) + (y - h / 2) * np.cos(t) + h / 2) * 32 + 0.5) / 32
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        at = lambda a, b: p[np.clip(a, 0, h - 1), np.clip(b, 0, w - 1)]  # noqa: B023, E731
        fx, fy = sx - x0, sy - y0
        want = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
        assert (got[k] == np.floor(want + 0.5 + 1e-9)).all()


def test_prepared_pages_are_cut_enlarged_and_level(spark):
    """A slanted rule on a wide margin: what comes out is its surroundings, three times as large, and level."""
    page = np.full((300, 900), 235)
    for x in range(100, 500):
        page[100 + (x - 100) * 8 // 100 : 103 + (x - 100) * 8 // 100, x] = 15
    (p,) = arrays(rasters.prepared(strips(spark, {1: page}))).values()
    assert p.shape[1] < 3 * 600 and p.shape[0] < 3 * 200
    dark = [np.flatnonzero(p[:, x] < 120) for x in range(250, p.shape[1] - 250, 50)]
    middles = [d.mean() for d in dark]
    assert all(len(d) for d in dark) and max(middles) - min(middles) < 15  # 65 before
