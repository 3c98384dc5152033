"""Queries of the pixel operators over images derived from ``supplier``, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxloom.operators import images, rasters
from rxloom.plans import inputs

W, H = inputs.RASTER_WIDTH, inputs.RASTER_HEIGHT


def _lines(strips: DataFrame) -> DataFrame:
    """A row per line, its values joined by blanks."""
    return strips.select("image_id", "y", F.array_join("px", " ").alias("px"))


def otsu_thresholds(spark, sf_dir) -> DataFrame:
    """I9."""
    return rasters.otsu(rasters.histograms(inputs.rasters(spark, sf_dir)))


def otsu_images(spark, sf_dir) -> DataFrame:
    """The third variant."""
    return _lines(rasters.otsu_binarised(inputs.rasters(spark, sf_dir)))


def adaptive_images(spark, sf_dir) -> DataFrame:
    """The adaptive threshold."""
    return _lines(rasters.adaptive(inputs.rasters(spark, sf_dir)))


def contrast_images(spark, sf_dir) -> DataFrame:
    """Contrast by tiles."""
    return _lines(rasters.equalised(inputs.rasters(spark, sf_dir)))


def smoothed_images(spark, sf_dir) -> DataFrame:
    """I8: the bilateral filter, sharpened."""
    return _lines(rasters.sharpened(rasters.bilateral(inputs.rasters(spark, sf_dir))))


def image_sharpness(spark, sf_dir) -> DataFrame:
    """I12 of binarised images."""
    found = rasters.sharpness(rasters.otsu_binarised(inputs.rasters(spark, sf_dir)))
    return found.select("image_id", F.round("variance", 6).alias("variance"), F.round(images.quality(F.col("variance")), 9).alias("quality"))


def text_boxes(spark, sf_dir) -> DataFrame:
    """Boxes of dark regions."""
    return rasters.text_boxes(inputs.rasters(spark, sf_dir)).select("rx_id", "x", "y", "w", "h")


def cropped_images(spark, sf_dir) -> DataFrame:
    """Images cut to the region of their text."""
    strips = inputs.rasters(spark, sf_dir)
    found = rasters.cropped(strips, images.text_region(rasters.text_boxes(strips)))
    return rasters.line_sums(found).groupBy("image_id", "width", "height").agg(F.count(F.lit(1)).alias("lines"), F.sum("total").alias("total"))


def image_edges(spark, sf_dir) -> DataFrame:
    """Edges by gradient and hysteresis."""
    return rasters.edges(inputs.rasters(spark, sf_dir))


def line_angles(spark, sf_dir) -> DataFrame:
    """Angles of long lines by votes."""
    return rasters.line_angles(inputs.rasters(spark, sf_dir)).select("rx_id", F.round("angle", 9).alias("angle"))


def scaled_images(spark, sf_dir) -> DataFrame:
    """I4: small images enlarged. Two sums of each line."""
    return rasters.line_sums(rasters.upscaled(inputs.rasters(spark, sf_dir)))


def reduced_images(spark, sf_dir) -> DataFrame:
    """Images reduced by area to a quarter and a third of their sides."""
    strips = inputs.rasters(spark, sf_dir).withColumns({"to_width": F.lit(W // 4), "to_height": F.lit(H // 3)})
    return rasters.line_sums(rasters.resized(strips, area=True))


def image_variants(spark, sf_dir) -> DataFrame:
    """The four variants of each image. Two sums of each line."""
    return rasters.variants(inputs.rasters(spark, sf_dir), rasters.line_sums).drop("width", "height")


def image_skews(spark, sf_dir) -> DataFrame:
    """The skew of each image that has long lines."""
    return images.skew(rasters.line_angles(inputs.rasters(spark, sf_dir))).select("rx_id", F.round("skew", 9).alias("skew"))


QUERIES = {f.__name__: f for f in (otsu_thresholds, otsu_images, adaptive_images, contrast_images, smoothed_images, image_sharpness, text_boxes, cropped_images, image_edges, line_angles, image_skews, scaled_images, reduced_images, image_variants)}

# SQL, pixel by pixel


def _shown(source: str) -> str:
    return f"SELECT image_id, y, string_agg(v, ' ' ORDER BY x) AS px FROM {source} GROUP BY image_id, y"


def _gauss(source: str, out: str, size: int, sigma: float = 0.0, mirrored: bool = False) -> str:
    """``out``: the Gaussian mean of each window of ``source`` as v; beyond the image its edges are repeated, or it is mirrored."""
    w, r = rasters.kernel(size, sigma), size // 2
    place = lambda i, n: f"abs({n} - 1 - abs({n} - 1 - ({i})))" if mirrored else f"greatest(least({i}, {n} - 1), 0)"
    along = lambda n: f"list_transform(range({n}), lambda i: list_sum(list_transform(range({size}), lambda j: {w}[j + 1] * l[{place(f'i + j - {r}', n)} + 1])))"
    both = 2 * sum(w) ** 2
    return f"""{out}a AS (SELECT image_id, y, unnest(range({W})) AS x, unnest({along(W)}) AS v FROM (SELECT image_id, y, list(v::BIGINT ORDER BY x) AS l FROM {source} GROUP BY image_id, y)),
{out} AS MATERIALIZED (SELECT image_id, x, y, (2 * s + {both // 2}) // {both} AS v FROM (SELECT image_id, x, unnest(range({H})) AS y, unnest({along(H)}) AS s FROM (SELECT image_id, x, list(v::BIGINT ORDER BY y) AS l FROM {out}a GROUP BY image_id, x)))"""


def _around(source: str, out: str, outside: str | None = None) -> str:
    """``out``: v and its neighbours, nw n ne w e sw s se; beyond the image mirrored, repeated ("edge"), or 0."""
    row = "OVER (PARTITION BY image_id, y ORDER BY x)"
    col = "OVER (PARTITION BY image_id, x ORDER BY y)"
    side = lambda c, f, g, win: f"coalesce({f}({c}) {win}, {'0' if outside == 'zero' else c if outside == 'edge' else f'{g}({c}) {win}'})"
    ends = lambda f, g, names: ", ".join(f"{side(c, f, g, col)} AS {n}" for c, n in zip(("w", "v", "e"), names, strict=True))
    return f"""{out}a AS (SELECT *, {side("v", "lag", "lead", row)} AS w, {side("v", "lead", "lag", row)} AS e FROM {source}),
{out} AS MATERIALIZED (SELECT *, {ends("lag", "lead", ("nw", "n", "ne"))}, {ends("lead", "lag", ("sw", "s", "se"))} FROM {out}a)"""


def _components(source: str, out: str) -> str:
    """``out``: the runs of pixels with v > 0 of each line with component, the number of the first run that they hang together with."""
    return f"""{out}i AS (SELECT image_id, y, x, v, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM {source} WHERE v > 0),
{out}r AS MATERIALIZED (SELECT image_id, y, min(x) AS x1, max(x) AS x2, max(v) AS top, row_number() OVER (ORDER BY image_id, y, min(x)) AS id FROM {out}i GROUP BY image_id, y, g),
{out}n AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM {out}r a JOIN {out}r b ON a.image_id = b.image_id AND b.y = a.y + 1 AND a.x1 <= b.x2 + 1 AND b.x1 <= a.x2 + 1),
{out}l AS MATERIALIZED (SELECT a, b FROM {out}n UNION SELECT b, a FROM {out}n),
{out}w(id, component) AS (SELECT id, id FROM {out}r UNION SELECT l.b, w.component FROM {out}w w JOIN {out}l l ON l.a = w.id WHERE w.component < l.b),
{out} AS MATERIALIZED (SELECT r.*, c.component FROM {out}r r JOIN (SELECT id, min(component) AS component FROM {out}w GROUP BY id) c USING (id))"""


def _otsu(source: str = "pixels", out: str = "parted") -> str:
    """``out``: ``source`` binarised; ``out`` and t: the thresholds."""
    return f"""{out}h AS (SELECT image_id, v, count(*) AS n FROM {source} GROUP BY image_id, v),
{out}c AS (SELECT *, sum(n) OVER u AS c, sum(v * n) OVER u AS s, sum(n) OVER (PARTITION BY image_id) AS t, sum(v * n) OVER (PARTITION BY image_id) AS m FROM {out}h WINDOW u AS (PARTITION BY image_id ORDER BY v)),
{out}b AS (SELECT image_id, v, CASE WHEN c < t THEN d * d / (c::double * (t - c)::double) END AS between FROM (SELECT *, s::double * t::double - m::double * c::double AS d FROM {out}c)),
{out}t AS MATERIALIZED (SELECT image_id, CAST(coalesce(min_by(v, {{'b': -between, 'v': v}}) FILTER (between > 0), 0) AS INTEGER) AS threshold FROM {out}b GROUP BY image_id),
{out} AS MATERIALIZED (SELECT image_id, x, y, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM {source} JOIN {out}t USING (image_id))"""


def _bilateral(diameter: int = 9) -> str:
    r = diameter // 2
    place, value = rasters.nearness(75.0, r * r + 1, True), rasters.nearness(75.0, 256, False)
    steps = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= r * r]
    mirror = lambda at, n: f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} >= {n} THEN {2 * n - 2} - ({at}) ELSE {at} END"
    return f"""steps(dx, dy, p) AS MATERIALIZED (VALUES {", ".join(f"({dx}, {dy}, {place[dx * dx + dy * dy]})" for dx, dy in steps)}),
likeness AS MATERIALIZED (SELECT unnest(range(256)) AS d, unnest({value}) AS q),
spread AS (SELECT image_id, x, y, v, p, {mirror("x + dx", W)} AS ox, {mirror("y + dy", H)} AS oy FROM pixels, steps),
weighed AS (SELECT s.image_id, s.x, s.y, o.v AS o, p * q AS w FROM spread s JOIN pixels o ON o.image_id = s.image_id AND o.x = ox AND o.y = oy JOIN likeness ON d = abs(o.v - s.v)),
smooth AS MATERIALIZED (SELECT image_id, x, y, CAST((2 * sum(w * o) + sum(w)) // (2 * sum(w)) AS BIGINT) AS v FROM weighed GROUP BY image_id, x, y)"""


def _contrast(clip: float = 2.0, grid: int = 8) -> str:
    tw, th = W // grid, H // grid
    area = tw * th
    limit = max(1, int(clip * area / 256))
    mix = lambda t, d: f"(a{t}.lut[v + 1] * ({2 * tw} - rx) + b{t}.lut[v + 1] * rx) * {d}"
    lut = lambda name, tx, ty: f"JOIN curve {name} ON {name}.image_id = p.image_id AND {name}.tx = {tx} AND {name}.ty = {ty}"
    return f"""th AS (SELECT image_id, x // {tw} AS tx, y // {th} AS ty, v, count(*) AS n FROM pixels GROUP BY ALL),
cut AS (SELECT image_id, tx, ty, sum(greatest(n - {limit}, 0)) AS cut FROM th GROUP BY ALL),
grown AS (SELECT c.image_id, c.tx, c.ty, i, least(coalesce(n, 0), {limit}) + cut // 256 + CASE WHEN i % step = 0 AND i // step < cut % 256 THEN 1 ELSE 0 END AS n
  FROM (SELECT *, greatest(1, 256 // greatest(cut % 256, 1)) AS step, unnest(range(256)) AS i FROM cut) c LEFT JOIN th ON th.image_id = c.image_id AND th.tx = c.tx AND th.ty = c.ty AND th.v = c.i),
curve AS MATERIALIZED (SELECT image_id, tx, ty, list((510 * s + {area}) // {2 * area} ORDER BY i) AS lut FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY image_id, tx, ty ORDER BY i) AS BIGINT) AS s FROM grown) GROUP BY image_id, tx, ty),
placed AS (SELECT *, (2 * x + {tw}) // {2 * tw} - 1 AS lx, (2 * y + {th}) // {2 * th} - 1 AS ly, (2 * x + {tw}) % {2 * tw} AS rx, (2 * y + {th}) % {2 * th} AS ry FROM pixels),
contrast AS (SELECT p.image_id, x, y, (2 * ({mix(1, f"({2 * th} - ry)")} + {mix(2, "ry")}) + {4 * area}) // {8 * area} AS v FROM placed p
  {lut("a1", "greatest(lx, 0)", "greatest(ly, 0)")} {lut("b1", f"least(lx + 1, {grid - 1})", "greatest(ly, 0)")} {lut("a2", "greatest(lx, 0)", f"least(ly + 1, {grid - 1})")} {lut("b2", f"least(lx + 1, {grid - 1})", f"least(ly + 1, {grid - 1})")})"""


def _wide(source: str, out: str, rx: int, ry: int) -> str:
    return f"""{out}a AS (SELECT image_id, x, y, max(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {rx} PRECEDING AND {rx} FOLLOWING) AS v FROM {source}),
{out} AS MATERIALIZED (SELECT image_id, x, y, max(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {ry} PRECEDING AND {ry} FOLLOWING) AS v FROM {out}a)"""


_BOXES = f"""{inputs.RASTERS_SQL}, {_gauss("pixels", "mean", 41)},
dark AS (SELECT p.image_id, p.x, p.y, CASE WHEN p.v - m.v <= -15 THEN 255 ELSE 0 END AS v FROM pixels p JOIN mean m USING (image_id, x, y)), {_wide("dark", "wide", 8, 2)}, {_components("wide", "comp")},
boxes AS MATERIALIZED (SELECT image_id AS rx_id, min(x1) AS x, min(y) AS y, max(x2) - min(x1) + 1 AS w, max(y) - min(y) + 1 AS h FROM comp GROUP BY image_id, component)"""

_EDGES = f"""{inputs.RASTERS_SQL}, {_around("pixels", "near", "edge")},
grad AS (SELECT image_id, x, y, (ne + 2 * e + se) - (nw + 2 * w + sw) AS gx, (sw + 2 * s + se) - (nw + 2 * n + ne) AS gy FROM near),
size AS (SELECT image_id, x, y, gx, gy, abs(gx) + abs(gy) AS v FROM grad), {_around("size", "g", "zero")},
cand AS MATERIALIZED (SELECT image_id, x, y, CASE WHEN v > 50 AND CASE WHEN (abs(gy)::BIGINT << 15) < abs(gx)::BIGINT * 13573 THEN v > w AND v >= e
  WHEN (abs(gy)::BIGINT << 15) > abs(gx)::BIGINT * 13573 + (abs(gx)::BIGINT << 16) THEN v > n AND v >= s
  WHEN (gx < 0) <> (gy < 0) THEN v > ne AND v > sw ELSE v > nw AND v > se END THEN CASE WHEN v > 150 THEN 2 ELSE 1 END ELSE 0 END AS v FROM g), {_components("cand", "comp")},
edges AS MATERIALIZED (SELECT image_id, CAST(unnest(range(x1, x2 + 1)) AS INTEGER) AS x, y FROM comp WHERE component IN (SELECT component FROM comp WHERE top = 2))"""


def _turns(widest: int = 15) -> str:
    return ", ".join(f"({t}, {math.cos(math.radians(t + 90))!r}::double, {math.sin(math.radians(t + 90))!r}::double)" for t in range(-widest + 1, widest))


_ANGLES = f"""{_EDGES}, turns(theta, c, s) AS (VALUES {_turns()}),
votes AS MATERIALIZED (SELECT image_id, x, y, theta, CAST(floor(x * c + y * s + 0.5::double) AS BIGINT) AS rho FROM edges, turns),
cells AS MATERIALIZED (SELECT image_id, theta, rho, count(*) AS n FROM votes GROUP BY ALL HAVING count(*) >= 80),
tops AS (SELECT * FROM cells c WHERE NOT EXISTS (SELECT 1 FROM cells o WHERE o.image_id = c.image_id AND abs(o.theta - c.theta) <= 1 AND abs(o.rho - c.rho) <= 1 AND (o.n > c.n OR o.n = c.n AND (o.theta < c.theta OR o.theta = c.theta AND o.rho < c.rho)))),
held AS (SELECT v.image_id, v.theta, t.rho, x, y, CASE WHEN x - lag(x) OVER l > 10 THEN 1 ELSE 0 END AS b FROM votes v JOIN tops t ON v.image_id = t.image_id AND v.theta = t.theta AND v.rho BETWEEN t.rho - 1 AND t.rho + 1 WINDOW l AS (PARTITION BY v.image_id, v.theta, t.rho ORDER BY x, y)),
parts AS (SELECT *, sum(b) OVER (PARTITION BY image_id, theta, rho ORDER BY x, y) AS part FROM held),
ends AS (SELECT min({{'x': x, 'y': y}}) AS a, max({{'x': x, 'y': y}}) AS z, image_id FROM parts GROUP BY image_id, theta, rho, part),
angles AS (SELECT image_id AS rx_id, degrees(atan2((z.y - a.y)::double, (z.x - a.x)::double)) AS angle FROM ends WHERE z.x - a.x >= 100)"""



def _resized(out: str, tw: int, th: int, area: bool) -> str:
    """``out``: pixels at another size."""
    rows = lambda size, to: ", ".join(f"({d}, {s}, {w})" for d, (ss, ws) in enumerate(zip(*rasters.taps(size, to, area), strict=True)) for s, w in zip(ss.tolist(), ws.tolist(), strict=True) if w)
    return f"""across(d, s, w) AS (VALUES {rows(W, tw)}), down(d, s, w) AS (VALUES {rows(H, th)}),
{out}a AS MATERIALIZED (SELECT image_id, y, d AS x, sum(v * w) AS v FROM pixels JOIN across ON s = x GROUP BY image_id, y, d),
{out} AS (SELECT image_id, d AS y, x, greatest(0, least(255, (2 * sum(v * w) + {rasters.TAPS**2}) // {2 * rasters.TAPS**2})) AS v FROM {out}a JOIN down ON s = y GROUP BY image_id, x, d)"""


def _line_sums(source: str, more: str = "") -> str:
    return f"SELECT {more} image_id, CAST(y AS INTEGER) AS y, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (x + 1)) AS BIGINT) AS weighted FROM {source} GROUP BY ALL"


_SHARP = lambda source, out: f"{_around(source, out + 'n')}, {out} AS MATERIALIZED (SELECT image_id, x, y, greatest(0, least(255, 9 * v - (nw + n + ne + w + e + sw + s + se))) AS v FROM {out}n)"
_ADAPTIVE = lambda source, out: f"{_gauss(source, out + 'm', 31)}, {out} AS (SELECT p.image_id, p.x, p.y, CASE WHEN p.v - m.v > -10 THEN 255 ELSE 0 END AS v FROM {source} p JOIN {out}m m USING (image_id, x, y))"

ORACLE = {
    "scaled_images": f"WITH {inputs.RASTERS_SQL}, {_resized('big', 3 * W, 3 * H, False)} {_line_sums('big', f'{3 * W} AS width, {3 * H} AS height, ')}",
    "reduced_images": f"WITH {inputs.RASTERS_SQL}, {_resized('small', W // 4, H // 3, True)} {_line_sums('small', f'{W // 4} AS width, {H // 3} AS height, ')}",
    "image_variants": f"""WITH {inputs.RASTERS_SQL}, {_contrast()}, {_gauss("contrast", "blur", 13, 2.0, True)},
      crisp AS MATERIALIZED (SELECT c.image_id, c.x, c.y, greatest(0, least(255, (2 * (3 * c.v - b.v) + 2) // 4)) AS v FROM contrast c JOIN blur b USING (image_id, x, y)), {_ADAPTIVE("crisp", "v0")},
      {_bilateral()}, {_SHARP("smooth", "sharp")}, {_otsu("sharp", "v1")}, {_otsu("pixels", "v2")},
      v AS (SELECT 0 AS k, * FROM v0 UNION ALL SELECT 1, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM contrast),
      n(k, variant_name) AS (VALUES {", ".join(f"({k}, '{n}')" for k, n in enumerate(images.VARIANT_NAMES))}) {_line_sums("v JOIN n USING (k)", "k AS variant_idx, variant_name, ")}""",
    "otsu_thresholds": f"WITH {inputs.RASTERS_SQL}, {_otsu()} SELECT image_id, threshold FROM partedt",
    "otsu_images": f"WITH {inputs.RASTERS_SQL}, {_otsu()} {_shown('parted')}",
    "adaptive_images": f"WITH {inputs.RASTERS_SQL}, {_ADAPTIVE('pixels', 'r')} {_shown('r')}",
    "contrast_images": f"WITH {inputs.RASTERS_SQL}, {_contrast()} {_shown('contrast')}",
    "smoothed_images": f"WITH {inputs.RASTERS_SQL}, {_bilateral()}, {_SHARP('smooth', 'r')} {_shown('r')}",
    "image_sharpness": f"""WITH {inputs.RASTERS_SQL}, {_otsu()}, {_around('parted', 'near')}, l AS (SELECT image_id, n + s + w + e - 4 * v AS v FROM near),
      q AS (SELECT image_id, (sum(v * v)::double * count(*)::double - sum(v)::double * sum(v)::double) / (count(*)::double * count(*)::double) AS q FROM l GROUP BY image_id) SELECT image_id, round(q, 6) AS variance, round(least(q / 1000, 1), 9) AS quality FROM q""",
    "text_boxes": f"WITH RECURSIVE {_BOXES} SELECT rx_id, x, y, w, h FROM boxes",
    "cropped_images": f"""WITH RECURSIVE {_BOXES}, u AS (SELECT rx_id, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2 FROM boxes WHERE w * h >= 80 AND w >= 10 AND h >= 8 GROUP BY rx_id),
      z AS (SELECT *, CAST(floor(greatest(x2 - x1, y2 - y1) * 0.1::double) AS BIGINT) + 12 AS p FROM u WHERE NOT ((x2 - x1) * (y2 - y1) / {W * H}::double > 0.9 OR x2 - x1 < {W // 10} AND y2 - y1 < {int(H * 0.08)})),
      b AS (SELECT s_suppkey AS image_id, coalesce(greatest(0, x1 - p), 0) AS x1, coalesce(greatest(0, y1 - p), 0) AS y1, coalesce(least({W}, x2 + p), {W}) AS x2, coalesce(least({H}, y2 + p), {H}) AS y2 FROM supplier LEFT JOIN z ON rx_id = s_suppkey)
      SELECT image_id, CAST(any_value(x2 - x1) AS INTEGER) AS width, CAST(any_value(y2 - y1) AS INTEGER) AS height, count(DISTINCT y) AS lines, CAST(sum(v) AS BIGINT) AS total FROM pixels JOIN b USING (image_id) WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY image_id""",
    "image_edges": f"WITH RECURSIVE {_EDGES} SELECT image_id, x, y FROM edges",
    "line_angles": f"WITH RECURSIVE {_ANGLES} SELECT rx_id, round(angle, 9) AS angle FROM angles",
    "image_skews": f"WITH RECURSIVE {_ANGLES}, k AS (SELECT rx_id, coalesce(median(angle) FILTER (angle > -15 AND angle < 15), 0.0::double) AS m FROM angles GROUP BY rx_id) SELECT rx_id, round(CASE WHEN abs(m) < 0.5 THEN 0.0::double ELSE m END, 9) AS skew FROM k",
}
