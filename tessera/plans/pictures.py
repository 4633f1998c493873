"""Queries of the image kernels, over small pictures that follow from the rows of ``supplier``, with their SQL for DuckDB.

A picture is 8 rows of 9 pixels, so that the gradient hash needs no resizing; every fifth is gray.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import pixels as px

ROWS, COLUMNS, LEVELS = 8, 9, 32
#: Channels at row y and column x of picture k, in the SQL of both engines.
CHANNELS = ("(k * 31 + y * 17 + x * x * 7) % 256", "if(k % 5 = 0, (k * 31 + y * 17 + x * x * 7) % 256, (k * 13 + y * y * 5 + x * 29) % 256)", "if(k % 5 = 0, (k * 31 + y * 17 + x * x * 7) % 256, (k * 7 + (y + 1) * (x + 3) * 11) % 256)")


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img and pixels (red, green and blue of each pixel, row by row)."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS k")
    places = rows.withColumn("p", F.expr(f"sequence(0, {ROWS * COLUMNS - 1})"))
    at = ", ".join(f"cast({c.replace('y', f'(i div {COLUMNS})').replace('x', f'(i % {COLUMNS})')} AS int)" for c in CHANNELS)
    return places.selectExpr("k AS img", f"flatten(transform(p, i -> array({at}))) AS pixels")


def _kernel(of: Callable[[np.ndarray], np.ndarray]):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(pixels: pa.Array) -> pa.Array:
        images = (np.array(p, np.uint8).reshape(ROWS, COLUMNS, 3) for p in pixels.to_pylist())
        return pa.array([np.asarray(of(i), np.float64).ravel().tolist() for i in images], pa.list_(pa.float64()))

    return run("pixels")


def _table(spark: SparkSession, sf_dir: str, of, place: str = "place") -> DataFrame:
    """img, place and v of what a kernel says of each picture."""
    return pictures(spark, sf_dir).select("img", F.posexplode(_kernel(of)).alias(place, "v"))


def pixel_luma(spark, sf_dir):
    return _table(spark, sf_dir, px.luma).select("img", "place", F.round("v", 6).alias("luma"))


def pixel_levels(spark, sf_dir):
    return _table(spark, sf_dir, lambda i: px.quantised(px.luma(i), LEVELS)).select("img", "place", F.col("v").cast("int").alias("level"))


def pixel_hsv(spark, sf_dir):
    found = _table(spark, sf_dir, px.hsv)
    return found.selectExpr("img", "place div 3 AS place", "element_at(array('h', 's', 'v'), cast(place % 3 + 1 AS int)) AS channel", "round(v, 9) AS value")


def pixel_facts(spark, sf_dir):
    """Whether a picture is gray, and its gradient hash."""

    @F.arrow_udf(T.StringType())
    def hashed(pixels: pa.Array) -> pa.Array:
        return pa.array([format(px.dhash(px.luma(np.array(p, np.uint8).reshape(ROWS, COLUMNS, 3))), "016x") for p in pixels.to_pylist()])

    own = pictures(spark, sf_dir)
    return own.select("img", (_kernel(px.is_grayscale)[0] == 1).alias("gray"), hashed("pixels").alias("dhash"))


def hsv_histogram(spark, sf_dir):
    return _table(spark, sf_dir, px.hsv_histogram, "cell").filter("v > 0").select("img", "cell", F.round("v", 9).alias("share"))


def glcm_texture(spark, sf_dir):
    """Mean over four directions, and range, of the co-occurrence properties at distances 1 and 2."""
    found = _table(spark, sf_dir, lambda i: px.texture(i, LEVELS, (1, 2)))
    names = ", ".join(f"'{p}'" for p in px.GLCM_PROPERTIES)
    return found.selectExpr("img", "cast(place div 12 + 1 AS int) AS distance", "if(place % 12 < 6, 'mean', 'range') AS kind", f"element_at(array({names}), cast(place % 6 + 1 AS int)) AS property", "round(v, 9) AS value")


def lbp_histogram(spark, sf_dir):
    return _table(spark, sf_dir, px.lbp_histogram, "code").select("img", "code", F.round("v", 9).alias("share"))


def pixel_views(spark, sf_dir):
    """The eight symmetries of a picture's levels, one behind another."""
    found = _table(spark, sf_dir, lambda i: np.concatenate([v.ravel() for v in px.symmetries(px.quantised(px.luma(i), LEVELS))]))
    return found.selectExpr("img", f"cast(place div {ROWS * COLUMNS} AS int) AS view", f"cast(place % {ROWS * COLUMNS} AS int) AS place", "cast(v AS int) AS level")


#: Heights and widths to which pictures are resized: smaller, larger, and one of each.
SIZES = ((4, 5), (13, 20), (16, 3))


def pixel_resize(spark, sf_dir):
    """Red of pictures in other sizes."""
    found = _table(spark, sf_dir, lambda i: np.concatenate([px.resize(i, *size)[..., 0].ravel() for size in SIZES]))
    cuts = np.cumsum([0] + [h * w for h, w in SIZES])
    of = " ".join(f"WHEN place < {hi} THEN {{}}" for hi in cuts[1:])
    size, at = of.format(*range(len(SIZES))), of.format(*(f"place - {lo}" for lo in cuts[:-1]))
    return found.selectExpr("img", f"CASE {size} END AS size", f"cast(CASE {at} END AS int) AS place", "cast(v AS int) AS red")


def canonical_hash(spark, sf_dir):
    """The hash that a picture shares with its turned and mirrored copies."""

    @F.arrow_udf(T.StringType())
    def hashed(pixels: pa.Array) -> pa.Array:
        return pa.array([px.canonical_hash(np.array(p, np.uint8).reshape(ROWS, COLUMNS, 3)) for p in pixels.to_pylist()], pa.string())

    return pictures(spark, sf_dir).select("img", hashed("pixels").alias("hash"))


QUERIES = {f.__name__: f for f in (pixel_views, pixel_resize, canonical_hash, pixel_luma, pixel_levels, pixel_hsv, pixel_facts, hsv_histogram, glcm_texture, lbp_histogram)}

_PIXELS = f"px AS (SELECT k AS img, y, x, {', '.join(f'({c})::INT AS {n}' for c, n in zip(CHANNELS, 'rgb', strict=True))} FROM (SELECT s_suppkey AS k FROM supplier), range({ROWS}) a(y), range({COLUMNS}) b(x))"
_LUMA = f"{_PIXELS}, lum AS (SELECT *, {px.LUMA[0]}::DOUBLE * r + {px.LUMA[1]}::DOUBLE * g + {px.LUMA[2]}::DOUBLE * b AS l FROM px)"
_LEVEL = f"{_LUMA}, lev AS (SELECT *, least({LEVELS - 1}, floor(l * {LEVELS / 256}))::INT AS q FROM lum)"
_HSV = f"""{_PIXELS}, part AS (SELECT img, y, x, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM px),
top AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM part), away AS (SELECT *, (v - r) / d AS ar, (v - g) / d AS ag, (v - b) / d AS ab FROM top),
hsv AS (SELECT img, y, x, v, if(v > 0, d / v, 0) AS s, CASE WHEN d = 0 THEN 0 WHEN r = v THEN (ab - ag) / 6 WHEN g = v THEN (2 + ar - ab) / 6 ELSE (4 + ag - ar) / 6 END AS h0 FROM away),
hue AS (SELECT *, h0 - floor(h0) AS h FROM hsv)"""
_STEPS = ", ".join(f"({y}, {x})" for y, x in px.GLCM_STEPS)
_GLCM = f"""{_LEVEL}, one AS (SELECT a.img, d, s.dy, s.dx, a.q AS p, b.q AS q FROM lev a, (VALUES {_STEPS}) s(dy, dx), range(1, 3) e(d), lev b WHERE b.img = a.img AND b.y = a.y + d * s.dy AND b.x = a.x + d * s.dx),
both_ AS (SELECT img, d, dy, dx, p, q FROM one UNION ALL SELECT img, d, dy, dx, q, p FROM one), cell AS (SELECT img, d, dy, dx, p, q, count(*) AS n FROM both_ GROUP BY ALL),
share AS (SELECT *, n / sum(n) OVER (PARTITION BY img, d, dy, dx) AS w FROM cell),
mom AS (SELECT img, d, dy, dx, sum(w * (p - q) ** 2) AS contrast, sum(w * abs(p - q)) AS dissimilarity, sum(w / (1 + (p - q) ** 2)) AS homogeneity, sum(w * w) AS asm, sum(w * p) AS m, sum(w * p * p) AS m2, sum(w * p * q) AS pq FROM share GROUP BY ALL),
prop AS (SELECT img, d, dy, dx, unnest([contrast, dissimilarity, homogeneity, sqrt(asm), if(m2 - m * m <= 1e-12, 1, (pq - m * m) / if(m2 - m * m <= 1e-12, 1, m2 - m * m)), asm]) AS value, unnest([{', '.join(f"'{p}'" for p in px.GLCM_PROPERTIES)}]) AS property FROM mom)"""
_RING = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
_LBP = f"""{_LUMA}, up AS (SELECT c.img, c.y, c.x, {', '.join(f'max(if(n.y = c.y + ({dy}) AND n.x = c.x + ({dx}), (n.l >= c.l)::INT, 0)) AS u{i}' for i, (dy, dx) in enumerate(_RING))}
FROM lum c JOIN lum n ON n.img = c.img AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 WHERE c.y BETWEEN 1 AND {ROWS - 2} AND c.x BETWEEN 1 AND {COLUMNS - 2} GROUP BY ALL),
code AS (SELECT img, if({' + '.join(f'abs(u{i} - u{(i + 1) % 8})' for i in range(8))} <= 2, {' + '.join(f'u{i}' for i in range(8))}, 9) AS code FROM up)"""

#: Row, column and width of a pixel at (y, x) after so many quarter turns.
_TURNED = (("y", "x", COLUMNS), (f"{COLUMNS - 1} - x", "y", ROWS), (f"{ROWS - 1} - y", f"{COLUMNS - 1} - x", COLUMNS), ("x", f"{ROWS - 1} - y", ROWS))
_VIEWS = " UNION ALL ".join(
    f"SELECT img, {2 * k + flip} AS view, {y} AS vy, {f'{w - 1} - ({x})' if flip else x} AS vx, {w} AS w, {{value}} AS v FROM {{table}}" for k, (y, x, w) in enumerate(_TURNED) for flip in (0, 1)
)


def _weights(old: int, new: int) -> str:
    """i, j and w: the shares of old places j in new places i, by a triangle that widens when it shrinks."""
    step = old / new
    reach = max(step, 1.0)
    centre = f"((i + 0.5::DOUBLE) * {step!r}::DOUBLE)"
    inside = f"j >= floor(greatest({centre} - {reach!r}::DOUBLE + 0.5, 0)) AND j < floor(least({centre} + {reach!r}::DOUBLE + 0.5, {old}))"
    raw = f"SELECT i, j, greatest(0, 1 - abs(j + 0.5::DOUBLE - {centre}) / {reach!r}::DOUBLE) AS w FROM range({new}) a(i), range({old}) b(j) WHERE {inside}"
    return f"(SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM ({raw}))"


def _resized(table: str, keys: str, old: tuple[int, int], new: tuple[int, int]) -> str:
    """``keys``, y, x and v of a table of bytes v at (y, x), resized across and then down."""
    across = f"SELECT {keys}, y, i AS x, least(255, floor(sum(v * w) + 0.5)) AS v FROM {table} JOIN {_weights(old[1], new[1])} ON j = x GROUP BY ALL" if old[1] != new[1] else f"SELECT {keys}, y, x, v FROM {table}"
    return f"SELECT {keys}, i AS y, x, least(255, floor(sum(v * w) + 0.5)) AS v FROM ({across}) JOIN {_weights(old[0], new[0])} ON j = y GROUP BY ALL" if old[0] != new[0] else across


_RESIZED = " UNION ALL ".join(f"SELECT img, {k} AS size, (y * {w} + x)::INT AS place, v::INT AS red FROM ({_resized('red', 'img', (ROWS, COLUMNS), (h, w))})" for k, (h, w) in enumerate(SIZES))
_CANONICAL = f"""{_LUMA}, views AS ({_VIEWS.format(value="floor(l)", table="lum")}),
whole AS (SELECT img, view, vy AS y, vx AS x, v FROM views WHERE w = {COLUMNS}), turned AS (SELECT img, view, vy AS y, vx AS x, v FROM views WHERE w = {ROWS}),
every AS (SELECT img, view, y, x, v FROM whole UNION ALL SELECT img, view, y, x, v FROM ({_resized('turned', 'img, view', (COLUMNS, ROWS), (ROWS, COLUMNS))})),
bits AS (SELECT a.img, a.view, sum(if(b.v > a.v, 1::HUGEINT << (63 - a.y * 8 - a.x)::INT, 0::HUGEINT)) AS h FROM every a JOIN every b ON b.img = a.img AND b.view = a.view AND b.y = a.y AND b.x = a.x + 1 GROUP BY ALL)"""

ORACLE_SQL = {
    "pixel_views": f"WITH {_LEVEL} SELECT img, view::INT AS view, (vy * w + vx)::INT AS place, v AS level FROM ({_VIEWS.format(value='q', table='lev')})",
    "pixel_resize": f"WITH {_PIXELS}, red AS (SELECT img, y, x, r AS v FROM px) {_RESIZED}",
    "canonical_hash": f"WITH {_CANONICAL} SELECT img, min(lpad(format('{{:x}}', h::UBIGINT), 16, '0')) AS hash FROM bits GROUP BY img",
    "pixel_luma": f"WITH {_LUMA} SELECT img, (y * {COLUMNS} + x)::INT AS place, round(l, 6) AS luma FROM lum",
    "pixel_levels": f"WITH {_LEVEL} SELECT img, (y * {COLUMNS} + x)::INT AS place, q AS level FROM lev",
    "pixel_hsv": f"WITH {_HSV} SELECT img, y * {COLUMNS} + x AS place, unnest(['h', 's', 'v']) AS channel, unnest([round(h, 9), round(s, 9), round(v, 9)]) AS value FROM hue",
    "pixel_facts": f"WITH {_LUMA}, bits AS (SELECT a.img, sum(if(floor(b.l) > floor(a.l), 1::HUGEINT << (63 - a.y * 8 - a.x)::INT, 0::HUGEINT)) AS h FROM lum a JOIN lum b ON b.img = a.img AND b.y = a.y AND b.x = a.x + 1 GROUP BY a.img), gray AS (SELECT img, bool_and(abs(r - g) <= 2 AND abs(g - b) <= 2) AS gray FROM px GROUP BY img) SELECT img, gray, lpad(format('{{:x}}', h::UBIGINT), 16, '0') AS dhash FROM bits JOIN gray USING (img)",
    "hsv_histogram": f"WITH {_HSV} SELECT img, (least(7, floor(h * 8)) * 64 + least(7, floor(s * 8)) * 8 + least(7, floor(v * 8)))::INT AS cell, round(count(*) / {ROWS * COLUMNS}, 9) AS share FROM hue GROUP BY ALL",
    "glcm_texture": f"WITH {_GLCM} SELECT img, d::INT AS distance, unnest(['mean', 'range']) AS kind, property, unnest([round(m, 9), round(r, 9)]) AS value FROM (SELECT img, d, property, avg(value) AS m, max(value) - min(value) AS r FROM prop GROUP BY ALL)",
    "lbp_histogram": f"WITH {_LBP} SELECT p.img, c::INT AS code, round(count(code) / {(ROWS - 2) * (COLUMNS - 2)}, 9) AS share FROM (SELECT DISTINCT img FROM px) p CROSS JOIN range(10) t(c) LEFT JOIN code ON code.img = p.img AND code.code = c GROUP BY ALL",
}
