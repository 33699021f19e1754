"""Queries on the rasters of embeddings: every vector is a row of pixels, every 101 vectors are an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.fixtures import Slides
from tessera.operators import pyramid as P

from .registry import query

KEYS = ("slide_id",)
#: Halves a table of pixels with their rasters' sides; the sides are halved too.
HALF = """SELECT slide_id, CAST(floor(x / 2) AS BIGINT) AS x, CAST(floor(y / 2) AS BIGINT) AS y,
  CAST(floor(sum(r * wt) / 4) AS INTEGER) AS r, CAST(floor(sum(g * wt) / 4) AS INTEGER) AS g, CAST(floor(sum(b * wt) / 4) AS INTEGER) AS b,
  max(CAST(ceil(width / 2) AS BIGINT)) AS width, max(CAST(ceil(height / 2) AS BIGINT)) AS height
FROM (SELECT *, (CASE WHEN x = width - 1 AND width % 2 = 1 THEN 2 ELSE 1 END) * (CASE WHEN y = height - 1 AND height % 2 = 1 THEN 2 ELSE 1 END) AS wt FROM {t}) q GROUP BY 1, 2, 3"""
IMAGE = "img AS (SELECT p.*, z.width, z.height FROM v_rasters p JOIN v_raster_sizes z ON z.slide_id = p.slide_id)"


def rasters(s: Slides) -> DataFrame:
    """All pixels of all rasters, each with its raster's sides."""
    return s["v_rasters"].join(s["v_raster_sizes"], "slide_id")


@query("SELECT x, y, r, g, b FROM v_pixels WHERE x BETWEEN 10 AND 40 AND y BETWEEN 17 AND 140")
def region_pixels(s: Slides) -> DataFrame:
    return P.read_region(s["v_pixels"], 10, 17, 31, 124, white=None)


@query("""
SELECT CAST(cx.i AS BIGINT) AS x, CAST(cy.i AS BIGINT) AS y, coalesce(r, 255) AS r, coalesce(g, 255) AS g, coalesce(b, 255) AS b
FROM (SELECT unnest(generate_series(50, 79)) AS i) cx CROSS JOIN (SELECT unnest(generate_series(-8, 40)) AS i) cy LEFT JOIN v_pixels p ON p.x = cx.i AND p.y = cy.i""")
def region_white_fill(s: Slides) -> DataFrame:
    return P.read_region(s["v_pixels"], 50, -8, 30, 49)


@query(f"WITH {IMAGE}, l1 AS ({HALF.format(t='img')}) SELECT slide_id, x, y, r, g, b FROM l1")
def box_downsample_2x(s: Slides) -> DataFrame:
    return P.box_halve(rasters(s), F.col("width"), F.col("height"), keys=KEYS)


@query(f"""
WITH {IMAGE}, l1 AS ({HALF.format(t="img")}), l2 AS ({HALF.format(t="l1")}), l3 AS ({HALF.format(t="l2")}), l4 AS ({HALF.format(t="l3")})
SELECT slide_id, 1 AS level, x, y, r, g, b FROM l1 UNION ALL SELECT slide_id, 2, x, y, r, g, b FROM l2 UNION ALL SELECT slide_id, 3, x, y, r, g, b FROM l3 UNION ALL SELECT slide_id, 4, x, y, r, g, b FROM l4""")
def pyramid_all_levels(s: Slides) -> DataFrame:
    return P.pyramid(s["v_rasters"], 4, KEYS)


@query(f"""
WITH {IMAGE} SELECT slide_id, CAST(floor(x / 2) AS BIGINT) AS x, CAST(floor(y / 2) AS BIGINT) AS y, CAST(floor(sum(r) / 4) AS INTEGER) AS r, CAST(floor(sum(g) / 4) AS INTEGER) AS g, CAST(floor(sum(b) / 4) AS INTEGER) AS b
FROM img WHERE x < width - width % 2 AND y < height - height % 2 GROUP BY 1, 2, 3""")
def halve_floor(s: Slides) -> DataFrame:
    return P.box_halve(rasters(s), F.col("width"), F.col("height"), duplicate_edge=False, keys=KEYS)


@query("""
SELECT slide_id, x, y, r, g, b FROM (SELECT slide_id, CAST(floor(x / 8) AS BIGINT) AS x, CAST(floor(y / 8) AS BIGINT) AS y, r, g, b,
  row_number() OVER (PARTITION BY slide_id, floor(x / 8), floor(y / 8) ORDER BY v_rasters.y DESC, v_rasters.x DESC) AS n FROM v_rasters) q WHERE n = 1""")
def thumbnail_reduce(s: Slides) -> DataFrame:
    return P.subsample(s["v_rasters"], 8, KEYS)


@query(f"""
WITH {IMAGE}, c AS (SELECT CAST(i AS BIGINT) AS i FROM (SELECT unnest(generate_series(0, 3)) AS i) z)
SELECT slide_id, c.i AS col, d.i AS row_, x - greatest(0, c.i * 32 - 2) AS px, y - greatest(0, d.i * 32 - 2) AS py, r, g, b
FROM img JOIN c ON x >= c.i * 32 - 2 AND x < (c.i + 1) * 32 + 2 AND c.i <= floor((width - 1) / 32) JOIN c d ON y >= d.i * 32 - 2 AND y < (d.i + 1) * 32 + 2 AND d.i <= floor((height - 1) / 32)""")
def retile_overlap_halo(s: Slides) -> DataFrame:
    return P.retile(rasters(s), F.col("width"), F.col("height"), 32, 2, KEYS)


@query(f"""
WITH {IMAGE}, c AS (SELECT CAST(i AS BIGINT) AS i FROM (SELECT unnest(generate_series(0, 127)) AS i) z)
SELECT z.slide_id, cx.i AS x, cy.i AS y, r, g, b FROM v_raster_sizes z JOIN c cx ON cx.i < ceil(z.width / 64) * 64 JOIN c cy ON cy.i < ceil(z.height / 64) * 64
JOIN img ON img.slide_id = z.slide_id AND img.x = least(cx.i, z.width - 1) AND img.y = least(cy.i, z.height - 1)""")
def edge_replicate_pad(s: Slides) -> DataFrame:
    return P.pad_edges(rasters(s), F.col("width"), F.col("height"), 64, KEYS)


@query("""
SELECT slide_id, x, y, CAST((r - coalesce(lag(r) OVER o, 0) + 256) % 256 AS INTEGER) AS r, CAST((g - coalesce(lag(g) OVER o, 0) + 256) % 256 AS INTEGER) AS g, CAST((b - coalesce(lag(b) OVER o, 0) + 256) % 256 AS INTEGER) AS b
FROM v_rasters WINDOW o AS (PARTITION BY slide_id, y ORDER BY x)""")
def predictor2(s: Slides) -> DataFrame:
    return P.predictor(s["v_rasters"], KEYS)


@query(f"WITH {IMAGE} SELECT slide_id, height - 1 - y AS x, x AS y, r, g, b FROM img")
def rotate90(s: Slides) -> DataFrame:
    return P.rotate_clockwise(rasters(s), F.col("height"), KEYS)


HASH = """SELECT {k}CAST(floor(x / {t}) AS BIGINT) AS col, CAST(floor(y / {t}) AS BIGINT) AS row_,
  sha256(unhex(string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY y, x))) AS sha256 FROM {src} GROUP BY ALL"""


@query(HASH.format(k="", t=16, src="v_pixels"))
def pixel_hash(s: Slides) -> DataFrame:
    return P.tile_hashes(s["v_pixels"], 16)


@query("""
SELECT slide_id, CAST(3 * count(*) AS BIGINT) AS nbytes, sha256(unhex(string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY y, x))) AS sha256 FROM v_rasters GROUP BY slide_id""")
def raster_hash(s: Slides) -> DataFrame:
    """One hash of each raster's bytes in row order."""
    return P.raster_hashes(s["v_rasters"], KEYS)


@query(f"""
WITH {IMAGE}, cut AS (SELECT slide_id, x - 4 AS x, y - 6 AS y, r, g, b, least(55, width - 4) AS width, least(57, height - 6) AS height FROM img WHERE x BETWEEN 4 AND 58 AND y BETWEEN 6 AND 62),
half AS ({HALF.format(t="cut")}) """ + HASH.format(k="slide_id, ", t=16, src="half"))
def crop_halve_hash(s: Slides) -> DataFrame:
    """A crop of every raster, a reduction and a hash of every tile: the smallest whole plan."""
    left = {c: F.least(F.lit(n), F.col(c) - at).alias(c) for c, at, n in (("width", 4, 55), ("height", 6, 57))}
    cut = P.crop(s["v_rasters"], 4, 6, 55, 57, KEYS).join(s["v_raster_sizes"].select("slide_id", *left.values()), "slide_id")
    return P.tile_hashes(P.box_halve(cut, F.col("width"), F.col("height"), keys=KEYS), 16, KEYS)
