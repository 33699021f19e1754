"""Queries on slides, levels and their octaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.fixtures import TILE, Slides
from tessera.functions import geometry as G
from tessera.operators import levels as L
from tessera.operators import tiles as T

from .registry import query


@query("""
SELECT s.slide_id, s.format, s.width, s.height, CAST(count(l.level) AS BIGINT) AS n_levels,
       nullif(s.mpp, 0) AS mpp, nullif(s.magnification, 0) AS magnification,
       s.compression IN ('none', 'lzw', 'deflate') AS lossless
FROM v_slides s LEFT JOIN v_levels l ON s.slide_id = l.slide_id
GROUP BY s.slide_id, s.format, s.width, s.height, s.mpp, s.magnification, s.compression""")
def slide_info(s: Slides) -> DataFrame:
    n = s["v_levels"].groupBy("slide_id").agg(F.count("level").alias("n_levels"))
    rows = s["v_slides"].join(n, "slide_id", "left")
    return rows.select("slide_id", "format", "width", "height", F.coalesce("n_levels", F.lit(0)).cast("bigint").alias("n_levels"), F.nullif("mpp", F.lit(0.0)).alias("mpp"), F.nullif("magnification", F.lit(0.0)).alias("magnification"), F.col("compression").isin("none", "lzw", "deflate").alias("lossless"))


@query("""
SELECT slide_id, level, width, height, CAST(ceil(CAST(width AS DOUBLE) / tile_w) AS BIGINT) AS cols, CAST(ceil(CAST(height AS DOUBLE) / tile_h) AS BIGINT) AS rows_,
       round(CAST(max(CASE WHEN level = 0 THEN width END) OVER (PARTITION BY slide_id) AS DOUBLE) / width, 6) AS scale
FROM v_levels""")
def level_table(s: Slides) -> DataFrame:
    return L.level_table(s["v_levels"]).select("slide_id", "level", "width", "height", "cols", "rows_", F.round("scale", 6).alias("scale"))


@query("""
SELECT slide_id, CAST(sum(ceil(CAST(width AS DOUBLE) / tile_w) * ceil(CAST(height AS DOUBLE) / tile_h)) AS BIGINT) AS n_tiles,
       CAST(count(*) AS BIGINT) AS n_levels FROM v_levels GROUP BY slide_id""")
def pyramid_totals(s: Slides) -> DataFrame:
    return L.level_table(s["v_levels"]).groupBy("slide_id").agg(F.sum(F.col("cols") * F.col("rows_")).alias("n_tiles"), F.count(F.lit(1)).alias("n_levels"))


@query("""
SELECT slide_id, level, CAST(count(*) AS BIGINT) AS n_tiles, CAST(sum(nbytes) AS BIGINT) AS nbytes, max(grid * grid) AS n_cells
FROM v_tiles GROUP BY slide_id, level""")
def tile_catalog(s: Slides) -> DataFrame:
    return T.tile_catalog(s["v_tiles"])


@query("""
SELECT slide_id, top AS max_level, CAST(ceil(width / 256.0) AS BIGINT) AS cols, CAST(ceil(height / 256.0) AS BIGINT) AS rows_,
       width - (CAST(ceil(width / 256.0) AS BIGINT) - 1) * 256 AS corner_w, height - (CAST(ceil(height / 256.0) AS BIGINT) - 1) * 256 AS corner_h
FROM (SELECT *, CAST(ceil(ln(CAST(greatest(width, height) AS DOUBLE)) / ln(2.0) - 1e-12) AS BIGINT) AS top FROM v_slides) x""")
def dzi_geometry(s: Slides) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    cols, rows = G.ceil_div(w, 256), G.ceil_div(h, 256)
    tile = F.lit(256).cast("bigint")
    return s["v_slides"].select("slide_id", G.dzi_max_level(w, h).alias("max_level"), cols.alias("cols"), rows.alias("rows_"), G.edge_extent(w, tile, cols - 1).alias("corner_w"), G.edge_extent(h, tile, rows - 1).alias("corner_h"))


@query("""
SELECT slide_id, level, w, h, CAST(ceil(w / 256.0) AS BIGINT) AS cols, CAST(ceil(h / 256.0) AS BIGINT) AS rows_
FROM (SELECT slide_id, k.i AS level, CAST(ceil(width / pow(2, top - k.i)) AS BIGINT) AS w, CAST(ceil(height / pow(2, top - k.i)) AS BIGINT) AS h
      FROM (SELECT *, CAST(ceil(ln(CAST(greatest(width, height) AS DOUBLE)) / ln(2.0) - 1e-12) AS BIGINT) AS top FROM v_slides) x
      JOIN (SELECT unnest(generate_series(0, 20)) AS i) k ON k.i <= top) y""")
def dzi_level_dims(s: Slides) -> DataFrame:
    return L.dzi_levels(s["v_slides"], 256)


@query("""
SELECT slide_id, level, width - (CAST(ceil(CAST(width AS DOUBLE) / tile_w) AS BIGINT) - 1) * tile_w AS corner_w,
       height - (CAST(ceil(CAST(height AS DOUBLE) / tile_h) AS BIGINT) - 1) * tile_h AS corner_h FROM v_levels""")
def edge_tile_dims(s: Slides) -> DataFrame:
    return L.corner_tiles(s["v_levels"])


@query("""
SELECT slide_id, CAST(min(k.i) + 1 AS BIGINT) AS n_levels
FROM v_slides JOIN (SELECT unnest(generate_series(0, 20)) AS i) k ON ceil(least(width, height) / pow(2, k.i)) <= tile GROUP BY slide_id""")
def floored_level_count(s: Slides) -> DataFrame:
    return s["v_slides"].select("slide_id", G.floored_levels(F.col("width"), F.col("height"), F.col("tile")).alias("n_levels"))


OCTAVES = """
WITH o AS (SELECT slide_id, level, width, height, w0, h0, kw, kh,
                  kw >= 0 AND kw = kh AND abs(ceil(w0 / pow(2, greatest(kw, 0))) - width) <= 2 AND abs(ceil(h0 / pow(2, greatest(kh, 0))) - height) <= 2 AS aligned
           FROM v_octaves),
     p AS (SELECT slide_id, max(w0) AS w0, max(h0) AS h0, max(kw) AS deepest, bool_and(aligned) AS aligned, list(DISTINCT kw) AS have FROM o GROUP BY slide_id)"""


@query(OCTAVES + """
SELECT slide_id, string_agg(CAST(kw AS VARCHAR), ',' ORDER BY kw) AS octaves, max(kw) AS deepest, bool_and(aligned) AS aligned, sum(n) > count(*) AS duplicate
FROM (SELECT slide_id, kw, count(*) AS n, bool_and(aligned) AS aligned FROM o GROUP BY slide_id, kw) x GROUP BY slide_id""")
def octave_levels(s: Slides) -> DataFrame:
    return L.octave_sets(s["v_levels"])


@query(OCTAVES + """
SELECT slide_id, CAST(k.i AS BIGINT) AS k, CASE WHEN list_contains(have, k.i) THEN CAST(len(list_filter(have, lambda v: v < k.i)) AS BIGINT) ELSE -1 END AS index_,
       CAST(ceil(CAST(floor(w0 / 2) AS BIGINT) / pow(2, k.i)) AS BIGINT) AS width, CAST(ceil(CAST(floor(h0 / 2) AS BIGINT) / pow(2, k.i)) AS BIGINT) AS height
FROM p JOIN (SELECT unnest(generate_series(0, 20)) AS i) k ON k.i <= deepest WHERE aligned AND list_contains(have, 0)""")
def select_octaves_crop(s: Slides) -> DataFrame:
    return L.planned_octaves(s["v_levels"], {"w": F.floor(F.col("w0") / 2).cast("bigint"), "h": F.floor(F.col("h0") / 2).cast("bigint")})


@query(OCTAVES + """
SELECT slide_id, CAST(k.i - 2 AS BIGINT) AS k, CASE WHEN list_contains(have, k.i) THEN CAST(len(list_filter(have, lambda v: v >= 2 AND v < k.i)) AS BIGINT) ELSE -1 END AS index_,
       CAST(ceil(w0 / pow(2, k.i)) AS BIGINT) AS width, CAST(ceil(h0 / pow(2, k.i)) AS BIGINT) AS height
FROM p JOIN (SELECT unnest(generate_series(2, 20)) AS i) k ON k.i <= deepest WHERE aligned AND list_contains(have, 2)""")
def select_octaves_downsample(s: Slides) -> DataFrame:
    return L.planned_octaves(s["v_levels"], shift=2)


@query("""
SELECT slide_id, target, CASE WHEN magnification > 0 AND f IN (2, 4, 8, 16) AND f = magnification / target THEN f END AS factor
FROM (SELECT *, CAST(floor(magnification / target + 0.0001) AS BIGINT) AS f FROM v_slides JOIN (VALUES (2.5), (5.0), (6.0), (10.0), (20.0)) t(target) ON true) x""")
def target_mag_factor(s: Slides) -> DataFrame:
    targets = F.array(*[F.lit(t) for t in (2.5, 5.0, 6.0, 10.0, 20.0)])
    rows = s["v_slides"].withColumn("target", F.explode(targets))
    return rows.select("slide_id", F.col("target").cast("decimal(3,1)").alias("target"), G.factor_for_magnification(F.col("magnification"), F.col("target")).alias("factor"))


@query("""
SELECT slide_id, f AS factor, CAST(floor(width / f) AS BIGINT) AS width, CAST(floor(height / f) AS BIGINT) AS height, mpp * f AS mpp, magnification / f AS magnification
FROM v_slides JOIN (VALUES (CAST(2 AS BIGINT)), (4), (8), (16)) k(f) ON floor(width / f) >= 1 AND floor(height / f) >= 1""")
def scale_metadata(s: Slides) -> DataFrame:
    f = F.col("factor")
    rows = s["v_slides"].withColumn("factor", F.explode(F.array(*[F.lit(k).cast("bigint") for k in G.FACTORS])))
    w, h = F.floor(F.col("width") / f).cast("bigint"), F.floor(F.col("height") / f).cast("bigint")
    return rows.select("slide_id", "factor", w.alias("width"), h.alias("height"), (F.col("mpp") * f).alias("mpp"), (F.col("magnification") / f).alias("magnification")).where("width >= 1 and height >= 1")


@query("""
SELECT slide_id, CASE WHEN mpp > 0 THEN CAST(floor(100000.0 / mpp + 0.5) AS BIGINT) ELSE 0 END AS num, CAST(CASE WHEN mpp > 0 THEN 10 ELSE 0 END AS BIGINT) AS den
FROM v_slides""")
def mpp_resolution(s: Slides) -> DataFrame:
    num, den = G.pixels_per_cm(F.col("mpp"))
    return s["v_slides"].select("slide_id", num.alias("num"), den.alias("den"))


@query("""
SELECT slide_id, greatest(1, CAST(floor(CAST(width AS DOUBLE) * 1024 / greatest(width, height) + 0.5) AS BIGINT)) AS thumb_w,
       greatest(1, CAST(floor(CAST(height AS DOUBLE) * 1024 / greatest(width, height) + 0.5) AS BIGINT)) AS thumb_h
FROM v_slides WHERE greatest(width, height) > 1024
UNION ALL SELECT slide_id, width, height FROM v_slides WHERE greatest(width, height) <= 1024""")
def thumb_dims(s: Slides) -> DataFrame:
    longest = F.greatest("width", "height")
    return s["v_slides"].select("slide_id", G.thumb_extent(F.col("width"), longest, 1024).alias("thumb_w"), G.thumb_extent(F.col("height"), longest, 1024).alias("thumb_h"))


@query("""
SELECT slide_id, fw AS fit_w, fh AS fit_h, CAST(floor((1200 - fw) / 2) AS BIGINT) AS fit_x, CAST(floor((848 - fh) / 2) AS BIGINT) AS fit_y,
       greatest((CAST(width AS DOUBLE) / height) / (1200.0 / 848), (1200.0 / 848) / (CAST(width AS DOUBLE) / height)) > 2.0 AS mismatch
FROM (SELECT *, greatest(1, CAST(floor(width * least(CAST(1200 AS DOUBLE) / width, CAST(848 AS DOUBLE) / height)) AS BIGINT)) AS fw,
             greatest(1, CAST(floor(height * least(CAST(1200 AS DOUBLE) / width, CAST(848 AS DOUBLE) / height)) AS BIGINT)) AS fh FROM v_slides) x""")
def letterbox_fit(s: Slides) -> DataFrame:
    sides = [F.col("width"), F.col("height"), F.lit(1200).cast("bigint"), F.lit(848).cast("bigint")]
    fit = G.letterbox(*sides)
    return s["v_slides"].select("slide_id", *[v.alias(k) for k, v in fit.items()], G.aspect_mismatch(*sides).alias("mismatch"))


@query("""
SELECT r.rect_id, r.slide_id, t.col, t.row_, greatest(0, r.x - t.col * 64) AS local_x, greatest(0, r.y - t.row_ * 64) AS local_y,
       greatest(t.col * 64 - r.x, 0) AS dst_x, greatest(t.row_ * 64 - r.y, 0) AS dst_y,
       least(t.col * 64 + 64, r.x + r.w) - greatest(t.col * 64, r.x) AS ow, least(t.row_ * 64 + 64, r.y + r.h) - greatest(t.row_ * 64, r.y) AS oh
FROM v_rects r JOIN v_tiles t ON r.slide_id = t.slide_id AND t.level = 0
 AND t.col * 64 < r.x + r.w AND t.col * 64 + 64 > r.x AND t.row_ * 64 < r.y + r.h AND t.row_ * 64 + 64 > r.y""")
def crop_tile_plan(s: Slides) -> DataFrame:
    return T.crop_plan(s["v_tiles"], s["v_rects"], TILE)


@query("""
SELECT r.rect_id, CAST(count(t.nbytes) AS BIGINT) AS n_tiles, CAST(sum(t.nbytes) AS BIGINT) AS nbytes
FROM v_rects r JOIN v_tiles t ON r.slide_id = t.slide_id AND t.level = 0
 AND t.col * 64 < r.x + r.w AND t.col * 64 + 64 > r.x AND t.row_ * 64 < r.y + r.h AND t.row_ * 64 + 64 > r.y
GROUP BY r.rect_id""")
def tiles_in_rect(s: Slides) -> DataFrame:
    return T.tiles_in_rects(s["v_tiles"], s["v_rects"], TILE).groupBy("rect_id").agg(F.count("nbytes").alias("n_tiles"), F.sum("nbytes").alias("nbytes"))


@query("""
SELECT rect_id, x0 AS snap_x, y0 AS snap_y, least(CAST(ceil((x + w) / 240.0) AS BIGINT) * 240, 4096) - x0 AS snap_w, least(CAST(ceil((y + h) / 240.0) AS BIGINT) * 240, 4096) - y0 AS snap_h
FROM (SELECT *, CAST(floor(x / 240.0) AS BIGINT) * 240 AS x0, CAST(floor(y / 240.0) AS BIGINT) * 240 AS y0 FROM v_rects) q""")
def snap_rect(s: Slides) -> DataFrame:
    snapped = G.snapped(*[F.col(c) for c in "xywh"], 240, 4096, 4096)
    return s["v_rects"].select("rect_id", *[v.alias(k) for k, v in snapped.items()])


@query("""
SELECT rect_id, slide_id, CASE WHEN x + w > 2048 THEN 'right' ELSE 'bottom' END AS reason FROM v_rects WHERE x + w > 2048 OR y + h > 2048""")
def crop_bounds_errors(s: Slides) -> DataFrame:
    return T.out_of_bounds(s["v_rects"], 2048, 2048)


@query("""
SELECT l.slide_id, l.level, round(s.mpp * (CAST(z.height AS DOUBLE) / l.height) / 1000, 9) AS spacing_row, round(s.mpp * (CAST(z.width AS DOUBLE) / l.width) / 1000, 9) AS spacing_col,
       round(z.width * s.mpp / 1000, 6) AS volume_w, round(z.height * s.mpp / 1000, 6) AS volume_h
FROM v_levels l JOIN v_levels z ON l.slide_id = z.slide_id AND z.level = 0 JOIN v_slides s ON s.slide_id = l.slide_id WHERE s.mpp > 0""")
def level_spatial(s: Slides) -> DataFrame:
    return L.spatial(s["v_levels"], s["v_slides"])
