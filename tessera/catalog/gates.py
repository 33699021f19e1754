"""Queries on gates, picks and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.fixtures import Slides
from tessera.operators import gates as G

from .registry import query


@query("""
SELECT slide_id, format, format IN ('svs', 'generic-tiff', 'cog-wsi', 'ome-tiff') AS edits,
       CASE format WHEN 'generic-tiff' THEN 'tiff' WHEN 'svs' THEN 'svs' WHEN 'ome-tiff' THEN 'ome-tiff' WHEN 'cog-wsi' THEN 'cog-wsi' WHEN 'dicom' THEN 'dicom' END AS target FROM v_slides""")
def format_gates(s: Slides) -> DataFrame:
    return s["v_slides"].select("slide_id", "format", G.edits_side_images(F.col("format")).alias("edits"), G.reduced_target(F.col("format")).alias("target"))


@query("""
SELECT slide_id, type, type IN ('pyramid', 'label', 'macro', 'thumbnail', 'overview', 'probability', 'map', 'associated') AS known
FROM (SELECT slide_id, CASE WHEN slide_id % 5 = 0 THEN upper(type) ELSE type END AS type FROM v_associated) q""")
def type_domain(s: Slides) -> DataFrame:
    rows = s["v_associated"].select("slide_id", F.when(F.col("slide_id") % 5 == 0, F.upper("type")).otherwise(F.col("type")).alias("type"))
    return rows.select("slide_id", "type", G.is_image_type(F.col("type")).alias("known"))


@query("SELECT slide_id, type, 'left out: type ' || type AS warning FROM v_associated WHERE type NOT IN ('label', 'macro', 'thumbnail', 'overview')")
def assoc_left_out(s: Slides) -> DataFrame:
    return G.split_by_type(s["v_associated"])[1]


@query("""
SELECT slide_id, type, width, height, compression, ifd_offset FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY ifd_offset, type) AS n FROM v_associated WHERE type IN ('macro', 'thumbnail')) q WHERE n = 1""")
def first_overview(s: Slides) -> DataFrame:
    return G.first_of_types(s["v_associated"], ("macro", "thumbnail"))


@query("""
SELECT w.slide_id, w.level, l.width, l.height,
       CASE WHEN l.width IS NULL THEN 'level ' || w.level || ' is not one of ' || coalesce(n.n, 0) END AS error
FROM (SELECT slide_id, slide_id % 6 AS level FROM v_slides) w LEFT JOIN v_levels l ON l.slide_id = w.slide_id AND l.level = w.level
LEFT JOIN (SELECT slide_id, count(*) AS n FROM v_levels GROUP BY slide_id) n ON n.slide_id = w.slide_id""")
def choose_level(s: Slides) -> DataFrame:
    return G.choose_level(s["v_slides"].select("slide_id", (F.col("slide_id") % 6).alias("level")), s["v_levels"])


@query("""
SELECT t.slide_id, t.col, t.row_, (t.col + 1) * 64 <= 1000 AND (t.row_ + 1) * 64 <= 900 AS interior,
       CASE WHEN (t.col + 1) * 64 <= 1000 AND (t.row_ + 1) * 64 <= 900 AND t.nbytes % 3 > 0 THEN 'stored-' || t.nbytes ELSE 'made' END AS bytes
FROM v_tiles t WHERE t.level = 0""")
def substituted_tiles(s: Slides) -> DataFrame:
    """Interior tiles as stored, if they are; edge tiles as made: images of 1000 x 900 in tiles of 64."""
    tiles = s["v_tiles"].where("level = 0")
    made = tiles.select("slide_id", "col", "row_", F.lit("made").alias("bytes"))
    stored = tiles.where("nbytes % 3 > 0").select("slide_id", "col", "row_", F.concat(F.lit("stored-"), F.col("nbytes").cast("string")).alias("bytes"))
    return G.substituted(made, stored, F.lit(1000), F.lit(900), F.lit(64))


@query("""
SELECT slide_id, string_agg(k || '=' || v, ';' ORDER BY k) AS properties FROM (
  SELECT slide_id, 'scanner-make' AS k, make AS v FROM v_slides WHERE make <> '' UNION ALL SELECT slide_id, 'scanner-model', model FROM v_slides WHERE model <> ''
  UNION ALL SELECT slide_id, 'source-format', format FROM v_slides UNION ALL SELECT slide_id, 'tile', CAST(tile AS VARCHAR) FROM v_slides) q GROUP BY slide_id""")
def merged_properties(s: Slides) -> DataFrame:
    """A source's own properties, of which one is overruled, and made ones."""
    raw = F.create_map(F.lit("tile"), F.col("tile").cast("string"), F.lit("scanner-make"), F.lit("unknown"))
    merged = G.merged_properties(raw, {"source-format": F.col("format"), "scanner-make": F.col("make"), "scanner-model": F.col("model"), "serial": F.lit(None)})
    text = F.array_join(F.transform(G.sorted_properties(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return s["v_slides"].select("slide_id", text.alias("properties"))


@query("""
SELECT folder, n, candidates FROM (SELECT slide_id % 20 AS folder, count(DISTINCT make) AS n, string_agg(DISTINCT make, ', ' ORDER BY make) AS candidates FROM v_slides GROUP BY 1) q WHERE n > 1""")
def ambiguous_series(s: Slides) -> DataFrame:
    return G.ambiguous_series(s["v_slides"].select((F.col("slide_id") % 20).alias("folder"), F.col("make").alias("series")))


@query("""
SELECT r.rect_id, CASE WHEN w <= 0 OR h <= 0 THEN 'empty' WHEN x < 0 OR y < 0 OR x + w > s.width OR y + h > s.height THEN 'outside' END AS fault
FROM (SELECT rect_id, slide_id, x - 20 AS x, y, w - 5 AS w, h FROM v_rects) r JOIN v_slides s ON s.slide_id = r.slide_id""")
def rect_faults(s: Slides) -> DataFrame:
    rects = s["v_rects"].select("rect_id", "slide_id", (F.col("x") - 20).alias("x"), "y", (F.col("w") - 5).alias("w"), "h")
    both = rects.join(s["v_slides"].select("slide_id", "width", "height"), "slide_id")
    return G.snapped_rects(both, F.col("width"), F.col("height")).select("rect_id", "fault")
