"""Queries on codecs and containers, audits, and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.fixtures import Slides
from tessera.functions import codes
from tessera.operators import audit as A
from tessera.operators import edit as E

from .registry import query

CONTAINERS = tuple(codes.CAPABILITIES)
TARGETS = "(VALUES " + ", ".join(f"('{c}')" for c in CONTAINERS) + ") t(container)"


def listed(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words or ("-",)) + ")"


VERDICT = " ".join(
    f"WHEN container = '{c}' AND compression IN {listed(good)} THEN 'conformant' WHEN container = '{c}' AND compression IN {listed(loose)} THEN CASE WHEN slide_id % 2 = 0 THEN 'nonconformant-allowed' ELSE 'nonconformant' END"
    for c, (good, loose) in codes.CAPABILITIES.items()
)


def with_targets(s: Slides) -> DataFrame:
    return s["v_slides"].withColumn("container", F.explode(F.array(*map(F.lit, CONTAINERS))))


@query(f"SELECT slide_id, container, CASE {VERDICT} ELSE 'unsupported' END AS verdict FROM v_slides JOIN {TARGETS} ON true")
def codec_capability(s: Slides) -> DataFrame:
    verdict = codes.codec_verdict(F.col("container"), F.col("compression"), F.col("slide_id") % 2 == 0)
    return with_targets(s).select("slide_id", "container", verdict.alias("verdict"))


COPY = " OR ".join(f"(container = '{c}' AND compression IN {listed(w)})" for c, w in codes.COPIED.items())


@query(f"""
SELECT slide_id, container, tile = 256 AND container NOT IN ('dzi', 'szi') AND format IN {listed(codes.TILED_FORMATS)} AND ({COPY}) AS eligible
FROM v_slides JOIN {TARGETS} ON true""")
def tile_copy_eligible(s: Slides) -> DataFrame:
    """Whether tiles can be copied as they are into 256-pixel tiles of the container, without a codec asked for."""
    ok = (F.col("tile") == 256) & ~F.col("container").isin("dzi", "szi") & F.col("format").isin(*codes.TILED_FORMATS) & codes.copies_codec(F.col("container"), F.col("compression"))
    return with_targets(s).select("slide_id", "container", ok.alias("eligible"))


@query("""
SELECT slide_id, bool_and(tile_w = 256 AND tile_h = 256) AND count(DISTINCT compression) = 1 AND min(compression) IN ('jpeg', 'avif') AS eligible FROM v_levels GROUP BY slide_id""")
def ife_verbatim_eligible(s: Slides) -> DataFrame:
    square = F.bool_and((F.col("tile_w") == 256) & (F.col("tile_h") == 256))
    return s["v_levels"].groupBy("slide_id").agg((square & (F.count_distinct("compression") == 1) & F.min("compression").isin("jpeg", "avif")).alias("eligible"))


SYNTAX = " ".join(f"WHEN compression = '{c}' AND lossless = {x} THEN '{v[0]}'" for (c, x), v in codes.SYNTAXES.items())
METHOD = " ".join(f"WHEN compression = '{c}' AND lossless = {x} THEN '{v[1]}'" for (c, x), v in codes.SYNTAXES.items() if v[1])


@query(f"SELECT slide_id, CASE {SYNTAX} END AS syntax, CASE {METHOD} END AS method FROM (SELECT *, slide_id % 5 = 0 AS lossless FROM v_slides) q")
def transfer_syntax(s: Slides) -> DataFrame:
    syntax, method = codes.transfer_syntax(F.col("compression"), F.col("slide_id") % 5 == 0)
    return s["v_slides"].select("slide_id", syntax.alias("syntax"), method.alias("method"))


@query("""
SELECT file_id, range_id, start_, reached FROM (SELECT *, max(end_) OVER (PARTITION BY file_id ORDER BY start_, range_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM v_ranges) q WHERE reached > start_""")
def range_overlaps(s: Slides) -> DataFrame:
    return E.overlaps(s["v_ranges"])


@query("""
SELECT a.file_id, a.owner, min(CASE WHEN b.owner = a.owner THEN b.start_ END) AS own_start, min(b.start_) AS cutoff
FROM (SELECT DISTINCT file_id, owner FROM v_ranges) a JOIN v_ranges b ON a.file_id = b.file_id AND b.owner >= a.owner GROUP BY a.file_id, a.owner""")
def min_tail_offset(s: Slides) -> DataFrame:
    return E.tails(s["v_ranges"]).select("file_id", "owner", "own_start", "cutoff")


@query("""
WITH c AS (SELECT a.file_id, a.owner, min(b.start_) AS cutoff FROM (SELECT DISTINCT file_id, owner FROM v_ranges) a JOIN v_ranges b ON a.file_id = b.file_id AND b.owner >= a.owner GROUP BY a.file_id, a.owner)
SELECT c.file_id, c.owner, c.cutoff, EXISTS (SELECT 1 FROM v_ranges r WHERE r.file_id = c.file_id AND r.owner < c.owner AND r.end_ > c.cutoff) AS refused FROM c""")
def range_dominance(s: Slides) -> DataFrame:
    return E.refusals(s["v_ranges"])


@query("SELECT slide_id, type, width, height, compression FROM v_associated WHERE type <> 'label'")
def assoc_remove(s: Slides) -> DataFrame:
    return E.remove(s["v_associated"], "label").select("slide_id", "type", "width", "height", "compression")


@query("""
SELECT slide_id, type, width, height, compression FROM v_associated WHERE type <> 'label'
UNION ALL SELECT slide_id, 'label', CAST(1200 AS BIGINT), CAST(848 AS BIGINT), 'lzw' FROM v_slides WHERE format IN ('svs', 'cog-wsi')
UNION ALL SELECT a.slide_id, a.type, a.width, a.height, a.compression FROM v_associated a JOIN v_slides s ON s.slide_id = a.slide_id WHERE a.type = 'label' AND s.format NOT IN ('svs', 'cog-wsi')""")
def assoc_replace(s: Slides) -> DataFrame:
    new = s["v_slides"].where(F.col("format").isin("svs", "cog-wsi")).select("slide_id", F.lit("label").alias("type"), F.lit(1200).cast("bigint").alias("width"), F.lit(848).cast("bigint").alias("height"), F.lit("lzw").alias("compression"))
    return E.replace(s["v_associated"].select("slide_id", "type", "width", "height", "compression"), new)


@query("""
SELECT slide_id, type, width, height FROM v_associated WHERE type <> 'thumbnail'
UNION ALL SELECT a.slide_id, a.type, greatest(1, CAST(floor(CAST(s.width AS DOUBLE) * 1024 / greatest(s.width, s.height) + 0.5) AS BIGINT)), greatest(1, CAST(floor(CAST(s.height AS DOUBLE) * 1024 / greatest(s.width, s.height) + 0.5) AS BIGINT))
FROM v_associated a JOIN v_slides s ON s.slide_id = a.slide_id WHERE a.type = 'thumbnail' AND greatest(s.width, s.height) > 1024
UNION ALL SELECT a.slide_id, a.type, s.width, s.height FROM v_associated a JOIN v_slides s ON s.slide_id = a.slide_id WHERE a.type = 'thumbnail' AND greatest(s.width, s.height) <= 1024""")
def thumbnail_swap(s: Slides) -> DataFrame:
    """Thumbnails made anew from the slide's sides, where there was one."""
    from tessera.functions.geometry import thumb_extent

    longest = F.greatest("s.width", "s.height")
    old = s["v_associated"].where("type = 'thumbnail'")
    new = old.alias("a").join(s["v_slides"].alias("s"), "slide_id").select("slide_id", "type", thumb_extent(F.col("s.width"), longest, 1024).alias("width"), thumb_extent(F.col("s.height"), longest, 1024).alias("height"))
    return E.replace(s["v_associated"].select("slide_id", "type", "width", "height"), new)


@query("""
SELECT s.slide_id, coalesce(a.width, 1200) AS target_w, coalesce(a.height, 848) AS target_h, 'lzw' AS codec,
       greatest((640.0 / 480) / (CAST(coalesce(a.width, 1200) AS DOUBLE) / coalesce(a.height, 848)), (CAST(coalesce(a.width, 1200) AS DOUBLE) / coalesce(a.height, 848)) / (640.0 / 480)) > 2.0 AS mismatch,
       CASE WHEN a.width IS NULL THEN 'append' ELSE 'replace' END AS mode
FROM v_slides s LEFT JOIN v_associated a ON a.slide_id = s.slide_id AND a.type = 'label'""")
def replacement_plan(s: Slides) -> DataFrame:
    return E.replacement_check(s["v_associated"], "label", 640, 480, 1200, 848, s["v_slides"])


@query("""
WITH told AS (SELECT slide_id, level, CASE WHEN slide_id % 7 = 3 AND level > 0 THEN width * 8 ELSE width END AS width, CASE WHEN slide_id % 11 = 5 AND level > 1 THEN height * 64 ELSE height END AS height FROM v_levels)
SELECT slide_id, min(level) AS level FROM (SELECT *, lag(width) OVER o AS pw, lag(height) OVER o AS ph FROM told WINDOW o AS (PARTITION BY slide_id ORDER BY level)) q
WHERE width >= pw OR height >= ph GROUP BY slide_id""")
def audit_monotone(s: Slides) -> DataFrame:
    """Levels as a faulty reader tells them: some slides have a level that is not smaller than the one before."""
    wide = F.when((F.col("slide_id") % 7 == 3) & (F.col("level") > 0), F.col("width") * 8).otherwise(F.col("width"))
    high = F.when((F.col("slide_id") % 11 == 5) & (F.col("level") > 1), F.col("height") * 64).otherwise(F.col("height"))
    return A.monotone(s["v_levels"].withColumns({"width": wide, "height": high}))


METADATA = """
SELECT slide_id, 'mpp-missing' AS code, 'warning' AS severity FROM v_slides WHERE mpp <= 0
UNION ALL SELECT slide_id, 'magnification-range', 'warning' FROM v_slides WHERE magnification < 0.5 OR magnification > 160
UNION ALL SELECT slide_id, 'mpp-magnification', 'info' FROM v_slides WHERE mpp > 0 AND magnification > 0 AND abs(mpp * magnification - 10) > 1
UNION ALL SELECT slide_id, 'dims-positive', 'error' FROM v_slides WHERE width <= 0 OR height <= 0"""
GEOMETRY = """
SELECT a.slide_id, 'l0-dims-scaled' AS code, 'error' AS severity FROM v_levels a JOIN v_levels b ON a.slide_id = b.slide_id AND a.level = 0 AND b.level = 1
WHERE abs(b.width - floor(a.width / 2)) > 2 OR abs(b.height - floor(a.height / 2)) > 2"""
CODECS = """
SELECT slide_id, 'codec-honoured' AS code, 'error' AS severity FROM v_levels GROUP BY slide_id HAVING NOT bool_and(compression = 'jpeg')"""


@query(METADATA)
def audit_metadata(s: Slides) -> DataFrame:
    return A.metadata(s["v_slides"])


def second_levels(s: Slides) -> DataFrame:
    """Level 1 of each slide, taken as the output of a downsample by 2."""
    return s["v_levels"].where("level = 1").withColumn("level", F.lit(0))


@query(GEOMETRY)
def audit_geometry(s: Slides) -> DataFrame:
    return A.geometry(s["v_levels"], second_levels(s), 2)


@query(CODECS)
def audit_codec(s: Slides) -> DataFrame:
    return A.codecs(s["v_levels"], F.lit("JPEG"))


@query("""
SELECT a.slide_id, a.ifd_index, a.width AS dump_w, b.width AS info_w FROM v_ifds a JOIN v_levels b ON a.slide_id = b.slide_id AND a.ifd_index - 100 = b.level AND (a.width <> b.width OR a.height <> b.height)""")
def audit_cross_container(s: Slides) -> DataFrame:
    """Sides of one container's directories against another's levels by index, where they differ."""
    a, b = s["v_ifds"].alias("a"), s["v_levels"].alias("b")
    rows = a.join(b, (F.col("a.slide_id") == F.col("b.slide_id")) & (F.col("a.ifd_index") - 100 == F.col("b.level")))
    return rows.where("a.width <> b.width or a.height <> b.height").select("a.slide_id", "a.ifd_index", F.col("a.width").alias("dump_w"), F.col("b.width").alias("info_w"))


@query(f"""
WITH f AS ({METADATA} UNION ALL {GEOMETRY} UNION ALL {CODECS})
SELECT slide_id, CAST(sum(CASE WHEN severity = 'info' THEN 1 ELSE 0 END) AS BIGINT) AS n_info, CAST(sum(CASE WHEN severity = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS n_warning,
       CAST(sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_error,
       CASE max(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS worst,
       NOT bool_or(severity = 'error') AS ok, NOT bool_or(severity IN ('error', 'warning')) AS ok_strict FROM f GROUP BY slide_id""")
def validate_report(s: Slides) -> DataFrame:
    return A.verdicts(A.metadata(s["v_slides"]), A.geometry(s["v_levels"], second_levels(s), 2), A.codecs(s["v_levels"], F.lit("jpeg")))
