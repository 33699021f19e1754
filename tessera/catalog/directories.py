"""Queries on image directories and their tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.fixtures import Slides
from tessera.functions import codes
from tessera.operators import directories as D

from .registry import query


@query("""
WITH b AS (SELECT slide_id, width, height, compression, 1 AS rank, level AS place, 'pyramid' AS image_type, level AS level_index FROM v_levels
           UNION ALL SELECT slide_id, width, height, compression, 0, -ifd_offset, type, NULL FROM v_associated),
     w AS (SELECT *, row_number() OVER (PARTITION BY slide_id, width, height, compression ORDER BY rank DESC, place DESC) AS n FROM b)
SELECT i.slide_id, i.ifd_index, i.width, i.height, i.compression, coalesce(w.image_type, '(unclassified)') AS image_type, w.level_index
FROM v_ifds i LEFT JOIN w ON w.n = 1 AND i.slide_id = w.slide_id AND i.width = w.width AND i.height = w.height AND i.compression = w.compression""")
def classify_ifds(s: Slides) -> DataFrame:
    return D.classify(s["v_ifds"], s["v_levels"], s["v_associated"])


@query("""
SELECT a.slide_id, a.type, a.ifd_offset, i.ifd_index FROM v_associated a LEFT JOIN v_ifds i ON i.slide_id = a.slide_id AND i.ifd_offset = a.ifd_offset""")
def locate_associated(s: Slides) -> DataFrame:
    return D.locate(s["v_associated"], s["v_ifds"])


NAMED_TAGS = ", ".join(f"({k}, '{v}')" for k, v in codes.TAG_NAMES.items())


@query(f"SELECT i.slide_id, i.ifd_index, CAST(t.tag AS INTEGER) AS tag, t.name FROM v_ifds i JOIN (VALUES {NAMED_TAGS}) t(tag, name) ON t.tag % 7 = i.ifd_index % 7")
def tag_names(s: Slides) -> DataFrame:
    """Names of tags from the dictionary, a few for each directory: an equi-join with a table of fixed size."""
    names = codes.dimension(s.spark, [(k, v, k % 7) for k, v in codes.TAG_NAMES.items()], "tag int, name string, some long")
    return s["v_ifds"].withColumn("some", F.col("ifd_index") % 7).join(names, "some").select("slide_id", "ifd_index", "tag", "name")


CASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.COMPRESSION_TAGS.items())
NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.COMPRESSION_NAMES.items())


@query(f"""
SELECT slide_id, ifd_index, tag, CASE tag {NAMES} ELSE 'tag-' || tag END AS named,
       concat_ws('|', CASE WHEN subfile % 2 = 1 THEN 'reduced-resolution' END, CASE WHEN CAST(floor(subfile / 2) AS BIGINT) % 2 = 1 THEN 'page-of-multi' END) AS subfile_text
FROM (SELECT *, CAST(CASE compression {CASES} ELSE 0 END AS BIGINT) AS tag, CAST(CASE WHEN ifd_index = 0 THEN 0 WHEN ifd_index >= 100 THEN 3 ELSE 1 END AS BIGINT) AS subfile FROM v_ifds) q""")
def tag_dictionary(s: Slides) -> DataFrame:
    tag = codes.compression_tag(F.col("compression"))
    subfile = F.when(F.col("ifd_index") == 0, 0).when(F.col("ifd_index") >= 100, 3).otherwise(1).cast("bigint")
    return s["v_ifds"].select("slide_id", "ifd_index", tag.alias("tag"), codes.compression_name(tag).alias("named"), codes.subfile_text(subfile).alias("subfile_text"))


@query("""
SELECT slide_id, ifd_index, array_to_string(CASE WHEN len(v) > 8 THEN v[1:8] ELSE v END, ',') AS shown, len(v) > 8 AS truncated, CAST(len(v) AS BIGINT) AS n
FROM (SELECT slide_id, ifd_index, list_transform(generate_series(0, ifd_index % 20), lambda i: ifd_offset + i * 16) AS v FROM v_ifds) q""")
def truncate_values(s: Slides) -> DataFrame:
    """Arrays of offsets as a dump shows them: the first eight, and whether more were there."""
    values = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("ifd_index") % 20), lambda i: F.col("ifd_offset") + i * 16)
    rows = s["v_ifds"].select("slide_id", "ifd_index", values.alias("v"))
    shown = F.array_join(F.transform(F.slice("v", 1, 8), lambda x: x.cast("string")), ",")
    return rows.select("slide_id", "ifd_index", shown.alias("shown"), (F.size("v") > 8).alias("truncated"), F.size("v").cast("bigint").alias("n"))


@query("""
SELECT slide_id, ifd_index, type_name, size * n AS nbytes, size * n <= 4 AS inline_classic, size * n <= 8 AS inline_big
FROM (SELECT slide_id, ifd_index, CASE ifd_index % 4 WHEN 0 THEN 'SHORT' WHEN 1 THEN 'LONG' WHEN 2 THEN 'RATIONAL' ELSE 'LONG8' END AS type_name,
             CAST(CASE ifd_index % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 8 END AS BIGINT) AS size, 1 + width % 3 AS n FROM v_ifds) q""")
def tag_value_sizes(s: Slides) -> DataFrame:
    """Type names, sizes and whether a value fits in its entry."""
    kind = F.element_at(F.array(*map(F.lit, (3, 4, 5, 16))), (F.col("ifd_index") % 4).cast("int") + 1)
    named = F.coalesce(*[F.when(kind == k, v) for k, v in codes.TYPE_NAMES.items()])
    size = F.coalesce(*[F.when(kind == k, v) for k, v in codes.TYPE_SIZES.items()]).cast("bigint") * (F.col("width") % 3 + 1)
    return s["v_ifds"].select("slide_id", "ifd_index", named.alias("type_name"), size.alias("nbytes"), (size <= 4).alias("inline_classic"), (size <= 8).alias("inline_big"))
