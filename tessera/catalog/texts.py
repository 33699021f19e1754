"""Queries on slide descriptions, option texts and codec facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.fixtures import Slides
from tessera.functions import geometry as G
from tessera.functions import jpeg as J
from tessera.functions import text as X

from .registry import query

#: A description for each slide, in both engines. Every fifth has no Aperio prefix, every third repeats a key.
DESCRIBED = """
SELECT slide_id, width, height, tile, compression,
       CASE WHEN slide_id % 5 = 0 THEN 'Other' ELSE 'Aperio' END || ' Image Library v' || (slide_id % 12) || chr(13) || chr(10) || width || 'x' || height || ' [0,100 ' || (width - 7) || 'x' || (height - 9) ||
       '] (' || tile || 'x' || tile || ') JPEG/RGB Q=' || (30 + slide_id % 70) || '|AppMag = ' || (CASE slide_id % 3 WHEN 0 THEN '40' ELSE '20' END) || '|MPP = ' || (CASE slide_id % 3 WHEN 0 THEN '0.25' ELSE '0.5' END) ||
       '|ScanScope ID = S' || slide_id || '|note without value|OriginalWidth = ' || width || CASE WHEN slide_id % 3 = 0 THEN '|ScanScope ID = again' ELSE '' END AS txt
FROM v_slides"""


def described(s: Slides) -> DataFrame:
    return s.spark.sql(DESCRIBED.replace("FROM v_slides", "FROM {v}"), v=s["v_slides"])


FLAT = f"""
d AS (SELECT *, replace(txt, chr(13) || chr(10), chr(10)) AS flat FROM ({DESCRIBED}) q),
e AS (SELECT *, substr(flat, 1, strpos(flat, chr(10)) - 1) AS banner, string_split(substr(flat, strpos(flat, chr(10)) + 1), '|') AS chunks FROM d WHERE starts_with(txt, 'Aperio')),
p AS (SELECT slide_id, n, trim(substr(c, 1, strpos(c, '=') - 1)) AS k, trim(substr(c, strpos(c, '=') + 1)) AS v
      FROM (SELECT slide_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS n FROM e) z WHERE n > 1 AND strpos(c, '=') > 0),
r AS (SELECT slide_id, k, min(n) AS pos, arg_max(v, n) AS v FROM p GROUP BY slide_id, k)"""


@query(f"""
WITH {FLAT}
SELECT e.slide_id, e.banner, e.chunks[1] AS geometry, q.pairs, q.mpp, q.app_mag, CAST(nullif(regexp_extract(e.chunks[1], 'Q=([0-9]+)', 1), '') AS BIGINT) AS quality
FROM e JOIN (SELECT slide_id, string_agg(k || '=' || v, ';' ORDER BY pos) AS pairs, CAST(max(CASE WHEN k = 'MPP' THEN v END) AS DOUBLE) AS mpp, CAST(max(CASE WHEN k = 'AppMag' THEN v END) AS DOUBLE) AS app_mag FROM r GROUP BY slide_id) q
ON q.slide_id = e.slide_id""")
def aperio_parse(s: Slides) -> DataFrame:
    rows = described(s)
    parts = X.aperio_parts(F.col("txt"))
    rows = rows.select("slide_id", *[v.alias(k) for k, v in parts.items()]).where("banner is not null")
    pairs = F.array_join(F.transform("pairs", lambda p: F.concat(p["k"], F.lit("="), p["v"])), ";")
    number = {k: X.pair_value(F.col("pairs"), name).try_cast("double") for k, name in (("mpp", "MPP"), ("app_mag", "AppMag"))}
    return rows.select("slide_id", "banner", "geometry", pairs.alias("pairs"), *[v.alias(k) for k, v in number.items()], X.jpeg_quality_token(F.col("geometry")).alias("quality"))


@query(f"""
WITH {FLAT}
SELECT e.slide_id, e.banner || chr(13) || chr(10) || CAST(floor(e.width / 2) AS BIGINT) || 'x' || CAST(floor(e.height / 2) AS BIGINT) || substr(e.chunks[1], strpos(e.chunks[1], ' ')) || q.tail AS txt
FROM e JOIN (SELECT r.slide_id, string_agg('|' || k || ' = ' || CASE k WHEN 'AppMag' THEN (CASE v WHEN '40' THEN '20' ELSE '10' END) WHEN 'MPP' THEN (CASE v WHEN '0.25' THEN '0.5' ELSE '1' END)
       WHEN 'OriginalWidth' THEN CAST(CAST(floor(e.width / 2) AS BIGINT) AS VARCHAR) ELSE v END, '' ORDER BY pos) AS tail FROM r JOIN e ON e.slide_id = r.slide_id GROUP BY r.slide_id) q ON q.slide_id = e.slide_id""")
def aperio_downsample(s: Slides) -> DataFrame:
    w, h = (F.floor(F.col(c) / 2).cast("bigint") for c in ("width", "height"))
    parts = X.aperio_downsampled(X.aperio_parts(F.col("txt")), 2, w, h)
    rows = described(s).select("slide_id", X.aperio_encoded(parts["banner"], parts["geometry"], parts["pairs"]).alias("txt"))
    return rows.where("txt is not null")


@query(f"""
SELECT slide_id, 'Aperio Image Library v{X.SOFTWARE}' || chr(13) || chr(10) || width || 'x' || height || ' [10,20 300x200] (' || tile || 'x' || tile || ') ' || CASE WHEN compression = 'jpeg2000' THEN 'J2K/YUV16' ELSE 'JPEG/RGB' END ||
       ' Q=85;' || replace(txt, chr(13) || chr(10), chr(10)) || '|OriginalWidth = ' || width || '|OriginalHeight = ' || height AS txt FROM ({DESCRIBED}) q""")
def aperio_crop_desc(s: Slides) -> DataFrame:
    n = [F.lit(v) for v in (10, 20, 300, 200)]
    return described(s).select("slide_id", X.crop_description(F.col("txt"), F.col("width"), F.col("height"), *n, F.col("tile"), F.col("compression"), F.lit(85)).alias("txt"))


@query("""
SELECT slide_id, '<Image ID="Image:' || (row_number() OVER (PARTITION BY slide_id ORDER BY ifd_offset)) || '" Name="' || type || '"><Pixels SizeX="' || width || '" SizeY="' || height || '"/></Image>' AS xml FROM v_associated""")
def ome_images(s: Slides) -> DataFrame:
    """Image elements of side images, numbered behind the primary one."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("slide_id").orderBy("ifd_offset"))
    return s["v_associated"].select("slide_id", F.format_string('<Image ID="Image:%d" Name="%s"><Pixels SizeX="%d" SizeY="%d"/></Image>', n, X.xml_escaped(F.col("type")), "width", "height").alias("xml"))


@query(f"""
SELECT slide_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06" Creator="{X.SOFTWARE}">' ||
       CASE WHEN magnification > 0 THEN '<Instrument ID="Instrument:0"><Objective ID="Objective:0" NominalMagnification="' || CAST(CAST(magnification AS BIGINT) AS VARCHAR) || '"/></Instrument>' ELSE '' END ||
       '<Image ID="Image:0" Name="' || replace(replace(model || ' <&>', '&', '&amp;'), '<', '&lt;') || '"><Pixels ID="Pixels:0:0" DimensionOrder="XYCZT" Type="uint8" SizeX="' || width || '" SizeY="' || height || '" SizeZ="1" SizeC="3" SizeT="1"' ||
       CASE mpp WHEN 0.25 THEN ' PhysicalSizeX="0.25" PhysicalSizeXUnit="µm"' WHEN 0.5 THEN ' PhysicalSizeX="0.5" PhysicalSizeXUnit="µm"' ELSE '' END || '/></Image></OME>' AS xml
FROM (SELECT slide_id, width, height, mpp, magnification, replace(model || ' <&>', '>', '&gt;') AS gt, model FROM v_slides) q""".replace("replace(replace(model || ' <&>', '&', '&amp;'), '<', '&lt;')", "replace(replace(replace(model || ' <&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"))
def ome_xml(s: Slides) -> DataFrame:
    mag, mpp = F.col("magnification"), F.col("mpp")
    tool = F.when(mag > 0, F.concat(F.lit('<Instrument ID="Instrument:0"><Objective ID="Objective:0" NominalMagnification="'), X.plain_number(mag), F.lit('"/></Instrument>'))).otherwise("")
    size = F.when(mpp > 0, F.concat(F.lit(' PhysicalSizeX="'), X.plain_number(mpp), F.lit('" PhysicalSizeXUnit="µm"'))).otherwise("")
    name = X.xml_escaped(F.concat("model", F.lit(" <&>")))
    head = F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06" Creator="{X.SOFTWARE}">')
    image = F.concat(F.lit('<Image ID="Image:0" Name="'), name, F.lit('"><Pixels ID="Pixels:0:0" DimensionOrder="XYCZT" Type="uint8" SizeX="'), F.col("width").cast("string"), F.lit('" SizeY="'), F.col("height").cast("string"), F.lit('" SizeZ="1" SizeC="3" SizeT="1"'), size, F.lit("/></Image></OME>"))
    return s["v_slides"].select("slide_id", F.concat(head, tool, image).alias("xml"))


@query("""
SELECT slide_id, concat_ws(';', 'ImageWidth=' || width, 'ImageHeight=' || height, CASE mpp WHEN 0.25 THEN 'MicronsPerPixel=0.25' WHEN 0.5 THEN 'MicronsPerPixel=0.5' END, 'VendorName=' || make,
       CASE magnification WHEN 40 THEN 'ObjectiveMagnification=40' WHEN 20 THEN 'ObjectiveMagnification=20' END) AS properties FROM v_slides""")
def scan_properties(s: Slides) -> DataFrame:
    """Name=value pairs of a scan-properties document in their order, unknown ones left out."""

    def pair(name, value):
        return F.concat(F.lit(f"{name}="), value)

    props = [pair("ImageWidth", F.col("width").cast("string")), pair("ImageHeight", F.col("height").cast("string")), F.when(F.col("mpp") > 0, pair("MicronsPerPixel", X.plain_number(F.col("mpp")))), pair("VendorName", F.col("make")), F.when(F.col("magnification") > 0, pair("ObjectiveMagnification", X.plain_number(F.col("magnification"))))]
    return s["v_slides"].select("slide_id", F.concat_ws(";", *props).alias("properties"))


KNOBS = "CASE slide_id % 6 WHEN 0 THEN '90' WHEN 1 THEN '' WHEN 2 THEN 'q=' || (slide_id % 130) || ',effort=7' WHEN 3 THEN 'lossless=true' WHEN 4 THEN 'q=5,q=6' ELSE 'best' END"


@query(f"""
SELECT slide_id, knobs, CASE WHEN q BETWEEN 1 AND 100 THEN q END AS quality
FROM (SELECT slide_id, {KNOBS} AS knobs, CAST(CASE slide_id % 6 WHEN 0 THEN 90 WHEN 1 THEN 85 WHEN 2 THEN slide_id % 130 WHEN 3 THEN 85 WHEN 4 THEN 6 END AS BIGINT) AS q FROM v_slides) z""")
def quality_knobs(s: Slides) -> DataFrame:
    rows = s["v_slides"].select("slide_id", F.expr(KNOBS).alias("knobs"))
    return rows.select("slide_id", "knobs", X.quality_knob(F.col("knobs")).alias("quality"))


@query("""
SELECT rect_id, txt, CASE WHEN rect_id % 7 NOT IN (0, 1) THEN x END AS px, CASE WHEN rect_id % 7 NOT IN (0, 1) THEN h END AS ph
FROM (SELECT *, CASE rect_id % 7 WHEN 0 THEN x || ',' || y WHEN 1 THEN x || ',y,' || w || ',' || h ELSE x || ', ' || y || ',' || w || ',' || h END AS txt FROM v_rects) q""")
def rect_parse(s: Slides) -> DataFrame:
    text = F.expr("CASE rect_id % 7 WHEN 0 THEN x || ',' || y WHEN 1 THEN x || ',y,' || w || ',' || h ELSE x || ', ' || y || ',' || w || ',' || h END")
    rows = s["v_rects"].select("rect_id", text.alias("txt"))
    rows = rows.withColumn("n", X.rect_numbers(F.col("txt")))
    return rows.select("rect_id", "txt", F.get("n", F.lit(0)).alias("px"), F.get("n", F.lit(3)).alias("ph"))


@query("""
SELECT slide_id, level, nbytes, CASE WHEN nbytes < 1024 THEN nbytes || ' B' WHEN nbytes < 1048576 THEN printf('%.1f KB', nbytes / 1024.0) WHEN nbytes < 1073741824 THEN printf('%.1f MB', nbytes / 1048576.0) ELSE printf('%.1f GB', nbytes / 1073741824.0) END AS shown
FROM (SELECT slide_id, level, CAST(sum(nbytes) * 1024 + 512 AS BIGINT) AS nbytes FROM v_tiles GROUP BY slide_id, level UNION ALL SELECT slide_id, -1, slide_id FROM v_slides) q""")
def format_bytes(s: Slides) -> DataFrame:
    totals = s["v_tiles"].groupBy("slide_id", "level").agg((F.sum("nbytes") * 1024 + 512).cast("bigint").alias("nbytes"))
    rows = totals.union(s["v_slides"].select("slide_id", F.lit(-1).cast("bigint"), "slide_id"))
    return rows.select("slide_id", "level", "nbytes", X.format_bytes(F.col("nbytes")).alias("shown"))


@query("""
SELECT slide_id, level, CASE WHEN slide_id % 3 = 0 THEN 'P0/L' || level WHEN slide_id % 3 = 1 THEN 'P0' ELSE '' END || CASE WHEN n > 1 THEN CASE WHEN slide_id % 3 < 2 THEN ' ' ELSE '' END || '×' || n ELSE '' END AS locus
FROM (SELECT slide_id, level, (slide_id + level) % 4 AS n FROM v_levels) q""")
def locus(s: Slides) -> DataFrame:
    kind = F.col("slide_id") % 3
    pyramid, level = F.when(kind < 2, F.lit(0)), F.when(kind == 0, F.col("level"))
    return s["v_levels"].select("slide_id", "level", X.locus(pyramid, level, (F.col("slide_id") + F.col("level")) % 4).alias("locus"))


@query("""
SELECT slide_id, CASE WHEN slide_id % 4 = 0 AND slide_id % 3 > 0 THEN 'lossless, ' || (slide_id % 3) || ' layers' WHEN slide_id % 4 = 0 THEN 'lossless' WHEN slide_id % 3 > 0 THEN 'lossy, ' || (slide_id % 3) || ' layers'
       WHEN slide_id % 100 > 0 THEN 'Q≈' || (slide_id % 100) ELSE compression END AS quality FROM v_slides""")
def quality_text(s: Slides) -> DataFrame:
    i = F.col("slide_id")
    return s["v_slides"].select("slide_id", X.quality_text(i % 4 == 0, i % 3, i % 100, F.col("compression")).alias("quality"))


SIZES = "CASE slide_id % 6 WHEN 0 THEN 'off' WHEN 1 THEN (1 + slide_id % 9) || 'GB' WHEN 2 THEN (1 + slide_id % 9) || ' gib' WHEN 3 THEN (100 + slide_id % 9) || 'MB' WHEN 4 THEN CAST(512 + slide_id % 9 AS VARCHAR) ELSE 'much' END"


@query(f"""
SELECT slide_id, CAST(CASE slide_id % 6 WHEN 0 THEN 0 WHEN 1 THEN (1 + slide_id % 9) * 1000000000 WHEN 2 THEN (1 + slide_id % 9) * 1073741824 WHEN 3 THEN (100 + slide_id % 9) * 1000000 WHEN 4 THEN (512 + slide_id % 9) * 1048576 END AS BIGINT) AS nbytes FROM v_slides""")
def memory_sizes(s: Slides) -> DataFrame:
    rows = s["v_slides"].select("slide_id", F.expr(SIZES.replace("AS VARCHAR", "AS STRING")).alias("t"))
    return rows.select("slide_id", X.memory_bytes(F.col("t")).alias("nbytes"))


STANDARD = "[" + ", ".join(map(str, J.LUMINANCE)) + "]"
#: A quantisation table for each vector: the standard one scaled by its quality, disturbed by the vector's values.
QUANT = "greatest(1, least(255, CAST(floor((s * std + 50) / 100) AS BIGINT) + bump))"


@query(f"""
WITH t AS (SELECT vec_id, {STANDARD}[i] AS std, CASE WHEN (5 + vec_id % 95) < 50 THEN floor(5000 / (5 + vec_id % 95)) ELSE 200 - 2 * (5 + vec_id % 95) END AS s, CASE WHEN vec_id % 4 = 0 THEN i % 7 ELSE 0 END AS bump
           FROM embeddings JOIN (SELECT unnest(generate_series(1, 64)) AS i) k ON true),
     q AS (SELECT vec_id, std, {QUANT} AS q FROM t)
SELECT vec_id, CAST(greatest(1, least(100, CASE WHEN m >= 100 THEN floor(5000 / m + 0.5) ELSE floor((200 - m) / 2 + 0.5) END)) AS BIGINT) AS quality
FROM (SELECT vec_id, round(avg(q * 100.0 / std), 9) AS m FROM q GROUP BY vec_id) z""")
def jpeg_quality_estimate(s: Slides) -> DataFrame:
    return J.quant_tables(s["embeddings"]).select("vec_id", J.quality_estimate(F.col("table")).alias("quality"))


@query(f"""
WITH t AS (SELECT vec_id, {STANDARD}[i] AS std, CASE WHEN (5 + vec_id % 95) < 50 THEN floor(5000 / (5 + vec_id % 95)) ELSE 200 - 2 * (5 + vec_id % 95) END AS s, CASE WHEN vec_id % 4 = 0 THEN i % 7 ELSE 0 END AS bump
           FROM embeddings JOIN (SELECT unnest(generate_series(1, 64)) AS i) k ON true),
     q AS (SELECT vec_id, CAST({QUANT} AS DOUBLE) / std AS r FROM t)
SELECT vec_id, round(stddev_pop(r) / avg(r), 6) AS cv, stddev_pop(r) / avg(r) > 0.3 AS custom FROM q GROUP BY vec_id""")
def jpeg_table_cv(s: Slides) -> DataFrame:
    rows = J.quant_tables(s["embeddings"]).select("vec_id", J.variation(F.col("table")).alias("cv"))
    return rows.select("vec_id", F.round("cv", 6).alias("cv"), (F.col("cv") > 0.3).alias("custom"))


@query("""
SELECT slide_id, CASE WHEN c <> 1 THEN 'unknown' WHEN h = 1 AND v = 1 THEN '4:4:4' WHEN h = 2 AND v = 1 THEN '4:2:2' WHEN h = 2 AND v = 2 THEN '4:2:0' WHEN h = 4 AND v = 1 THEN '4:1:1' ELSE 'unknown' END AS chroma
FROM (SELECT slide_id, 1 + slide_id % 4 AS h, 1 + CAST(floor(slide_id / 4) AS BIGINT) % 2 AS v, CASE WHEN slide_id % 9 = 0 THEN 2 ELSE 1 END AS c FROM v_slides) q""")
def chroma_name(s: Slides) -> DataFrame:
    i = F.col("slide_id")
    return s["v_slides"].select("slide_id", J.chroma_name(i % 4 + 1, G.whole_div(i, 4) % 2 + 1, F.when(i % 9 == 0, 2).otherwise(1)).alias("chroma"))


@query("""
SELECT slide_id, 'a JPEG/RGB Q=' || (50 + slide_id % 50) || ';b Q=70' AS quality, CASE WHEN compression = 'jpeg2000' THEN 'a J2K/YUV16 Q=70;b Q=70' ELSE 'a JPEG/RGB Q=70;b Q=70' END AS codec FROM v_slides""")
def description_tokens(s: Slides) -> DataFrame:
    """The first quality and the codec of a geometry line swapped."""
    line = F.when(F.col("slide_id") % 2 == 0, "a JPEG/RGB Q=70;b Q=70").otherwise("a J2K/YUV16 Q=70;b Q=70")
    swapped = X.codec_swapped(line, F.col("compression"))
    quality = X.quality_swapped(X.codec_swapped(line, F.lit("jpeg")), 50 + F.col("slide_id") % 50)
    return s["v_slides"].select("slide_id", quality.alias("quality"), swapped.alias("codec"))


@query("""
SELECT rect_id, CASE WHEN rect_id % 9 > 0 THEN w END AS w, CASE WHEN rect_id % 9 > 0 THEN h END AS h,
       CASE WHEN rect_id % 7 > 0 THEN rect_id % 256 END AS r, CASE WHEN rect_id % 7 > 0 THEN w % 256 END AS g, CASE WHEN rect_id % 7 > 0 THEN h % 256 END AS b FROM v_rects""")
def sizes_and_colours(s: Slides) -> DataFrame:
    """Sizes as WxH and colours as #RRGGBB, read from their texts; some are broken."""
    size = F.when(F.col("rect_id") % 9 > 0, F.format_string("%dX%d", "w", "h")).when(F.col("rect_id") % 2 == 0, "12x").otherwise("ax3")
    hexed = F.format_string("%02x%02X%02x", F.col("rect_id") % 256, F.col("w") % 256, F.col("h") % 256)
    colour = F.when(F.col("rect_id") % 7 == 0, F.substring(hexed, 1, 5)).when(F.col("rect_id") % 2 == 0, F.concat(F.lit("#"), hexed)).otherwise(hexed)
    sides, rgb = X.size_numbers(size), X.colour_numbers(colour)
    return s["v_rects"].select("rect_id", *[F.get(sides, F.lit(k)).alias(n) for k, n in enumerate(("w", "h"))], *[F.get(rgb, F.lit(k)).alias(n) for k, n in enumerate(("r", "g", "b"))])
