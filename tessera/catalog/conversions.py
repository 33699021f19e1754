"""Queries that write containers, run plans or streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.codecs import encode, health
from tessera.fixtures import Slides
from tessera.plans import commands
from tessera.plans import convert as C
from tessera.plans import table as planner
from tessera.session import scratch
from tessera.sources import containers, deepzoom, dicom, slides, tiff
from tessera.streaming.strips import pyramid_stream

from .registry import query


@query(None)
def codec_health(s: Slides) -> DataFrame:
    """Whether each codec encodes a grey tile here."""
    return s.spark.createDataFrame(health(), "codec string, status string, nbytes int")


def whole_image(s: Slides) -> tuple[DataFrame, int, int]:
    """All vectors as one image of 64 columns, and its sides."""
    pixels = s["v_pixels"]
    width, height = pixels.agg(F.max("x") + 1, F.max("y") + 1).first()
    return pixels, width or 0, height or 0


def planned(s: Slides, to: str, codec: str, tile: int = 32) -> tuple[DataFrame, C.Plan, DataFrame]:
    """The image's tiles for a container, the plan, and the table of its levels."""
    pixels, width, height = whole_image(s)
    source = C.Source("generic-tiff", width, height, tile, "none", ((width, height),))
    p = C.plan(C.Request(to=to, codec=codec, tile=tile), source) if codec != "none" else C.Plan("engine", to, codec, {}, 1, tile, width, height, 0.5, 20.0)
    rows = [(i, w, h, p.tile, -(-w // p.tile), -(-h // p.tile)) for i, (_, w, h) in enumerate(C.output_levels(p))]
    return C.execute(p, pixels), p, s.spark.createDataFrame(rows, "level int, width int, height int, tile int, cols int, rows_ int")


def decoded(tiles: DataFrame, codec: str) -> DataFrame:
    """Tiles of one of the codecs that tell their own sides, as hashes of their RGB rows: level, col, row_, sha256."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        from tessera.codecs import decode

        for batch in batches:
            found = [hashlib.sha256(decode(codec, x.as_buffer().to_pybytes(), 0, 0).tobytes()).hexdigest() for x in batch.column(3)]
            yield pa.record_batch([*batch.columns[:3], pa.array(found)], names=["level", "col", "row_", "sha256"])

    return tiles.select("level", "col", "row_", "bytes").mapInArrow(run, "level int, col int, row_ int, sha256 string")


#: Levels of the image of 64 columns by halving, with its sides; enough of them for 2 ** 20 rows.
DEEP = 21
HALVED = """SELECT CAST(floor(x / 2) AS BIGINT) AS x, CAST(floor(y / 2) AS BIGINT) AS y,
  CAST(floor(sum(r * wt) / 4) AS INTEGER) AS r, CAST(floor(sum(g * wt) / 4) AS INTEGER) AS g, CAST(floor(sum(b * wt) / 4) AS INTEGER) AS b,
  max(CAST(ceil(width / 2) AS BIGINT)) AS width, max(CAST(ceil(height / 2) AS BIGINT)) AS height
FROM (SELECT *, (CASE WHEN x = width - 1 AND width % 2 = 1 THEN 2 ELSE 1 END) * (CASE WHEN y = height - 1 AND height % 2 = 1 THEN 2 ELSE 1 END) AS wt FROM {t} WHERE greatest(width, height) > {least}) q GROUP BY 1, 2"""
SIDES = "(SELECT max(x) + 1 AS width, max(y) + 1 AS height FROM v_pixels)"
OCTAVES = f"l0 AS (SELECT v_pixels.*, z.width, z.height FROM v_pixels, {SIDES} z), " + ", ".join(f"l{k + 1} AS ({HALVED.format(t=f'l{k}', least=1)})" for k in range(DEEP - 1))
EVERY = "every AS (" + " UNION ALL ".join(f"SELECT {k} AS octave, * FROM l{k}" for k in range(DEEP)) + ")"
ZOOMED = f"""
WITH {OCTAVES}, {EVERY}, top AS (SELECT max(octave) AS top FROM every), c AS (SELECT CAST(i AS BIGINT) AS i FROM (SELECT unnest(generate_series(0, (SELECT CAST(floor(max(y) / 32) AS BIGINT) FROM v_pixels))) AS i) z),
t AS (SELECT octave, cx.i AS col, cy.i AS row_, x, y, r, g, b FROM every JOIN c cx ON x >= cx.i * 32 - 1 AND x < cx.i * 32 + 33 AND cx.i <= floor((width - 1) / 32) JOIN c cy ON y >= cy.i * 32 - 1 AND y < cy.i * 32 + 33 AND cy.i <= floor((height - 1) / 32)),
h AS (SELECT octave, col, row_, sha256(unhex(string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY y, x))) AS sha256 FROM t GROUP BY ALL)"""


@query(f"{ZOOMED} SELECT CAST(top - octave AS INTEGER) AS level, CAST(col AS INTEGER) AS col, CAST(row_ AS INTEGER) AS row_, sha256 FROM h, top")
def dzi_write_roundtrip(s: Slides) -> DataFrame:
    """Tiles written as a Deep Zoom folder, from one pixel to the whole image, and read back: place and pixels of each."""
    deepzoom.register(s.spark)
    tiles, p, _ = planned(s, "dzi", "png")
    target = f"{scratch(s.spark, 'dzi')}/slide"
    tiles.write.format("deepzoom").mode("append").option("format", "png").option("tileSize", p.tile).option("overlap", p.overlap).option("width", p.width).option("height", p.height).save(target)
    return decoded(s.spark.read.format("deepzoom").load(target), "png")


@query(f"{ZOOMED} SELECT 'slide/slide_files/' || (top - octave) || '/' || col || '_' || row_ || '.png' AS name, sha256 FROM h, top")
def szi_write(s: Slides) -> DataFrame:
    """The tiles of a zipped Deep Zoom pyramid, read back from the zip by their places in it."""
    tiles, p, _ = planned(s, "szi", "png")
    target = f"{scratch(s.spark, 'szi')}/slide.szi"
    containers.write_szi(tiles, target, "slide", p.tile, p.overlap, "png", p.width, p.height, "<image/>")
    slide = slides.open_slide(target)
    top = len(slide.levels) - 1
    name = F.format_string("slide/slide_files/%d/%d_%d.png", top - F.col("level"), "col", "row_")
    return decoded(slides.read_tiles(s.spark, slide), "png").select(name.alias("name"), "sha256")


#: The two levels of 64 and 32 columns that a container of 32-pixel tiles has.
LEVELS = f"""SELECT * FROM (SELECT 0 AS ifd, width, height FROM {SIDES} z UNION ALL SELECT 1, CAST(ceil(width / 2) AS BIGINT), CAST(ceil(height / 2) AS BIGINT) FROM {SIDES} z) v"""
KINDS = ("tiff", "svs", "ome-tiff", "cog-wsi")


def written(s: Slides, kind: str) -> str:
    """The image as a container of uncompressed tiles; where it is."""
    tiles, p, levels = planned(s, kind, "none")
    folder = scratch(s.spark, "slides")
    if kind == "dicom":
        dicom.write_series(tiles, levels, f"{folder}/{kind}", "none", mpp=0.5)
        return f"{folder}/{kind}"
    text = "Aperio Image" if kind == "svs" else "<OME/>" if kind == "ome-tiff" else ""
    containers.write_tiff(tiles, levels, f"{folder}/{kind}.tiff", "none", kind=kind, order="hilbert" if kind == "cog-wsi" else "row-major", mpp=0.5, description=text)
    return f"{folder}/{kind}.tiff"


@query(f"""
SELECT k.kind, l.ifd, CASE WHEN k.kind = 'ome-tiff' AND l.ifd > 0 THEN 0 END AS parent, l.width, l.height, CAST(32 AS BIGINT) AS tile_w, CAST(32 AS BIGINT) AS tile_h, 'none' AS compression, CAST(2 AS BIGINT) AS photometric, k.kind = 'cog-wsi' AS has_private,
       CASE WHEN l.ifd = 0 AND k.kind = 'svs' THEN 'Aperio Image' WHEN l.ifd = 0 AND k.kind = 'ome-tiff' THEN '<OME/>' END AS description
FROM ({LEVELS}) l JOIN (VALUES ('tiff'), ('svs'), ('ome-tiff'), ('cog-wsi')) k(kind) ON true""")
def tiff_write_directories(s: Slides) -> DataFrame:
    """The directories of four kinds of TIFF files, read back."""
    found = [tiff.read_directories(s.spark, written(s, kind)).drop("path", "ifd_offset").withColumn("kind", F.lit(kind)) for kind in KINDS]
    return reduce(DataFrame.unionByName, found)


@query(f"SELECT k.kind, CAST(count(*) AS BIGINT) AS n_ifds, CAST(sum(CASE WHEN kind = 'cog-wsi' THEN 1 ELSE 0 END) AS BIGINT) AS n_tagged, kind = 'cog-wsi' AS has_tags FROM ({LEVELS}) l JOIN (VALUES ('tiff'), ('cog-wsi')) k(kind) ON true GROUP BY k.kind")
def has_wsi_tags(s: Slides) -> DataFrame:
    """Whether a file's directories have private tags, read from the files."""
    found = [tiff.read_directories(s.spark, written(s, kind)).withColumn("kind", F.lit(kind)) for kind in ("tiff", "cog-wsi")]
    return reduce(DataFrame.unionByName, found).groupBy("kind").agg(F.count(F.lit(1)).alias("n_ifds"), F.count_if("has_private").alias("n_tagged"), F.bool_or("has_private").alias("has_tags"))


@query(f"""
SELECT l.ifd, t.tag, t.name AS tag_name, t.type AS type_name, CAST(t.n AS BIGINT) AS n,
       CASE t.tag WHEN 256 THEN '[' || width || ']' WHEN 257 THEN '[' || height || ']' WHEN 258 THEN '[8, 8, 8]' WHEN 259 THEN '[1]' WHEN 262 THEN '[2]' WHEN 277 THEN '[3]' WHEN 322 THEN '[32]' WHEN 323 THEN '[32]' WHEN 305 THEN '"tessera"' WHEN 65080 THEN '"pyramid"'
         WHEN 65081 THEN '[' || l.ifd || ']' WHEN 65082 THEN '[2]' END AS value
FROM ({LEVELS}) l JOIN (VALUES (256, 'ImageWidth', 'LONG', 1), (257, 'ImageLength', 'LONG', 1), (258, 'BitsPerSample', 'SHORT', 3), (259, 'Compression', 'SHORT', 1), (262, 'PhotometricInterpretation', 'SHORT', 1), (277, 'SamplesPerPixel', 'SHORT', 1),
  (305, 'Software', 'ASCII', 8), (322, 'TileWidth', 'LONG', 1), (323, 'TileLength', 'LONG', 1), (65080, 'WSIImageType', 'ASCII', 8), (65081, 'WSILevelIndex', 'LONG', 1), (65082, 'WSILevelCount', 'LONG', 1)) t(tag, name, type, n) ON true""")
def typed_tag_values(s: Slides) -> DataFrame:
    """Tags of a cloud-optimised file by number, name, type and decoded value."""
    rows = tiff.read_entries(s.spark, written(s, "cog-wsi"))
    return rows.where(F.col("tag").isin(256, 257, 258, 259, 262, 277, 305, 322, 323, 65080, 65081, 65082)).select("ifd", "tag", "tag_name", "type_name", "n", "value")


TILE_BYTES = f"""
WITH l0 AS (SELECT v_pixels.*, z.width, z.height FROM v_pixels, {SIDES} z), l1 AS ({HALVED.format(t="l0", least=1)}),
every AS (SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1), dims AS (SELECT level, max(width) AS width, max(height) AS height FROM every GROUP BY level),
cx AS (SELECT CAST(i AS BIGINT) AS i FROM (SELECT unnest(generate_series(0, 63)) AS i) z), cy AS (SELECT CAST(i AS BIGINT) AS i FROM (SELECT unnest(generate_series(0, (SELECT max(y) + 32 FROM v_pixels))) AS i) z),
p AS (SELECT d.level, cx.i AS x, cy.i AS y, r, g, b FROM dims d JOIN cx ON cx.i < ceil(d.width / 32) * 32 JOIN cy ON cy.i < ceil(d.height / 32) * 32 JOIN every e ON e.level = d.level AND e.x = least(cx.i, d.width - 1) AND e.y = least(cy.i, d.height - 1)),
h AS (SELECT level, CAST(floor(x / 32) AS INTEGER) AS col, CAST(floor(y / 32) AS INTEGER) AS row_, sha256(unhex(string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY y, x))) AS sha256 FROM p GROUP BY ALL)"""


@query(f"{TILE_BYTES} SELECT k.kind, h.* FROM h JOIN (VALUES ('tiff'), ('svs'), ('ome-tiff'), ('cog-wsi'), ('dicom')) k(kind) ON true")
def slide_tiles_roundtrip(s: Slides) -> DataFrame:
    """The tiles of five kinds of slides, written and read back through the slide source by ranges of their files."""
    slides.register(s.spark)
    found = []
    for kind in (*KINDS, "dicom"):
        tiles = s.spark.read.format("slide").load(written(s, kind))
        found.append(tiles.select(F.lit(kind).alias("kind"), "level", "col", "row_", F.sha2("bytes", 256).alias("sha256")))
    return reduce(DataFrame.unionByName, found)


@query(f"""
SELECT k.kind, CASE k.kind WHEN 'tiff' THEN 'generic-tiff' ELSE k.kind END AS format, l.ifd AS level, l.width, l.height, 'none' AS compression FROM ({LEVELS}) l JOIN (VALUES ('tiff'), ('svs'), ('ome-tiff'), ('cog-wsi'), ('dicom')) k(kind) ON true""")
def slide_levels_roundtrip(s: Slides) -> DataFrame:
    """The format and the levels of five kinds of slides, as the slide source tells them."""
    slides.register(s.spark)
    found = []
    for kind in (*KINDS, "dicom"):
        path = written(s, kind)
        form = s.spark.read.format("slide").option("table", "slides").load(path).first()["format"]
        levels = s.spark.read.format("slide").option("table", "levels").load(path)
        found.append(levels.select(F.lit(kind).alias("kind"), F.lit(form).alias("format"), "level", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"), "compression"))
    return reduce(DataFrame.unionByName, found)


#: A region as a label: the hash of its bytes as it is, and upside down.
PATCH = "SELECT {side} AS type, sha256(unhex(string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY {order}))) AS sha256 FROM v_pixels WHERE x < 30 AND y < 20"
SIDE_KINDS = ("tiff", "svs", "ome-tiff", "cog-wsi", "dicom")


def with_sides(s: Slides, kind: str) -> str:
    """The image as a slide with a label in strips of 8 rows and a macro of one strip; where it is."""
    pixels, _, _ = whole_image(s)
    patch = commands.region(pixels, 0, 0, 30, 20)
    strips = tuple(encode("lzw", patch[y : y + 8]) for y in (0, 8, 16))
    sides = (containers.Side("label", 30, 20, "lzw", strips, 8), containers.Side("macro", 30, 20, "none", (patch[::-1].tobytes(),), 20))
    tiles, p, levels = planned(s, kind, "none")
    folder = scratch(s.spark, "sides")
    if kind == "dicom":
        dicom.write_series(tiles, levels, f"{folder}/{kind}", "none", mpp=0.5, sides=sides)
        return f"{folder}/{kind}"
    text = "Aperio Image" if kind == "svs" else "<OME/>" if kind == "ome-tiff" else ""
    containers.write_tiff(tiles, levels, f"{folder}/{kind}.tiff", "none", kind=kind, mpp=0.5, description=text, sides=sides)
    return f"{folder}/{kind}.tiff"


def side_hashes(s: Slides, kind: str, path: str) -> list[tuple[str, str, str]]:
    import hashlib

    return [(kind, a.type, hashlib.sha256(slides.side_pixels(a).tobytes()).hexdigest()) for a in slides.open_slide(path).associated]


SIDES_OUT = "kind string, type string, sha256 string"


@query(f"""
SELECT k.kind, p.* FROM ({PATCH.format(side="'label'", order="y, x")} UNION ALL {PATCH.format(side="'macro'", order="y DESC, x")}) p JOIN (VALUES ('tiff'), ('svs'), ('ome-tiff'), ('cog-wsi'), ('dicom')) k(kind) ON true""")
def side_images_roundtrip(s: Slides) -> DataFrame:
    """A slide's side images, written with five kinds of slides and read back from the files."""
    return s.spark.createDataFrame([r for kind in SIDE_KINDS for r in side_hashes(s, kind, with_sides(s, kind))], SIDES_OUT)


@query(f"""
SELECT k.kind, p.* FROM ({PATCH.format(side="'label'", order="y DESC, x")}) p JOIN (VALUES ('tiff'), ('svs'), ('ome-tiff'), ('cog-wsi')) k(kind) ON true""")
def side_images_edited(s: Slides) -> DataFrame:
    """The same files with the macro removed and the label replaced by one that is upside down."""
    pixels, _, _ = whole_image(s)
    patch = commands.region(pixels, 0, 0, 30, 20)
    found = []
    for kind in SIDE_KINDS[:-1]:
        path = with_sides(s, kind)
        commands.edit_associated(s.spark, path, f"{path}.removed", "macro")
        commands.edit_associated(s.spark, f"{path}.removed", f"{path}.replaced", "label", patch[::-1].copy())
        found += side_hashes(s, kind, f"{path}.replaced")
    return s.spark.createDataFrame(found, SIDES_OUT)


@query("""
WITH t AS (SELECT s.*, CASE WHEN slide_id % 2 = 1 THEN 2 ELSE 1 END AS factor FROM v_slides s),
     o AS (SELECT slide_id, bool_and(kw = kh AND kw >= 0 AND abs(ceil(w0 / pow(2, kw)) - width) <= 2 AND abs(ceil(h0 / pow(2, kw)) - height) <= 2) AND count(DISTINCT kw) = count(*) AS clean, list(kw) AS octaves FROM v_octaves GROUP BY slide_id),
     c AS (SELECT t.*, k.container, o.clean, o.octaves,
                  CASE k.container WHEN 'tiff' THEN compression IN ('jpeg', 'jpeg2000', 'htj2k', 'avif', 'webp', 'jpegxl') WHEN 'svs' THEN compression IN ('jpeg', 'jpeg2000', 'htj2k', 'avif', 'webp', 'jpegxl') ELSE compression IN ('jpeg', 'png') END AS holds,
                  format IN ('svs', 'philips-tiff', 'ome-tiff', 'bif', 'ife', 'generic-tiff', 'cog-wsi', 'dicom', 'szi') AS tiled
           FROM t JOIN o ON o.slide_id = t.slide_id JOIN (VALUES ('tiff'), ('svs'), ('dzi')) k(container) ON true),
     d AS (SELECT *, CASE WHEN holds THEN compression WHEN container = 'dzi' THEN 'png' ELSE 'jpeg' END AS codec FROM c),
     e AS (SELECT *, container = 'svs' AND codec NOT IN ('jpeg', 'jpeg2000') AS refused,
                  tiled AND factor = 1 AND (container = 'tiff' AND compression IN ('jpeg', 'jpeg2000', 'htj2k', 'avif', 'webp', 'jpegxl') OR container = 'svs' AND compression IN ('jpeg', 'jpeg2000')) AS copied,
                  clean AND tiled AND list_contains(octaves, factor - 1) AS by_octaves FROM d)
SELECT slide_id, container AS target, CASE WHEN refused THEN 'refused' WHEN copied THEN 'copy' WHEN by_octaves THEN 'octaves' ELSE 'engine' END AS how, codec, CAST(floor(width / factor) AS BIGINT) AS width, CAST(floor(height / factor) AS BIGINT) AS height, mpp * factor AS mpp FROM e""")
def convert_plans(s: Slides) -> DataFrame:
    """How every slide goes to three targets, odd ones reduced by 2, or that it is refused."""
    odd = F.when(F.col("slide_id") % 2 == 1, 2).otherwise(1)
    return planner.planned(s["v_slides"].withColumn("factor", odd), s["v_octaves"], ("tiff", "svs", "dzi"))


STREAMED = f"WITH img AS (SELECT *, 64 AS width, 1000000000 AS height FROM v_pixels), l1 AS ({HALVED.format(t='img', least=1)}), l2 AS ({HALVED.format(t='l1', least=1)}) SELECT CAST(floor(y / 2) AS BIGINT) AS band, 1 AS level, x, y, r, g, b FROM l1 UNION ALL SELECT y, 2, x, y, r, g, b FROM l2"


@query(STREAMED)
def strip_stream_pyramid(s: Slides) -> DataFrame:
    """Two levels of the raster from a stream of its rows: the table's files are read as they come, all that are there.

    The raster has no known end, so below the last row, and where a row is missing, it is black."""
    there = F.size("embedding") > 0
    due = s["embeddings"].where(there).groupBy(F.floor(F.col("vec_id") / 4).cast("long").alias("band")).agg(F.count(F.lit(1)).alias("due"))
    schema = T.StructType([f for f in s["embeddings"].schema.fields])
    stream = s.spark.readStream.schema(schema).parquet(f"{s.sf_dir}/embeddings.parque[t]")

    def channel(k: int):
        return F.transform("embedding", lambda v: F.pmod(F.floor(v.cast("double") * k), F.lit(256)).cast("int"))

    channels = [channel(k) for k in (1000, 3000, 7000)]
    rows = stream.where(there).select(F.col("vec_id").alias("y"), *[c.alias(n) for c, n in zip(channels, "rgb", strict=True)])
    folder = scratch(s.spark, "stream")
    run = pyramid_stream(rows, None, 2, due).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.spark.read.schema("band long, level int, x long, y long, r int, g int, b int").parquet(f"{folder}/out")
