"""What a user of slides asks for, each as one call: inspect, hash, validate, read a region, edit, convert."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import codecs
from tessera.codecs.jpeg import SAMPLINGS
from tessera.functions import codes
from tessera.functions import text as X
from tessera.operators import audit, directories, edit, gates, levels, pyramid
from tessera.plans.convert import Plan, Refused, Request, Source, cropped, execute, octaves_of, output_levels, plan
from tessera.sources import bif, containers, deepzoom, dicom, files, slides, splice, tiff


def info(slides: DataFrame, level_rows: DataFrame) -> DataFrame:
    """Facts of each slide with its levels as one array, finest first; unknown pixel sizes and magnifications are null."""
    shape = levels.level_table(level_rows).groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("level", "width", "height", "cols", "rows_", "scale"))).alias("levels"))
    unknown = [F.nullif(c, F.lit(0.0)).alias(c) for c in ("mpp", "magnification")]
    return slides.join(shape, "slide_id", "left").select("slide_id", "format", "make", "model", "width", "height", "compression", *unknown, "levels")


def dump_directories(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    return tiff.read_entries(spark, path, full)


def classified(ifds: DataFrame, level_rows: DataFrame, associated: DataFrame) -> DataFrame:
    return directories.classify(ifds, level_rows, associated)


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of whole files: path, nbytes, sha256."""
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", F.col("length").alias("nbytes"), F.sha2("content", 256).alias("sha256"))


def hash_pixels(pixels: DataFrame, tile: int) -> DataFrame:
    """SHA-256 over the tiles' hashes in raster order: one for an image on one tile grid."""
    tiles = pyramid.tile_hashes(pixels, tile)
    ordered = F.array_sort(F.collect_list(F.struct("row_", "col", "sha256")))
    return tiles.agg(F.sha2(F.array_join(F.transform(ordered, lambda t: t["sha256"]), ""), 256).alias("sha256"))


def validate(slides: DataFrame, level_rows: DataFrame, codec: str = "jpeg") -> DataFrame:
    return audit.verdicts(audit.metadata(slides), audit.codecs(level_rows, F.lit(codec)))


def region(pixels: DataFrame, x: int, y: int, w: int, h: int, most: int = 1 << 24) -> np.ndarray:
    """A rectangle as an array, white outside the image. It reaches the driver, so it has at most `most` pixels."""
    if w <= 0 or h <= 0 or w * h > most:
        raise Refused(f"a region has 1 to {most} pixels")
    out = np.full((h, w, 3), 255, np.uint8)
    found = pyramid.read_region(pixels, x, y, w, h, white=None).toArrow()
    out[found.column("y").to_numpy() - y, found.column("x").to_numpy() - x] = np.stack([found.column(c).to_numpy() for c in "rgb"], 1)
    return out


def region_png(pixels: DataFrame, target: str, x: int, y: int, w: int, h: int) -> int:
    return files.put(target, [codecs.encode("png", region(pixels, x, y, w, h))])


def extract(associated: DataFrame, slide_id: int, kind: str) -> bytes:
    """The bytes of a slide's side image; an error that lists what there is for an unknown one."""
    own = associated.where(F.col("slide_id") == slide_id)
    row = own.where(F.col("type") == kind).select("bytes").first()
    if row is None:
        there = sorted(r.type for r in own.select("type").distinct().collect())
        raise Refused(f"no {kind}; there are: {', '.join(there) or 'none'}")
    return bytes(row.bytes)


def remove_associated(associated: DataFrame, kind: str) -> DataFrame:
    return edit.remove(associated, kind)


def replace_associated(associated: DataFrame, new: DataFrame) -> DataFrame:
    return edit.replace(associated, new)


def doctor(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(codecs.health(), "codec string, status string, nbytes int")


def edited_name(path: str, taken: set[str]) -> str:
    """<stem>_edited<suffix>, with a number from 2 where that is taken."""
    stem, dot, suffix = path.rpartition(".")
    stem, end = (stem, dot + suffix) if dot and "/" not in suffix else (path, "")
    name, n = f"{stem}_edited{end}", 2
    while name in taken:
        name, n = f"{stem}_edited_{n}{end}", n + 1
    return name


def description(p: Plan, source: Source) -> str:
    """An Aperio-shaped description of the output; facts that are unknown are left out."""
    shape = f"{p.width}x{p.height} ({p.tile}x{p.tile}) {'J2K/YUV16' if p.codec == 'jpeg2000' else 'JPEG/RGB'} Q={p.quality.get('q', '85')}"
    facts = [f"|AppMag = {p.magnification:g}"] * (p.magnification > 0) + [f"|MPP = {p.mpp:g}"] * (p.mpp > 0)
    return f"Aperio Image, {X.SOFTWARE} (from {source.format})\r\n{shape}{''.join(facts)}"


def ome_xml(p: Plan, levels: int) -> str:
    """The smallest OME description of one image: sides, samples, pixel size where it is known."""
    size = f' PhysicalSizeX="{p.mpp:g}" PhysicalSizeY="{p.mpp:g}"' if p.mpp > 0 else ""
    pixels = f'<Pixels ID="Pixels:0" DimensionOrder="XYCZT" Type="uint8" SizeX="{p.width}" SizeY="{p.height}" SizeC="3" SizeZ="1" SizeT="1" Interleaved="true"{size}>'
    return f'<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="Image:0">{pixels}<Channel ID="Channel:0:0" SamplesPerPixel="3"/><TiffData IFD="0" PlaneCount="1"/></Pixels></Image></OME>'


def properties_xml(p: Plan, source: Source) -> str:
    """Scan properties, one for each fact that is known."""
    facts = {"ImageWidth": p.width, "ImageHeight": p.height, "TileSize": p.tile, "SourceFormat": source.format, "MicronsPerPixel": f"{p.mpp:g}" if p.mpp > 0 else "", "Magnification": f"{p.magnification:g}" if p.magnification > 0 else ""}
    rows = "".join(f'<property name="{k}" value="{v}"/>' for k, v in facts.items() if v != "")
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<image xmlns="http://www.pathozoom.com/szi" version="1.0"><properties>{rows}</properties></image>'


def convert(request: Request, source: Source, pixels: DataFrame | None, target: str, tiles: DataFrame | None = None, look: containers.Look | None = None, sides: tuple[containers.Side, ...] = (), made: Plan | None = None) -> Plan:
    """Plan, run and write a conversion to one container under `target`; the plan that was carried out.

    `look` tells how copied tiles are to be read; encoded ones tell it themselves. Side images that the container does
    not take are left out with a warning in the plan.
    """
    spark = (tiles if pixels is None else pixels).sparkSession
    p = made or plan(request, source)
    shape = output_levels(p)
    if p.how == "copy":
        shape = [(i, w, h) for i, (w, h) in enumerate(source.levels or ((source.width, source.height),))]
    rows = [(i, w, h, p.tile, -(-w // p.tile), -(-h // p.tile)) for i, (_, w, h) in enumerate(shape)]
    table = spark.createDataFrame(rows, "level int, width int, height int, tile int, cols int, rows_ int")
    out = execute(p, pixels, tiles)
    look = look or containers.Look()
    if p.how != "copy":
        sampling = SAMPLINGS[p.quality.get("ss", "4:2:0")] if p.codec == "jpeg" else None
        look = replace(look, photometric=None, tables=b"", subsampling=sampling)
    look = replace(look, mpp=(p.mpp, p.mpp), magnification=p.magnification, source_format=source.format)
    if request.no_associated:
        sides = ()
    allowed = gates.COG_TYPES if p.to == "cog-wsi" else codes.ASSOCIATED_TYPES
    left_out = tuple(f"left out: type {x.type}" for x in sides if x.type not in allowed)
    sides = tuple(x for x in sides if x.type in allowed)
    p = replace(p, warnings=p.warnings + left_out)
    if p.to in ("tiff", "svs", "ome-tiff", "cog-wsi"):
        text = description(p, source) if p.to == "svs" else ome_xml(p, len(rows)) if p.to == "ome-tiff" else ""
        containers.write_tiff(out, table, target, p.codec, kind=p.to, description=text, order=request.order, mpp=p.mpp, look=look, sides=sides)
    elif p.to in ("dzi", "szi"):
        if p.to == "dzi":
            deepzoom.register(spark)
            out.write.format("deepzoom").mode("append").option("format", p.codec).option("tileSize", p.tile).option("overlap", p.overlap).option("width", p.width).option("height", p.height).save(target)
        else:
            containers.write_szi(out, target, "slide", p.tile, p.overlap, p.codec, p.width, p.height, properties_xml(p, source))
        for side in sides:  # beside the pyramid, as PNG files
            files.put(f"{target.removesuffix('.szi')}_associated/{side.type}.png", [codecs.encode("png", side_rgb(side))])
    elif p.to == "ife":
        facts = {"source-format": source.format, "writer": "tessera", "scanner-make": look.make, "scanner-model": look.model}
        containers.write_ife(out, table, target, p.codec, look, sides, {k: v for k, v in facts.items() if v})
    elif p.to == "bif":
        shown = next((side_rgb(x) for x in sides if x.type in gates.OVERVIEW_TYPES), None)
        tissue = None if shown is not None else coarsest(pixels, p)
        bif.write_bif(out, table, target, bif.overview(shown, tissue), p.magnification or 20.0, p.mpp or 0.465, look.subsampling or (2, 2))
    elif p.to == "dicom":
        dicom.write_series(out, table, target, p.codec, mpp=p.mpp, sides=sides, facts={"make": look.make, "model": look.model})
    else:
        raise Refused(f"no writer for {p.to} here")
    return p


def coarsest(pixels: DataFrame | None, p: Plan, most: int = 2048) -> np.ndarray | None:
    """The image reduced until its longer side is at most `most`: it reaches the driver."""
    if pixels is None:
        return None
    step = max(0, (max(p.width, p.height) - 1).bit_length() - most.bit_length() + 1)
    image = cropped(p, pixels)
    if step:
        image = pyramid.pyramid(image, step).where(F.col("level") == step)
    return region(image.select("x", "y", "r", "g", "b"), 0, 0, -(-p.width // (1 << step)), -(-p.height // (1 << step)))


def side_rgb(side: containers.Side) -> np.ndarray:
    """A side image's pixels: strips one below the other, differences undone."""
    rows, y, out = side.rows_per_strip or side.height, 0, []
    for raw in side.strips:
        h = min(rows, side.height - y)
        rgb = codecs.decode(side.codec, raw, side.width, h, side.tables or None)
        out.append(np.cumsum(rgb, 1, dtype=np.uint8) if side.predictor == 2 else rgb)
        y += h
    return np.concatenate(out)


def faithful_sides(slide: slides.Slide) -> tuple[containers.Side, ...]:
    """Side images as they are in the file: strips, predictor, tables."""
    return tuple(containers.Side(a.type, a.width, a.height, a.codec, slides.side_bytes(a), a.rows_per_strip, a.predictor, a.photometric, a.tables, a.subsampling) for a in slide.associated)


def source_of(slide: slides.Slide) -> Source:
    """What the planner must know of a slide."""
    v = slide.levels[0]
    square = v.tile_w if v.tile_w == v.tile_h else 0
    return Source(slide.format.removesuffix("-overlapping"), v.width, v.height, square, v.codec, tuple((x.width, x.height) for x in slide.levels), slide.magnification, slide.mpp, slide.format.endswith("-overlapping"))


def look_of(slide: slides.Slide) -> containers.Look:
    v = slide.levels[0]
    return containers.Look(v.photometric, v.subsampling, v.tables, slide.icc, slide.format, (slide.mpp, slide.mpp), slide.magnification, slide.make, slide.model)


def convert_file(spark: SparkSession, request: Request, path: str, target: str) -> Plan:
    """A slide's file converted to another: copied, or decoded, reduced and encoded, with its side images.

    Where the source has the reduced size as a level of its own, that is what is decoded.
    """
    slide = slides.open_slide(path)
    source, look, sides = source_of(slide), look_of(slide), faithful_sides(slide)
    p = plan(request, source)
    if p.how == "copy":
        return convert(request, source, None, target, slides.read_tiles(spark, slide), look, sides, p)
    if p.how == "lossless-crop":
        return convert(request, source, slides.read_pixels(spark, slide), target, slides.read_tiles(spark, slide, [0]), look, sides, p)
    shift = p.factor.bit_length() - 1
    octaves = octaves_of(source) or ()
    if p.how == "octaves" and shift in octaves:
        v = slide.levels[octaves.index(shift)]
        pixels = slides.read_pixels(spark, slide, octaves.index(shift))
        return convert(request, source, pixels.where((F.col("x") < p.width) & (F.col("y") < p.height)), target, None, look, sides, replace(p, factor=1, width=min(p.width, v.width), height=min(p.height, v.height)))
    return convert(request, source, slides.read_pixels(spark, slide), target, None, look, sides, p)


#: Formats of sources and the containers of the same kind.
SAME = gates.REDUCED_TARGETS


def transcode(spark: SparkSession, path: str, target: str, codec: str, quality: str = "", allow_nonconformant: bool = False) -> Plan:
    """The same container and geometry in another codec."""
    if not codec:
        raise Refused("a codec must be given")
    form = slides.open_slide(path).format
    if form not in SAME:
        raise Refused(f"{form} is not written here")
    return convert_file(spark, Request(to=SAME[form], codec=codec, quality=quality, allow_nonconformant=allow_nonconformant), path, target)


def downsample(spark: SparkSession, path: str, target: str, factor: int = 1, target_magnification: float = 0.0) -> Plan:
    """The same container, smaller by a factor of 2, 4, 8 or 16 or to a magnification."""
    form = slides.open_slide(path).format
    if form not in SAME:
        raise Refused(f"{form} has no target for a reduced slide")
    if factor == 1 and not target_magnification:
        raise Refused("a factor or a magnification must be given")
    return convert_file(spark, Request(to=SAME[form], factor=factor, target_magnification=target_magnification), path, target)


def crop(spark: SparkSession, path: str, target: str, rect: tuple[int, int, int, int], lossless: bool = False) -> Plan:
    form = slides.open_slide(path).format
    if form not in SAME:
        raise Refused(f"{form} is not written here")
    return convert_file(spark, Request(to=SAME[form], rect=rect, lossless=lossless), path, target)


def rect_of(rect: str = "", x: int | None = None, y: int | None = None, w: int | None = None, h: int | None = None) -> tuple[int, int, int, int]:
    """A rectangle given as "X,Y,W,H" or by its four parts, not both; its sides are positive."""
    each = {"x": x, "y": y, "w": w, "h": h}
    if rect and any(v is not None for v in each.values()):
        raise Refused("a rectangle is given as a whole or by its parts, not both")
    if rect:
        try:
            found = tuple(int(v.strip()) for v in rect.split(","))
        except ValueError as error:
            raise Refused(f"{rect!r} holds no four integers") from error
        if len(found) != 4:
            raise Refused(f"{rect!r} holds no four integers")
    else:
        missing = [k for k, v in each.items() if v is None]
        if missing:
            raise Refused(f"missing: {', '.join(missing)}")
        found = tuple(each.values())
    if found[2] <= 0 or found[3] <= 0:
        raise Refused("the sides must be positive")
    return found


def edit_associated(spark: SparkSession, path: str, target: str, kind: str, rgb: np.ndarray | None = None) -> str:
    """A slide's file without its side image of a kind, or with another in its place or added; how it was done.

    A spliced file keeps its bytes up to the edit. Files with sub-directories, and those whose earlier directories have
    data behind the edit, are built anew from their own tiles, strips and tables.
    """
    slide = slides.open_slide(path)
    if slide.format not in gates.EDITED_FORMATS:
        raise Refused(f"side images of {slide.format} are not edited")
    if kind not in codes.ASSOCIATED_TYPES:
        raise Refused(f"{kind} is no side image; there are: {', '.join(codes.ASSOCIATED_TYPES)}")
    there = [a.type for a in slide.associated]
    if rgb is None and kind not in there:
        raise Refused(f"no {kind}; there are: {', '.join(there) or 'none'}")
    new = None if rgb is None else new_side(kind, rgb)
    data = files.Ranged(path)
    try:
        try:
            number = directory_of(data, slide, kind)
            entries = side_rows(data, new, slide.format) if new else None
            splice.splice_file(path, target, len(there) + len(slide.levels) if number is None else number, "remove" if new is None else "insert" if number is None else "replace", entries, list(new.strips) if new else None)
            return "spliced"
        except (splice.Interleaved, ValueError) as why:
            if isinstance(why, ValueError) and not isinstance(why, splice.Interleaved) and "sub-directories" not in str(why):
                raise
    finally:
        data.close()
    kept = [s if s.type != kind else new for s in faithful_sides(slide)] + ([new] if new and kind not in there else [])
    source = source_of(slide)
    to = SAME[slide.format]
    p = Plan("copy", to, source.codec, {}, 1, source.tile, source.width, source.height, source.mpp, source.magnification)
    convert(Request(to=to), source, None, target, slides.read_tiles(spark, slide), look_of(slide), tuple(s for s in kept if s), p)
    return "rebuilt"


def new_side(kind: str, rgb: np.ndarray) -> containers.Side:
    """A side image of RGB rows: labels without loss, others as JPEG."""
    codec = "lzw" if kind == "label" else "jpeg"
    h, w, _ = rgb.shape
    return containers.Side(kind, w, h, codec, (codecs.encode(codec, rgb),), h, subsampling=(2, 2) if codec == "jpeg" else None)


def side_rows(data, side: containers.Side, form: str) -> list[tuple]:
    """The entries of a new side image's directory, in the form and byte order of the file."""
    head = tiff.read_header(data)
    kind = "svs" if form == "svs" else "cog-wsi" if form == "cog-wsi" else "tiff"
    e = containers.side_entries(head.big, kind, side, [0] * len(side.strips), containers.Look())
    return [(tag, k, n, tiff.decoded(raw, k, n, "<")) for tag, (k, n, raw) in sorted(e.rows.items())]


def directory_of(data, slide: slides.Slide, kind: str) -> int | None:
    """The number of a side image's directory in the chain, found by where its first strip is."""
    wanted = next((a.places[0][1] for a in slide.associated if a.type == kind), None)
    for number, parent, _, entries in tiff.walk(data):
        if parent is not None:
            raise ValueError("sub-directories are not edited")
        values = {t: v for t, _, _, v in entries}
        if wanted is not None and values.get(273, [None])[0] == wanted:
            return number
    return None


def read_image(spark: SparkSession, path: str, most: int = 1 << 26) -> np.ndarray:
    """A picture file (PNG, JPEG, BMP, GIF) as RGB rows, decoded by Spark's own reader; at most `most` pixels."""
    row = spark.read.format("image").option("dropInvalid", True).load(path).select("image.height", "image.width", "image.nChannels", "image.data").first()
    if row is None:
        raise Refused(f"{path} is no picture")
    if row.height * row.width > most:
        raise Refused(f"the picture has more than {most} pixels")
    raw = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
    return np.repeat(raw, 3, 2) if row.nChannels == 1 else np.ascontiguousarray(raw[..., 2::-1])  # kept as blue, green, red


def rendered(df: DataFrame, as_json: bool = False, most: int = 1000) -> str:
    """A small table as JSON lines or as text in columns."""
    rows = df.limit(most)
    if as_json:
        return "\n".join(rows.toJSON().collect()) if hasattr(rows, "toJSON") else ""
    found = [[("" if v is None else str(v)) for v in r] for r in rows.collect()]
    width = [max(map(len, column)) for column in zip(df.columns, *found, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in [df.columns, *found])


def progress(done: int, total: int, seconds: float) -> tuple[float, float, float]:
    """Per cent done, tiles a second and seconds left, by the mean rate so far."""
    rate = done / seconds if seconds > 0 else 0.0
    return 100.0 * done / total if total else 100.0, rate, (total - done) / rate if rate else float("inf")
