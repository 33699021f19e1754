"""Slide files as relations: what a path holds, its levels, its tiles, its side images, read by ranges.

A file's structure is a few kilobytes, which the driver reads; tiles are a table of places (file, offset, bytes), dealt to
tasks, and tasks read only the ranges of their tiles. Kinds: TIFF (generic, svs, ome-tiff, cog-wsi), a folder or file of
whole-slide DICOM instances, the layered tile format, and Deep Zoom pyramids in a zip.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.codes import COMPRESSION_NAMES, IMAGE_TYPES, SYNTAXES
from tessera.shipping import ship

from .containers import IMAGE_ENCODINGS, MAGIC, NULL_BLOCK, NULL_OFFSET, TILE_ENCODINGS, parse_ghost
from .dicom import LONG_FORMS
from .files import Ranged, listed
from .tiff import read_header, unpack, walk


class NotASlide(ValueError):
    """A path that holds no slide, or one that cannot be opened."""


class AmbiguousSeries(NotASlide):
    """A folder with several series: the message lists them."""


@dataclass(frozen=True)
class Level:
    level: int
    width: int
    height: int
    tile_w: int
    tile_h: int
    codec: str
    places: list = field(repr=False)  # (file, offset, bytes) by raster place; 0 bytes where there is none
    tables: bytes = field(default=b"", repr=False)
    photometric: int = 2
    subsampling: tuple[int, int] | None = None

    @property
    def cols(self) -> int:
        return -(-self.width // self.tile_w)

    @property
    def rows(self) -> int:
        return -(-self.height // self.tile_h)


@dataclass(frozen=True)
class Associated:
    type: str
    width: int
    height: int
    codec: str
    places: list = field(repr=False)
    rows_per_strip: int = 0
    predictor: int = 1
    photometric: int = 2
    tables: bytes = field(default=b"", repr=False)
    subsampling: tuple[int, int] | None = None


@dataclass(frozen=True)
class Slide:
    path: str
    format: str
    levels: tuple[Level, ...]
    associated: tuple[Associated, ...] = ()
    mpp: float = 0.0
    magnification: float = 0.0
    make: str = ""
    model: str = ""
    description: str = ""
    icc: bytes = field(default=b"", repr=False)


def checked(slide: Slide) -> Slide:
    """Refuses a slide without a level, or with one that has no tile."""
    if not slide.levels:
        raise NotASlide(f"{slide.path} has no tiled image")
    for v in slide.levels:
        if min(v.width, v.height, v.tile_w, v.tile_h) < 1 or len(v.places) != v.cols * v.rows:
            raise NotASlide(f"level {v.level} of {slide.path} has no tiles or not one for each place")
    return slide


def open_slide(path: str) -> Slide:
    """The slide at a URI: kind by its first bytes; a folder is a series of DICOM instances."""
    files = listed(path)
    if not files:
        raise NotASlide(f"{path} is empty")
    if files != [path]:
        return checked(dicom_slide(path, [f for f in files if f.endswith(".dcm")]))
    data = Ranged(path)
    try:
        if data[:2] in (b"II", b"MM"):
            return checked(tiff_slide(path, data))
        if data[128:132] == b"DICM":
            return checked(dicom_slide(path, [path]))
        if data[:4] == struct.pack("<I", MAGIC):
            return checked(layered_slide(path, data))
        if data[:4] == b"PK\3\4":
            return checked(zipped_slide(path, data))
    finally:
        data.close()
    raise NotASlide(f"{path} is of no known kind")


def decimal(text: str, pattern: str) -> float:
    found = re.search(pattern, text)
    return float(found[1]) if found else 0.0


def side_type(values: dict, number: int, named: str) -> str:
    """The type of an image that is no level: its private tag, words of its description, its subfile type, its place."""
    if named in IMAGE_TYPES:
        return named
    words = str(values.get(270, "")).lower()
    for kind in ("label", "macro", "thumbnail", "overview", "probability", "map"):
        if kind in words:
            return kind
    sub = (values.get(254) or [0])[0]
    return {1: "label", 9: "macro"}.get(sub, "thumbnail" if number == 1 else "associated")


def tiff_slide(path: str, data: Ranged) -> Slide:
    """Tiled directories are levels, the finest first; the others, and those that a private tag names otherwise, side images."""
    head = read_header(data)
    levels, sides, first, top = [], [], {}, {}
    for number, _, _, entries in walk(data):
        values = {t: v for t, _, _, v in entries}
        if number == 0:
            first = values
        private = str(values.get(65080, ""))
        codec = COMPRESSION_NAMES.get(values.get(259, [1])[0], f"tag-{values.get(259, [1])[0]}")
        tables = bytes(values.get(347, b""))
        sampling = tuple(values[530]) if 530 in values else None
        width, height = values[256][0], values[257][0]
        photometric = values.get(262, [2])[0]
        if 324 in values and private in ("", "pyramid"):
            places = [(path, a, n) for a, n in zip(values[324], values[325], strict=True)]
            levels.append(Level(0, width, height, values[322][0], values[323][0], codec, places, tables, photometric, sampling))
            top = top or values
        elif 273 in values:
            places = [(path, a, n) for a, n in zip(values[273], values[279], strict=True)]
            sides.append(Associated(side_type(values, number, private), width, height, codec, places, values.get(278, [height])[0], values.get(317, [1])[0], photometric, tables, sampling))
    levels.sort(key=lambda v: -v.width)
    text = str(first.get(270, ""))
    ghost = parse_ghost(data[16 if head.big else 8 :][:4096].split(b"\0")[0]) if data[16 if head.big else 8 :][:28].startswith(b"GDAL_STRUCTURAL_METADATA") else {}
    bif = next((str(e[3]) for _, _, _, entries in walk(data) for e in entries if e[0] == 270 and str(e[3]).startswith("level=")), "") if b"<iScan" in bytes(first.get(700, b"") if isinstance(first.get(700, b""), bytes) else bytes(first.get(700, []))) else ""
    if bif:
        text = text or bif
    kind = "bif" if bif else "cog-wsi" if "COG_WSI_VERSION" in ghost else "svs" if text.startswith("Aperio") else "ome-tiff" if "<OME" in text else "generic-tiff"
    mpp = (top.get(65085) or [0.0])[0] or decimal(text, r"MPP\s*=\s*([0-9.]+)")
    if not mpp and 282 in first and (first.get(296) or [2])[0] == 3:
        a, b = map(int, first[282][0].split("/"))
        mpp = 10000 * b / a if a else 0.0
    magnification = (top.get(65087) or [0.0])[0] or decimal(text, r"AppMag\s*=\s*([0-9.]+)")
    return Slide(path, kind, tuple(replace(v, level=i) for i, v in enumerate(levels)), tuple(sides), mpp, magnification, str(first.get(271, "")), str(first.get(272, "")), text, bytes(first.get(34675, b"")))


def dicom_elements(data: Ranged) -> tuple[dict, int, int]:
    """Elements before the pixel data (sequences as bytes), where its value begins, and its length, 0xFFFFFFFF if in items."""
    at, out = 132, {}
    while at < len(data):
        group, number, vr = unpack("<HH2s", data, at)
        if vr.decode("latin1") in LONG_FORMS:
            size, at = unpack("<I", data, at + 8)[0], at + 12
        else:
            size, at = unpack("<H", data, at + 6)[0], at + 8
        if (group, number) == (0x7FE0, 0x10):
            return out, at, size
        out[group, number] = data[at : at + size]
        at += size
    raise NotASlide("an instance without pixel data")


def dicom_frames(path: str, data: Ranged, at: int, size: int, frames: int) -> list[tuple[str, int, int]]:
    if size != 0xFFFFFFFF:
        each = size // frames
        return [(path, at + i * each, each) for i in range(frames)]
    at += 8 + unpack("<I", data, at + 4)[0]  # the offset table
    out = []
    for _ in range(frames):
        n = unpack("<I", data, at + 4)[0]
        out.append((path, at + 8, n))
        at += 8 + n
    return out


def dicom_slide(path: str, files: list[str]) -> Slide:
    """The levels of one series, the finest first; instances of another image type are side images."""
    codec_of = {uid: codec for (codec, _), (uid, _) in SYNTAXES.items()}
    levels, sides, series, mpp = [], [], {}, 0.0
    for name in files:
        data = Ranged(name)
        if data[128:132] != b"DICM":
            continue
        values, at, size = dicom_elements(data)

        def text(group: int, number: int) -> str:
            return values.get((group, number), b"").rstrip(b"\0 ").decode()  # noqa: B023

        series.setdefault(text(0x20, 0xE), name)
        codec = codec_of.get(text(2, 0x10), "none")
        frames, (tile_h,), (tile_w,) = int(text(0x28, 8) or 1), struct.unpack("<H", values[0x28, 0x10]), struct.unpack("<H", values[0x28, 0x11])
        places = dicom_frames(name, data, at, size, frames)
        photometric = 6 if text(0x28, 4).startswith("YBR") else 2
        flavour = text(8, 8).split("\\")
        if len(flavour) > 2 and flavour[2] in ("LABEL", "OVERVIEW", "THUMBNAIL"):
            sides.append(Associated({"OVERVIEW": "macro"}.get(flavour[2], flavour[2].lower()), tile_w, tile_h, codec, places, tile_h, 1, photometric))
            continue
        width, height = (struct.unpack("<I", values[0x48, k])[0] for k in (6, 7))
        levels.append(Level(0, width, height, tile_w, tile_h, codec, places, b"", photometric))
        spacing = re.search(rb"([0-9.eE+-]+)\\", values.get((0x5200, 0x9229), b""))
        if spacing and (not mpp or width == max(v.width for v in levels)):
            mpp = float(spacing[1]) * 1000
    if len(series) > 1:
        raise AmbiguousSeries(f"{path} holds {len(series)} series: " + ", ".join(f"{k} ({v})" for k, v in sorted(series.items())))
    levels.sort(key=lambda v: -v.width)
    return Slide(path, "dicom", tuple(replace(v, level=i) for i, v in enumerate(levels)), tuple(sides), mpp)


def layered_blocks(path: str, data: Ranged, at: int) -> tuple[dict[str, str], tuple[Associated, ...], bytes, float, float]:
    """Of the metadata block: attributes, side images, colour profile, pixel size and magnification."""
    _, _, _, _, _, attributes, images, profile, _, mpp, magnification = unpack("<QHHHHQQQQff", data, at)
    values, sides, icc = {}, [], b""
    if profile != NULL_BLOCK:
        icc = data[profile + 14 : profile + 14 + unpack("<I", data, profile + 10)[0]]
    if attributes != NULL_BLOCK:
        sizes, text = unpack("<QQ", data, attributes + 13)
        place = text + 14
        for i in range(unpack("<I", data, sizes + 12)[0]):
            k, v = unpack("<HI", data, sizes + 16 + 6 * i)
            values[data[place : place + k].decode()] = data[place + k : place + k + v].decode()
            place += k + v
    if images != NULL_BLOCK:
        names = {n: c for c, n in IMAGE_ENCODINGS.items()}
        for i in range(unpack("<I", data, images + 12)[0]):
            block, width, height, encoding = unpack("<QIIB", data, images + 16 + 20 * i)
            title, n = unpack("<HI", data, block + 10)
            sides.append(Associated(data[block + 16 : block + 16 + title].decode(), width, height, names[encoding], [(path, block + 16 + title, n)], height))
    return values, tuple(sides), icc, mpp, magnification


def layered_slide(path: str, data: Ranged) -> Slide:
    """The layered tile format: the tile table's extents, the coarsest first, then an entry of eight bytes a tile."""
    table, metadata = unpack("<QQ", data, 22)
    _, _, encoding, _, _, entries, extents, width, height = unpack("<QHBBQQQII", data, table)
    n = unpack("<I", data, extents + 12)[0]
    at, levels = entries + 16, []
    for i in range(n):
        cols, rows, scale = unpack("<IIf", data, extents + 16 + 12 * i)
        raw = data[at : at + 8 * cols * rows]
        places = []
        for k in range(cols * rows):
            offset, size = int.from_bytes(raw[8 * k : 8 * k + 5], "little"), int.from_bytes(raw[8 * k + 5 : 8 * k + 8], "little")
            places.append((path, 0, 0) if offset == NULL_OFFSET else (path, offset, size))
        at += 8 * cols * rows
        step = round(1 / scale)
        levels.append(Level(0, -(-width // step), -(-height // step), 256, 256, "jpeg" if encoding == TILE_ENCODINGS["jpeg"] else "avif", places, b"", 6))
    values, sides, icc, mpp, magnification = layered_blocks(path, data, metadata)
    facts = {k: values.get(f"scanner-{k}", "") for k in ("make", "model")}
    return Slide(path, "ife", tuple(replace(v, level=i) for i, v in enumerate(reversed(levels))), sides, mpp, magnification, **facts, icc=icc)


def zip_members(path: str, data: Ranged) -> dict[str, tuple[str, int, int]]:
    """Stored members: name -> file, offset, bytes. ZIP64 records are read where they are."""
    tail = data[max(0, len(data) - 65_557) :]
    end = tail.rfind(b"PK\5\6")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if tail[end - 20 : end - 16] == b"PK\6\7":
        far = struct.unpack_from("<Q", tail, end - 12)[0]
        count, size, at = unpack("<QQQ", data, far + 32)
    lines, out, k = data[at : at + size], {}, 0
    for _ in range(count):
        n, names, extra, comment = *struct.unpack_from("<I", lines, k + 20), *struct.unpack_from("<HHH", lines, k + 28)
        place = struct.unpack_from("<I", lines, k + 42)[0]
        name = lines[k + 46 : k + 46 + names].decode()
        if place == 0xFFFFFFFF:
            place = struct.unpack_from("<Q", lines, k + 46 + names + 4)[0]
        out[name] = (path, place + 30 + names, n)
        k += 46 + names + extra + comment
    return out


def zipped_slide(path: str, data: Ranged) -> Slide:
    members = zip_members(path, data)
    manifest = next((m for m in members if m.endswith(".dzi")), None)
    if manifest is None:
        raise NotASlide(f"{path} has no manifest")
    _, at, n = members[manifest]
    text = data[at : at + n].decode()
    tile, overlap, width, height = (int(re.search(rf'{k}="(\d+)"', text)[1]) for k in ("TileSize", "Overlap", "Width", "Height"))
    kind = re.search(r'Format="(\w+)"', text)[1]
    folder = manifest.removesuffix(".dzi") + "_files"
    top, levels = max(width, height) and (max(width, height) - 1).bit_length(), []
    for number in range(top, -1, -1):
        w, h = (-(-x // (1 << (top - number))) for x in (width, height))
        places = [members.get(f"{folder}/{number}/{c}_{r}.{kind}", (path, 0, 0)) for r in range(-(-h // tile)) for c in range(-(-w // tile))]
        levels.append(Level(top - number, w, h, tile, tile, {"jpg": "jpeg"}.get(kind, kind), places))
    return Slide(path, "szi" if not overlap else "szi-overlapping", tuple(levels))


def level_table(spark: SparkSession, slide: Slide) -> DataFrame:
    rows = [(v.level, v.width, v.height, v.tile_w, v.tile_h, v.cols, v.rows, v.codec, v.photometric) for v in slide.levels]
    return spark.createDataFrame(rows, "level int, width int, height int, tile_w int, tile_h int, cols int, rows_ int, compression string, photometric int")


PLACE = "level int, col int, row_ int, file string, at long, nbytes long"


def tile_index(spark: SparkSession, slide: Slide) -> DataFrame:
    """A row for each tile that is there: where its bytes are."""
    columns: list[list] = [[], [], [], [], [], []]
    for v in slide.levels:
        for i, (name, at, n) in enumerate(v.places):
            if n:
                for column, x in zip(columns, (v.level, i % v.cols, i // v.cols, name, at, n), strict=True):
                    column.append(x)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PLACE.split(", ")]))


def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (level, col, row_, file, at, nbytes) with the bytes in place of where they are; files stay open for a task."""
    opened: dict[str, Ranged] = {}
    for batch in batches:
        found = []
        for name, at, n in zip(*[batch.column(k).to_pylist() for k in (3, 4, 5)], strict=True):
            if name not in opened:
                opened[name] = Ranged(name)
            raw = opened[name].source.read_at(n, at)
            if len(raw) != n:
                raise ValueError(f"{name} ends before {at + n}")
            found.append(raw)
        yield pa.record_batch([*batch.columns[:3], pa.array(found, pa.binary())], names=["level", "col", "row_", "bytes"])


def read_tiles(spark: SparkSession, slide: Slide, levels: list[int] | None = None) -> DataFrame:
    """The stored tiles (level, col, row_, bytes), as they are in the file."""
    ship(spark)
    index = tile_index(spark, slide)
    if levels is not None:
        index = index.where(F.col("level").isin(*levels))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return index.repartitionByRange(n, "file", "at").sortWithinPartitions("file", "at").mapInArrow(read_ranges, "level int, col int, row_ int, bytes binary")


def read_pixels(spark: SparkSession, slide: Slide, level: int = 0, reduce: int = 1) -> DataFrame:
    """The pixels (x, y, r, g, b) of a level, without what tiles hold beyond its edges; with `reduce` 2, 4 or 8 decoded at
    that fraction, by the codec itself where it can."""
    from tessera.codecs import decode

    v = slide.levels[level]
    codec, tables, tw, th = v.codec, v.tables, v.tile_w, v.tile_h
    width, height = -(-v.width // reduce), -(-v.height // reduce)
    if reduce > 1 and (tw % reduce or th % reduce):
        raise ValueError("the tiles' sides are no multiple of the reduction")
    if slide.format == "szi-overlapping":
        raise ValueError("tiles overlap: read_tiles gives them as they are")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for col, row, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                rgb = decode(codec, data.as_buffer().to_pybytes(), tw, th, tables or None, reduce)
                x0, y0 = col * tw // reduce, row * th // reduce
                rgb = rgb[: height - y0, : width - x0]
                yy, xx = (g.ravel() for g in np.mgrid[: rgb.shape[0], : rgb.shape[1]])
                flat = rgb.reshape(-1, 3).astype(np.int32)
                yield pa.record_batch([pa.array(xx + x0), pa.array(yy + y0), *[pa.array(flat[:, k]) for k in range(3)]], names=["x", "y", "r", "g", "b"])

    return read_tiles(spark, slide, [level]).mapInArrow(run, "x long, y long, r int, g int, b int")


def transcoded_tiles(spark: SparkSession, slide: Slide, codec: str, knobs: dict | None = None) -> DataFrame:
    """Every level's tiles in another codec, tile by tile, when they are read: (level, col, row_, bytes)."""
    from tessera.codecs import decode, encode

    of = {v.level: (v.codec, v.tile_w, v.tile_h, v.tables or None) for v in slide.levels}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for level, data in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                name, w, h, tables = of[level]
                made.append(encode(codec, decode(name, data.as_buffer().to_pybytes(), w, h, tables), knobs))
            yield pa.record_batch([*batch.columns[:3], pa.array(made, pa.binary())], names=["level", "col", "row_", "bytes"])

    return read_tiles(spark, slide).mapInArrow(run, "level int, col int, row_ int, bytes binary")


def side_bytes(side: Associated) -> tuple[bytes, ...]:
    """A side image's strips as they are in the file."""
    out = []
    for name, at, n in side.places:
        data = Ranged(name)
        out.append(data.source.read_at(n, at))
        data.close()
    return tuple(out)


def side_pixels(side: Associated):
    """A side image decoded: strips one below the other, differences undone."""
    import numpy as np

    from tessera.codecs import decode

    rows, out, y = side.rows_per_strip or side.height, [], 0
    for raw in side_bytes(side):
        h = min(rows, side.height - y)
        rgb = decode(side.codec, raw, side.width, h, side.tables or None)
        out.append(np.cumsum(rgb, 1, dtype=np.uint8) if side.predictor == 2 else rgb)
        y += h
    return np.concatenate(out)


@dataclass
class Stretch(InputPartition):
    rows: list


class SlideReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "tiles")
        self.levels = {int(x) for x in options["levels"].split(",")} if options.get("levels") else None
        self.each = int(options.get("tilesPerTask", 256))

    def partitions(self):
        slide = open_slide(self.path)
        if self.table == "slides":
            v = slide.levels[0]
            return [Stretch([(slide.path, slide.format, v.width, v.height, v.codec, slide.mpp, slide.magnification, slide.make, slide.model, slide.description)])]
        if self.table == "levels":
            return [Stretch([(v.level, v.width, v.height, v.tile_w, v.tile_h, v.cols, v.rows, v.codec, v.photometric) for v in slide.levels])]
        if self.table == "associated":
            return [Stretch([(a.type, a.width, a.height, a.codec, sum(n for *_, n in a.places)) for a in slide.associated])]
        rows = [(v.level, i % v.cols, i // v.cols, *p) for v in slide.levels if self.levels is None or v.level in self.levels for i, p in enumerate(v.places) if p[2]]
        rows.sort(key=lambda r: (r[3], r[4]))
        return [Stretch(rows[i : i + self.each]) for i in range(0, len(rows), self.each)] or [Stretch([])]

    def read(self, partition):
        if self.table != "tiles":
            yield from partition.rows
            return
        opened: dict[str, Ranged] = {}
        for level, col, row, name, at, n in partition.rows:
            if name not in opened:
                opened[name] = Ranged(name)
            yield level, col, row, opened[name].source.read_at(n, at)


class SlideSource(DataSource):
    """spark.read.format("slide").option("table", slides, levels, tiles or associated).load(uri); tiles by default."""

    TABLES = {
        "slides": "path string, format string, width int, height int, compression string, mpp double, magnification double, make string, model string, description string",
        "levels": "level int, width int, height int, tile_w int, tile_h int, cols int, rows_ int, compression string, photometric int",
        "tiles": "level int, col int, row_ int, bytes binary",
        "associated": "type string, width int, height int, compression string, nbytes long",
    }

    @classmethod
    def name(cls) -> str:
        return "slide"

    def schema(self) -> str:
        return self.TABLES[self.options.get("table", "tiles")]

    def reader(self, schema) -> DataSourceReader:
        return SlideReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SlideSource)
