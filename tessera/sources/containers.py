"""Slide files from tile tables: TIFF kinds, zipped Deep Zoom and the layered tile format.

A container is one file, but its tiles are a table. Offsets come from a distributed prefix sum, tasks write the tiles of
their stretch of it to parts in the shared store, and the driver joins the parts, whose number is bounded, behind the
header and the directories, which hold one offset for each tile, as the format wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.codes import COMPRESSION_TAGS
from tessera.functions.curves import order_key
from tessera.operators.layout import by_rows, placed
from tessera.session import settled
from tessera.shipping import ship

from .files import opened, put, remove
from .tiff import Entries

#: Structural metadata of cog-wsi files, fixed keys: tiles have neither leaders nor trailers, so none are announced.
LAYOUT = "IFDS_BEFORE_DATA"
#: Of level tables: level, width, height, tile, cols, rows_.
LEVEL = ("level", "width", "height", "tile", "cols", "rows_")


def ghost_area(order: str = "row-major", values: dict[str, str] | None = None) -> bytes:
    """Structural metadata: a line with the size of the rest in six digits, then KEY=VALUE lines."""
    given = values or {"LAYOUT": LAYOUT, "COG_WSI_VERSION": "1.0", "BLOCK_ORDER": order.replace("-", "_").upper(), "KNOWN_INCOMPATIBLE_EDITION": "NO"}
    body = "".join(f"{k}={v}\n" for k, v in given.items()).encode()
    if len(body) > 999_999:
        raise ValueError("the structural metadata is too long")
    return f"GDAL_STRUCTURAL_METADATA_SIZE={len(body):06d} bytes\n".encode() + body


def parse_ghost(data: bytes) -> dict[str, str]:
    lines = (line.partition("=") for line in data.decode().splitlines())
    return {k: v for k, eq, v in lines if eq and k != "GDAL_STRUCTURAL_METADATA_SIZE"}


def staged(batches: Iterator[pa.RecordBatch], folder: str, unit: int) -> Iterator[pa.RecordBatch]:
    """One part for each task: its tiles in order of their offsets, padded to `unit`."""
    name, first, size = f"{folder}/part-{TaskContext.get().partitionId():06d}", None, 0

    def chunks() -> Iterator[bytes]:
        nonlocal first, size
        for batch in batches:
            for offset, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = data.as_buffer().to_pybytes()
                body += b"\0" * (-len(body) % unit)
                first = offset if first is None else first
                size += len(body)
                yield body

    put(name, chunks())
    if size:
        yield pa.record_batch([pa.array([first]), pa.array([size]), pa.array([name])], names=["first", "size", "part"])


def write_parts(rows: DataFrame, folder: str, unit: int) -> list[tuple[int, int, str]]:
    """Stage rows (offset, bytes); the parts (first offset, bytes, file) in order. One row a task reaches the driver."""
    ship(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("offset", "bytes").repartitionByRange(n, "offset").sortWithinPartitions("offset")
    return sorted(tuple(r) for r in ordered.mapInArrow(lambda it: staged(it, folder, unit), "first long, size long, part string").collect())


def joined_parts(parts: list[tuple[int, int, str]], block: int = 1 << 22) -> Iterator[bytes]:
    for _, _, name in parts:
        files, path = opened(name)
        with files.open_input_stream(path, compression=None) as source:
            while chunk := source.read(block):
                yield chunk


def level_rows(levels: DataFrame) -> list[dict]:
    return [r.asDict() for r in levels.select(*LEVEL).orderBy("level").collect()]


@dataclass(frozen=True)
class Look:
    """How a slide's tiles are to be read, and what is known of it: photometric interpretation (None: by the codec),
    subsampling factors, tables of abbreviated JPEG tiles, a colour profile, and facts for the private tags."""

    photometric: int | None = None
    subsampling: tuple[int, int] | None = None
    tables: bytes = b""
    icc: bytes = b""
    source_format: str = ""
    mpp: tuple[float, float] = (0.0, 0.0)
    magnification: float = 0.0
    make: str = ""
    model: str = ""
    private: bool = False


@dataclass(frozen=True)
class Side:
    """A side image: strips as they are in the file, or one that holds the whole image."""

    type: str
    width: int
    height: int
    codec: str
    strips: tuple[bytes, ...]
    rows_per_strip: int = 0
    predictor: int = 1
    photometric: int | None = None
    tables: bytes = b""
    subsampling: tuple[int, int] | None = None


#: Side images are small; larger ones are refused.
MOST_SIDE = 256 << 20


def photometric_of(codec: str, given: int | None) -> int:
    """JPEG tiles are YCbCr unless it is known that they are not; everything else that is written here is RGB."""
    return given if given is not None else 6 if codec == "jpeg" else 2


def image_entries(e: Entries, codec: str, look: Look | Side) -> Entries:
    photometric = photometric_of(codec, look.photometric)
    e.add(258, 3, [8, 8, 8]).add(259, 3, COMPRESSION_TAGS.get(codec, 1)).add(262, 3, photometric).add(277, 3, 3).add(284, 3, 1).add(305, 2, "tessera")
    if look.tables:
        e.add(347, 7, look.tables)
    if photometric == 6:
        e.add(530, 3, list(look.subsampling or (2, 2)))
    return e


def private_entries(e: Entries, kind: str, level: int | None, count: int, look: Look) -> Entries:
    e.add(65080, 2, kind)
    if level is not None:
        e.add(65081, 4, level).add(65082, 4, count)
    if look.source_format:
        e.add(65083, 2, look.source_format)
    e.add(65084, 2, "tessera")
    for tag, value in ((65085, look.mpp[0]), (65086, look.mpp[1]), (65087, look.magnification)):
        if value > 0:
            e.add(tag, 12, value)
    return e


def side_entries(big: bool, kind: str, side: Side, at: list[int], look: Look) -> Entries:
    """The directory of a side image: label 1, macro 9 in files that tell them by subfile type, else reduced images."""
    e = Entries(big).add(254, 4, {"label": 1, "macro": 9}.get(side.type, 0) if kind == "svs" else 1).add(256, 4, side.width).add(257, 4, side.height)
    image_entries(e, side.codec, side)
    e.add(273, 16 if big else 4, at).add(278, 4, side.rows_per_strip or side.height).add(279, 4, [len(x) for x in side.strips])
    if side.predictor != 1:
        e.add(317, 3, side.predictor)
    e.add(270, 2, f"{side.type} {side.width}x{side.height}")
    return private_entries(e, side.type, None, 0, look) if look.private or kind == "cog-wsi" else e


def chain_order(kind: str, levels: int, sides: tuple[Side, ...]) -> list[tuple[str, int]]:
    """Directories in the order of the chain: an svs has its thumbnail second and label and macro last."""
    every = [("level", i) for i in range(levels)]
    if kind == "svs":
        first = [("side", i) for i, x in enumerate(sides) if x.type == "thumbnail"]
        return every[:1] + first + every[1:] + [("side", i) for i, x in enumerate(sides) if x.type != "thumbnail"]
    return every + [("side", i) for i in range(len(sides))]


def write_tiff(tiles: DataFrame, levels: DataFrame, target: str, codec: str, kind: str = "tiff", description: str = "", order: str = "row-major", big: bool | None = None, mpp: float = 0.0, look: Look = Look(), sides: tuple[Side, ...] = ()) -> int:
    """One slide's tiles (level, col, row_, bytes) as a tiled TIFF with its side images; its size in bytes.

    kind: tiff or svs (flat chain), ome-tiff (lower levels as sub-directories), cog-wsi (structural metadata and
    directories first, then tiles, the smallest level first, in the given order). Offsets are stored by raster place,
    whatever the order. Levels without a tile at a place have offset and size 0 there. Tiles begin at multiples of 16.
    Private tags are written to cog-wsi files, and to others if the look says so.
    """
    if sum(len(x) for s in sides for x in s.strips) > MOST_SIDE:
        raise ValueError(f"side images have more than {MOST_SIDE} bytes")
    shape = level_rows(levels)
    staging = f"{target}.parts-{uuid.uuid4().hex}"
    tiles = settled(tiles.select("level", "col", "row_", "bytes"))  # encoded once, read for sizes, parts and places
    sized = tiles.join(F.broadcast(levels.select("level", "cols", "rows_", F.greatest("cols", "rows_").alias("grid"))), "level")  # a row for each level
    sized = sized.withColumn("nbytes", F.octet_length("bytes").cast("long")).withColumn("slide_id", F.lit(0))
    key = order_key(order)(F.col("col"), F.col("row_"), F.col("cols") if order == "row-major" else F.col("grid"), F.col("rows_"))
    total = sized.agg(F.sum(F.ceil(F.col("nbytes") / 16) * 16)).first()[0] or 0
    strips = [x for s in sides for x in s.strips]
    big = total + sum(map(len, strips)) + 65536 > 2**31 if big is None else big
    wide = 16 if big else 4
    private = look.private or kind == "cog-wsi"
    chain = chain_order(kind, len(shape), sides)
    ghost = ghost_area(order) if kind == "cog-wsi" else b""

    def level_entries(i: int, v: dict, at: list[int], size: list[int]) -> Entries:
        e = Entries(big).add(254, 4, 0 if i == 0 or kind == "svs" else 1).add(256, 4, v["width"]).add(257, 4, v["height"])
        image_entries(e, codec, look)
        e.add(322, 4, v["tile"]).add(323, 4, v["tile"]).add(324, wide, at).add(325, 4, size)
        if i == 0:
            for tag, text in ((270, description), (271, look.make), (272, look.model)):
                if text:
                    e.add(tag, 2, text)
            if look.icc:
                e.add(34675, 7, look.icc)
            if kind == "ome-tiff" and len(shape) > 1:
                e.add(330, wide, [0] * (len(shape) - 1))
        if mpp > 0:
            scale = mpp * shape[0]["width"] / v["width"]
            e.add(282, 5, [(int(100000 / scale + 0.5), 10)]).add(283, 5, [(int(100000 / scale + 0.5), 10)]).add(296, 3, 3)
        return private_entries(e, "pyramid", i, len(shape), look) if private else e

    def directories(where: dict[int, tuple[list[int], list[int]]] | None, end: int) -> tuple[list[Entries], list[int], int]:
        """Directories in chain order, their places and the end of the last; strips follow the tiles, which end at `end`."""
        out, at = [], end
        places_of = {}
        for k, s in enumerate(sides):
            places_of[k] = []
            for x in s.strips:
                places_of[k].append(at)
                at += len(x) + len(x) % 2
        for what, i in chain:
            if what == "side":
                out.append(side_entries(big, kind, sides[i], places_of[i], look))
            else:
                v = shape[i]
                n = v["cols"] * v["rows_"]
                out.append(level_entries(i, v, *(where[v["level"]] if where else ([0] * n, [0] * n))))
        lead = (16 if big else 8) + len(ghost)
        at, places = lead + lead % 2, []
        for e in out:
            places.append(at)
            at += e.size() + e.size() % 2
        return out, places, at

    _, _, end = directories(None, 0)
    start = -(-end // 16) * 16
    rows = placed(sized, key, start)
    try:
        parts = write_parts(rows, staging, 16)
        data_end = start + total
        out, places, _ = directories(tile_places(rows, shape), data_end)
        following = [*places[1:], 0]
        if kind == "ome-tiff" and len(shape) > 1:
            subs = [k for k, (what, i) in enumerate(chain) if what == "level" and i]
            out[0].add(330, wide, [places[k] for k in subs])
            main = [k for k in range(len(chain)) if k not in subs]
            following = [0] * len(chain)
            for a, b in zip(main, main[1:]):
                following[a] = places[b]
        head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, places[0]) if big else struct.pack("<2sHI", b"II", 42, places[0])
        body = bytearray((head + ghost).ljust(places[0], b"\0"))
        for e, at, to in zip(out, places, following, strict=True):
            body = bytearray(bytes(body).ljust(at, b"\0")) + e.encode(at, to)
        tail = b"".join(x + b"\0" * (len(x) % 2) for x in strips)
        return put(target, framed(bytes(body).ljust(start, b"\0"), parts, tail))
    finally:
        remove(staging)


def tile_places(rows: DataFrame, shape: list[dict]) -> dict[int, tuple[list[int], list[int]]]:
    """Offsets and sizes of every level's tiles by raster place, as the directories hold them: two numbers a tile."""
    found = rows.select("level", "col", "row_", "offset", "nbytes").toArrow()
    level, col, row, offset, nbytes = (found.column(k).to_numpy() for k in range(5))
    out = {}
    for v in shape:
        own = level == v["level"]
        at, size = (np.zeros(v["cols"] * v["rows_"], np.int64) for _ in range(2))
        place = row[own].astype(np.int64) * v["cols"] + col[own]
        at[place], size[place] = offset[own], nbytes[own]
        out[v["level"]] = (at.tolist(), size.tolist())
    return out


def chain_of(head: bytes, parts: list[tuple[int, int, str]]) -> Iterator[bytes]:
    yield head
    yield from joined_parts(parts)


def manifest_xml(tile: int, overlap: int, kind: str, width: int, height: int) -> str:
    """A Deep Zoom manifest."""
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<Image xmlns="http://schemas.microsoft.com/deepzoom/2008" Format="{kind}" Overlap="{overlap}" TileSize="{tile}">\n  <Size Width="{width}" Height="{height}"></Size>\n</Image>'


def zip_local(name: bytes, data: bytes) -> bytes:
    """A stored member with its header; its bytes are below 4 GiB."""
    crc, n = zlib.crc32(data), len(data)
    return struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 20, 0, 0, 0, 33, crc, n, n, len(name), 0) + name + data


def zip_central(name: bytes, crc: int, n: int, at: int) -> bytes:
    """A member's line of the central directory; offsets beyond 32 bits go to a ZIP64 field."""
    far = struct.pack("<HHQ", 1, 8, at) if at >= 0xFFFFFFFF else b""
    return struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45 if far else 20, 45 if far else 20, 0, 0, 0, 33, crc, n, n, len(name), len(far), 0, 0, 0, 0, min(at, 0xFFFFFFFF)) + name + far


def zip_end(count: int, size: int, at: int) -> bytes:
    """What closes a zip, with the ZIP64 records where a number needs them."""
    out = b""
    if count >= 0xFFFF or size >= 0xFFFFFFFF or at >= 0xFFFFFFFF:
        out = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, at) + struct.pack("<4sIQI", b"PK\6\7", 0, at + size, 1)
    return out + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0)


def members(batches: Iterator[pa.RecordBatch], prefix: str, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, crcs, sizes = [], [], []
        for level, col, row, data in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3), strict=True):
            raw = data.as_buffer().to_pybytes()
            made.append(zip_local(f"{prefix}{level}/{col}_{row}.{kind}".encode(), raw))
            crcs.append(zlib.crc32(raw))
            sizes.append(len(raw))
        yield pa.record_batch([*batch.columns[:3], pa.array(made, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], names=["level", "col", "row_", "bytes", "crc", "size"])


def write_szi(tiles: DataFrame, target: str, name: str, tile: int, overlap: int, kind: str, width: int, height: int, properties: str) -> int:
    """Deep Zoom tiles (level, col, row_, bytes) with manifest and scan properties in a zip whose members are stored.

    Tasks write the members of their stretch of the file; the driver writes a line for each to the central directory.
    """
    ship(tiles.sparkSession)
    prefix = f"{name}/{name}_files/"
    fixed = [(f"{name}/{name}.dzi", manifest_xml(tile, overlap, kind, width, height).encode()), (f"{name}/scan-properties.xml", properties.encode())]
    head = b"".join(zip_local(n.encode(), data) for n, data in fixed)
    made = settled(tiles.select(F.col("level").cast("int"), F.col("col").cast("int"), F.col("row_").cast("int"), "bytes").mapInArrow(lambda it: members(it, prefix, kind), "level int, col int, row_ int, bytes binary, crc long, size long"))
    rows = placed(made.withColumn("nbytes", F.octet_length("bytes").cast("long")).withColumn("slide_id", F.lit(0)), by_rows(F.col("col"), F.col("row_")), len(head), unit=1)
    staging = f"{target}.parts-{uuid.uuid4().hex}"
    try:
        parts = write_parts(rows, staging, 1)
        lines, at = [], 0
        for n, data in fixed:
            lines.append(zip_central(n.encode(), zlib.crc32(data), len(data), at))
            at += len(zip_local(n.encode(), data))
        found = rows.select("offset", "level", "col", "row_", "crc", "size", "nbytes").toArrow().sort_by("offset")
        end = len(head)
        for offset, level, col, row, crc, size, nbytes in zip(*[c.to_pylist() for c in found.columns], strict=True):
            lines.append(zip_central(f"{prefix}{level}/{col}_{row}.{kind}".encode(), crc, size, offset))
            end = offset + nbytes
        body = b"".join(lines)
        return put(target, framed(head, parts, body + zip_end(len(lines), len(body), end)))
    finally:
        remove(staging)


# Fixed values of the layered tile format: its magic, absent offsets, a tag for each kind of block, codes of encodings.
MAGIC = 0x49726973
NULL_OFFSET, NULL_BLOCK = (1 << 40) - 1, (1 << 64) - 1
BLOCKS = {"header": 0x5501, "table": 0x5502, "metadata": 0x5504, "attributes": 0x5505, "extents": 0x5506, "offsets": 0x5507, "sizes": 0x5508, "bytes": 0x5509, "array": 0x550A, "image": 0x550B, "profile": 0x550C}
TILE_ENCODINGS = {"jpeg": 2, "avif": 3}
IMAGE_ENCODINGS = {"png": 1, "jpeg": 2, "avif": 3}


def layered_images(at: int, sides: tuple[Side, ...]) -> tuple[bytes, int]:
    """Side images as blocks from an offset on, and where their array is. Those in other codecs go as PNG."""
    out, lines = b"", []
    for s in sides:
        codec, blob = s.codec, s.strips[0]
        if codec not in IMAGE_ENCODINGS or len(s.strips) > 1 or s.tables:
            from tessera.codecs import decode, encode

            rows, y, planes = s.rows_per_strip or s.height, 0, []
            for raw in s.strips:
                rgb = decode(codec, raw, s.width, min(rows, s.height - y), s.tables or None)
                planes.append(np.cumsum(rgb, 1, dtype=np.uint8) if s.predictor == 2 else rgb)
                y += len(rgb)
            codec, blob = "png", encode("png", np.concatenate(planes))
        title = s.type.encode()
        lines.append(struct.pack("<QIIBBH", at + len(out), s.width, s.height, IMAGE_ENCODINGS[codec], 2, 0))
        out += struct.pack("<QHHI", at + len(out), BLOCKS["image"], len(title), len(blob)) + title + blob
    array = at + len(out)
    return out + struct.pack("<QHHI", array, BLOCKS["array"], 20, len(lines)) + b"".join(lines), array


def layered_attributes(at: int, values: dict[str, str]) -> tuple[bytes, int]:
    """Free-text attributes in order of their keys: sizes, bytes, then the block that names both."""
    pairs = [(k.encode(), v.encode()) for k, v in sorted(values.items())]
    body = b"".join(k + v for k, v in pairs)
    out = struct.pack("<QHHI", at, BLOCKS["sizes"], 6, len(pairs)) + b"".join(struct.pack("<HI", len(k), len(v)) for k, v in pairs)
    text = at + len(out)
    out += struct.pack("<QHI", text, BLOCKS["bytes"], len(body)) + body
    block = at + len(out)
    return out + struct.pack("<QHBHQQ", block, BLOCKS["attributes"], 1, 0, at, text), block


def write_ife(tiles: DataFrame, levels: DataFrame, target: str, codec: str, look: Look = Look(), sides: tuple[Side, ...] = (), attributes: dict[str, str] | None = None) -> int:
    """The layered tile format, for 256-pixel tiles in jpeg or avif: header, tiles, then metadata and tables, the coarsest
    level first.

    A place without a tile has the null offset and size 0. Every block begins with its own offset and tag.
    """
    shape = level_rows(levels)
    if any(v["tile"] != 256 for v in shape) or codec not in TILE_ENCODINGS:
        raise ValueError("only 256-pixel tiles in jpeg or avif")
    staging = f"{target}.parts-{uuid.uuid4().hex}"
    sized = settled(tiles.select("level", "col", "row_", "bytes")).withColumn("nbytes", F.octet_length("bytes").cast("long")).withColumn("slide_id", F.lit(0))
    if (sized.agg(F.max("nbytes")).first()[0] or 0) > 0xFFFFFF:
        raise ValueError("a tile is larger than 24 bits tell")
    rows = placed(sized, by_rows(F.col("col"), F.col("row_")), 38, unit=1)
    try:
        parts = write_parts(rows, staging, 1)
        end = 38 + sum(n for _, n, _ in parts)
        tail, at = b"", {"icc": NULL_BLOCK, "images": NULL_BLOCK, "attributes": NULL_BLOCK}
        if look.icc:
            at["icc"] = end
            tail += struct.pack("<QHI", end, BLOCKS["profile"], len(look.icc)) + look.icc
        if sides:
            made, at["images"] = layered_images(end + len(tail), sides)
            tail += made
        if attributes:
            made, at["attributes"] = layered_attributes(end + len(tail), attributes)
            tail += made
        metadata = end + len(tail)
        tail += struct.pack("<QHHHHQQQQff", metadata, BLOCKS["metadata"], 0, 0, 0, at["attributes"], at["images"], at["icc"], NULL_BLOCK, look.mpp[0], look.magnification)
        coarse = sorted(shape, key=lambda v: -v["level"])
        extents = end + len(tail)
        tail += struct.pack("<QHHI", extents, BLOCKS["extents"], 12, len(coarse)) + b"".join(struct.pack("<IIf", v["cols"], v["rows_"], 1 / 2 ** v["level"]) for v in coarse)
        where, entries = tile_places(rows, shape), []
        for v in coarse:
            for offset, n in zip(*where[v["level"]], strict=True):
                entries.append((offset if n else NULL_OFFSET).to_bytes(5, "little") + n.to_bytes(3, "little"))
        offsets = end + len(tail)
        tail += struct.pack("<QHHI", offsets, BLOCKS["offsets"], 8, len(entries)) + b"".join(entries)
        table = end + len(tail)
        tail += struct.pack("<QHBBQQQII", table, BLOCKS["table"], TILE_ENCODINGS[codec], 2, NULL_BLOCK, offsets, extents, shape[0]["width"], shape[0]["height"])
        head = struct.pack("<IHQHHIQQ", MAGIC, BLOCKS["header"], end + len(tail), 1, 0, 0, table, metadata)
        return put(target, framed(head, parts, tail))
    finally:
        remove(staging)


def framed(head: bytes, parts: list[tuple[int, int, str]], tail: bytes) -> Iterator[bytes]:
    yield from chain_of(head, parts)
    yield tail
