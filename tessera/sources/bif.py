"""BIF files: an overview strip, then a chain of tiled JPEG levels, with scanner facts and tile joints as XMP."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.layout import by_rows, placed
from tessera.session import settled

from .containers import framed, level_rows, tile_places, write_parts
from .files import put, remove
from .tiff import Entries

# The overview's canvas, of which the upper third is the label, and the literals that readers look for.
OVERVIEW = (1251, 3685)
SCANNER = "VENTANA DP 200"
UNIT = "2000515"


def scan_xmp(magnification: float, resolution: float) -> bytes:
    """Scanner facts, on the overview's directory."""
    facts = {"Mode": "brightfield", "Magnification": f"{magnification:.0f}", "ScanRes": f"{resolution:g}", "UnitNumber": UNIT, "ScannerModel": SCANNER, "Z-layers": "1", "Z-spacing": "0"}
    facts |= {"UserName": "tessera", "BuildVersion": "0.0.0.0", "BuildDate": "1/1/2020 0:0:0 AM", "ScanWhitePoint": "255", "Anonymization": "1"}
    return ('<?xml version="1.0" encoding="UTF-8"?><Metadata><iScan ' + " ".join(f'{k}="{v}"' for k, v in facts.items()) + "/></Metadata>").encode()


def snake(col: int, row: int, cols: int, rows: int) -> int:
    """The number of a tile from 1, from the lower left on, every second row backwards."""
    up = rows - 1 - row
    return 1 + up * cols + (cols - 1 - col if up % 2 else col)


def joints(cols: int, rows: int) -> Iterator[tuple[str, int, int]]:
    """Neighbours: each tile with the one to its right, then each with the one above."""
    for row in range(rows):
        for col in range(cols - 1):
            yield "LEFT", snake(col, row, cols, rows), snake(col + 1, row, cols, rows)
    for col in range(cols):
        for row in range(1, rows):
            yield "UP", snake(col, row, cols, rows), snake(col, row - 1, cols, rows)


def stitch_xmp(cols: int, rows: int, tile: int) -> bytes:
    """The finest level's grid: frames in the order in which tiles are stored, and joints without overlap."""
    each = "".join(f'<TileJointInfo FlagJoined="1" Confidence="100" Direction="{d}" Tile1="{a}" Tile2="{b}" OverlapX="0" OverlapY="0"/>' for d, a, b in joints(cols, rows))
    frames = "".join(f'<Frame XY="{i % cols},{i // cols}" Z="0" Focus="0"/>' for i in range(cols * rows))
    grid = f'NumRows="{rows}" NumCols="{cols}"'
    return (
        '<?xml version="1.0" encoding="UTF-8"?><EncodeInfo Ver="2"><SlideInfo Rack="0" Slot="0" BaseName="tessera">'
        f'<AoiInfo XIMAGESIZE="{tile}" YIMAGESIZE="{tile}" {grid} Pos-X="0" Pos-Y="0"/></SlideInfo><SlideStitchInfo>'
        f'<ImageInfo AOIScanned="1" AOIIndex="0" {grid} Width="{tile}" Height="{tile}" Pos-X="0" Pos-Y="0">{each}<FrameInfo AOIScanned="1" AOIIndex="0">{frames}</FrameInfo></ImageInfo>'
        '</SlideStitchInfo><AoiOrigin><AOI0 OriginX="0" OriginY="0"/></AoiOrigin></EncodeInfo>'
    ).encode()


def fitted(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image scaled into a box by nearest pixels, in the middle of white."""
    h, w, _ = rgb.shape
    scale = min(width / w, height / h)
    nw, nh = max(1, int(w * scale)), max(1, int(h * scale))
    small = rgb[(np.arange(nh) * h // nh)[:, None], (np.arange(nw) * w // nw)[None, :]]
    out = np.full((height, width, 3), 255, np.uint8)
    y, x = (height - nh) // 2, (width - nw) // 2
    out[y : y + nh, x : x + nw] = small
    return out


def overview(picture: np.ndarray | None, tissue: np.ndarray | None) -> np.ndarray:
    """The overview: a picture of the whole slide, upright, if there is one; else the tissue below an empty label."""
    width, height = OVERVIEW
    if picture is not None:
        return fitted(np.rot90(picture, -1) if picture.shape[1] > picture.shape[0] else picture, width, height)
    out = np.full((height, width, 3), 255, np.uint8)
    if tissue is not None:
        band = height // 3
        out[band:] = fitted(tissue, width, height - band)
    return out


def write_bif(tiles: DataFrame, levels: DataFrame, target: str, picture: np.ndarray, magnification: float = 20.0, resolution: float = 0.465, subsampling: tuple[int, int] = (2, 2)) -> int:
    """JPEG tiles (level, col, row_, bytes) of complete levels as a BIF file; its size.

    Always a big TIFF. Sides are told as whole tiles. Tiles are stored by rows, the finest level last; every level says
    its number and magnification in its description.
    """
    shape, tiles = level_rows(levels), settled(tiles.select("level", "col", "row_", "bytes"))
    staging = f"{target}.parts-{uuid.uuid4().hex}"
    strip = np.ascontiguousarray(picture, np.uint8).tobytes()

    def directories(where: dict | None, strip_at: int) -> tuple[list[Entries], list[int], int]:
        h, w, _ = picture.shape
        top = Entries(True).add(256, 4, w).add(257, 4, h).add(258, 3, [8, 8, 8]).add(259, 3, 1).add(262, 3, 2).add(270, 2, "Label_Image")
        top.add(273, 16, [strip_at]).add(277, 3, 3).add(278, 4, h).add(279, 16, [len(strip)]).add(284, 3, 1).add(700, 1, list(scan_xmp(magnification, resolution) + b"\0"))
        out = [top]
        for i, v in enumerate(shape):
            n = v["cols"] * v["rows_"]
            at, size = where[v["level"]] if where else ([0] * n, [0] * n)
            scale = v["width"] / shape[0]["width"]
            e = Entries(True).add(256, 4, v["cols"] * v["tile"]).add(257, 4, v["rows_"] * v["tile"]).add(258, 3, [8, 8, 8]).add(259, 3, 7).add(262, 3, 6).add(270, 2, f"level={i} mag={magnification * scale:g} quality=90")
            e.add(277, 3, 3).add(284, 3, 1).add(322, 3, v["tile"]).add(323, 3, v["tile"]).add(324, 16, at).add(325, 16, size).add(530, 3, list(subsampling))
            if i == 0:
                e.add(700, 1, list(stitch_xmp(v["cols"], v["rows_"], v["tile"]) + b"\0"))
            out.append(e)
        at, places = 16, []
        for e in out:
            places.append(at)
            at += e.size() + e.size() % 2
        return out, places, at

    _, _, end = directories(None, 0)
    sized = tiles.withColumn("nbytes", F.octet_length("bytes").cast("long")).withColumn("slide_id", F.lit(0))
    counts = {r["level"]: r["n"] for r in sized.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    for v in shape:
        if counts.get(v["level"], 0) != v["cols"] * v["rows_"]:
            raise ValueError(f"level {v['level']} has {counts.get(v['level'], 0)} of {v['cols'] * v['rows_']} tiles")
    rows = placed(sized, by_rows(F.col("col"), F.col("row_")), end + len(strip), unit=1)
    try:
        parts = write_parts(rows, staging, 1)
        out, places, _ = directories(tile_places(rows, shape), end)
        body = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, places[0]))
        for e, at, to in zip(out, places, [*places[1:], 0], strict=True):
            body = bytearray(bytes(body).ljust(at, b"\0")) + e.encode(at, to)
        return put(target, framed(bytes(body).ljust(end, b"\0") + strip, parts, b""))
    finally:
        remove(staging)
