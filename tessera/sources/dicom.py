"""DICOM whole-slide instances from tile tables: one file for each level, frames in raster order."""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.codes import SYNTAXES
from tessera.operators.layout import placed
from tessera.session import settled

from .containers import framed, level_rows, write_parts
from .files import exists, put, remove, rename

# The storage class, the plain syntax, value forms with long lengths.
WSM = "1.2.840.10008.5.1.4.1.1.77.1.6"
EXPLICIT_LE = "1.2.840.10008.1.2.1"
LONG_FORMS = {"OB", "OW", "SQ", "UN", "UT"}


def uid(name: str) -> str:
    """A UID under 2.25 that follows from a name."""
    return f"2.25.{uuid.uuid5(uuid.NAMESPACE_URL, name).int}"


def decimal_string(x: float) -> str:
    """The shortest decimal of at most 16 characters, as close as they allow."""
    text = repr(float(x)).removesuffix(".0")
    digits = 16
    while len(text) > 16:
        digits -= 1
        text = f"{x:.{digits}g}"
    return text


def element(group: int, number: int, vr: str, value) -> bytes:
    if vr in ("US", "UL", "FL"):
        values = value if isinstance(value, (list, tuple)) else [value]
        raw = struct.pack("<" + {"US": "H", "UL": "I", "FL": "f"}[vr] * len(values), *values)
    elif isinstance(value, bytes):
        raw = value
    else:
        text = value if isinstance(value, str) else "\\".join(map(str, value))
        raw = text.encode()
        raw += (b"\0" if vr == "UI" else b" ") * (len(raw) % 2)
    head = struct.pack("<HH2s", group, number, vr.encode())
    return head + (struct.pack("<HI", 0, len(raw)) if vr in LONG_FORMS else struct.pack("<H", len(raw))) + raw


def sequence(group: int, number: int, items: list[bytes]) -> bytes:
    return element(group, number, "SQ", b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(i)) + i for i in items))


def image_type(level: int, kind: str = "") -> str:
    if kind:
        return f"ORIGINAL\\PRIMARY\\{ {'label': 'LABEL', 'thumbnail': 'THUMBNAIL'}.get(kind, 'OVERVIEW') }\\NONE"
    return "ORIGINAL\\PRIMARY\\VOLUME\\NONE" if level == 0 else "DERIVED\\PRIMARY\\VOLUME\\RESAMPLED"


def syntax_of(codec: str, lossless: bool) -> tuple[str, str | None]:
    if codec == "none":
        return EXPLICIT_LE, None
    if (codec, lossless) not in SYNTAXES:
        raise ValueError(f"{'lossless ' if lossless else ''}{codec} has no transfer syntax")
    return SYNTAXES[codec, lossless]


def photometric_of(codec: str, lossless: bool) -> str:
    """RGB as it is; YBR_FULL_422 for subsampled JPEG; the reversible or irreversible transform of the wavelet codecs."""
    if codec == "none":
        return "RGB"
    return "YBR_FULL_422" if codec == "jpeg" else "YBR_RCT" if lossless else "YBR_ICT"


def code_item(value: str, scheme: str, meaning: str) -> bytes:
    return element(8, 0x100, "SH", value) + element(8, 0x102, "SH", scheme) + element(8, 0x104, "LO", meaning)


def header(name: str, number: int, v: dict, w0: int, codec: str, lossless: bool, photometric: str, mpp: float, frames: int, nbytes: int, kind: str = "", facts: dict | None = None) -> bytes:
    """All elements before the pixel data: the modules of a whole-slide instance, in order of their numbers."""
    syntax, method = syntax_of(codec, lossless)
    facts = facts or {}
    instance = uid(f"{name}/{number}")
    meta = element(2, 1, "OB", b"\0\1") + element(2, 2, "UI", WSM) + element(2, 3, "UI", instance) + element(2, 0x10, "UI", syntax) + element(2, 0x12, "UI", uid("tessera"))
    spacing = decimal_string((mpp or 1.0) * w0 / v["width"] / 1000)
    tile_w, tile_h = v.get("tile_w", v["tile"]), v.get("tile_h", v["tile"])
    ratio = decimal_string(frames * tile_w * tile_h * 3 / max(1, nbytes))
    scale = (mpp or 1.0) * w0 / 1000
    out = [
        element(8, 8, "CS", image_type(v["level"], kind)), element(8, 0x16, "UI", WSM), element(8, 0x18, "UI", instance),
        element(8, 0x20, "DA", "20240101"), element(8, 0x23, "DA", "20240101"), element(8, 0x2A, "DT", "20240101000000"), element(8, 0x30, "TM", "000000"), element(8, 0x33, "TM", "000000"),
        element(8, 0x50, "SH", ""), element(8, 0x60, "CS", "SM"), element(8, 0x70, "LO", facts.get("make") or "unknown"), element(8, 0x90, "PN", ""), element(8, 0x1090, "LO", facts.get("model") or "unknown"),
        element(8, 0x9205, "CS", "COLOR"), element(8, 0x9206, "CS", "VOLUME"), element(8, 0x9207, "CS", "NONE"),
        element(0x10, 0x10, "PN", ""), element(0x10, 0x20, "LO", ""), element(0x10, 0x30, "DA", ""), element(0x10, 0x40, "CS", ""),
        element(0x18, 0x1000, "LO", facts.get("serial") or "unknown"), element(0x18, 0x1020, "LO", "tessera"),
        element(0x20, 0xD, "UI", uid(f"{name}/study")), element(0x20, 0xE, "UI", uid(f"{name}/series")), element(0x20, 0x10, "SH", ""), element(0x20, 0x11, "IS", "1"), element(0x20, 0x13, "IS", str(number)),
        element(0x20, 0x52, "UI", uid(f"{name}/frame")), element(0x20, 0x1040, "LO", "SLIDE_CORNER"),
        sequence(0x20, 0x9221, [element(0x20, 0x9164, "UI", uid(f"{name}/dimensions"))]), element(0x20, 0x9311, "CS", "TILED_FULL"),
        element(0x28, 2, "US", 3), element(0x28, 4, "CS", photometric), element(0x28, 6, "US", 0), element(0x28, 8, "IS", str(frames)), element(0x28, 0x10, "US", tile_h), element(0x28, 0x11, "US", tile_w),
        element(0x28, 0x100, "US", 8), element(0x28, 0x101, "US", 8), element(0x28, 0x102, "US", 7), element(0x28, 0x103, "US", 0), element(0x28, 0x301, "CS", "YES" if kind == "label" else "NO"),
        element(0x28, 0x2110, "CS", "01" if method else "00"),
        *([element(0x28, 0x2112, "DS", ratio), element(0x28, 0x2114, "CS", method)] if method else []),
        element(0x40, 0x512, "LO", "slide"), sequence(0x40, 0x513, []), sequence(0x40, 0x518, [code_item("433466003", "SCT", "Microscope slide")]), sequence(0x40, 0x555, []),
        sequence(0x40, 0x560, [element(0x40, 0x551, "LO", "specimen") + element(0x40, 0x554, "UI", uid(f"{name}/specimen")) + sequence(0x40, 0x562, []) + sequence(0x40, 0x610, [])]),
        element(0x48, 1, "FL", scale), element(0x48, 2, "FL", scale * v["height"] / v["width"]), element(0x48, 3, "FL", 0.001), element(0x48, 6, "UL", v["width"]), element(0x48, 7, "UL", v["height"]),
        sequence(0x48, 8, [element(0x40, 0x72A, "DS", "0") + element(0x40, 0x73A, "DS", "0")]), element(0x48, 0x10, "CS", "YES" if kind == "label" else "NO"), element(0x48, 0x11, "CS", "AUTO"), element(0x48, 0x12, "CS", "NO"),
        element(0x48, 0x102, "DS", "0\\-1\\0\\-1\\0\\0"),
        sequence(0x48, 0x105, [sequence(0x22, 0x16, [code_item("111741", "DCM", "Transmission illumination")]) + element(0x48, 0x106, "SH", "1") + sequence(0x48, 0x108, [code_item("414298005", "SCT", "Full Spectrum")])]),
        element(0x48, 0x302, "UL", 1), element(0x48, 0x303, "UL", 1),
        sequence(0x5200, 0x9229, [sequence(0x28, 0x9110, [element(0x18, 0x50, "DS", "0.001") + element(0x28, 0x30, "DS", f"{spacing}\\{spacing}")])]),
    ]
    return b"\0" * 128 + b"DICM" + element(2, 0, "UL", len(meta)) + meta + b"".join(out)


def item(data: Column) -> Column:
    """A frame as an item of encapsulated pixel data: tag, even length, bytes, a zero byte behind an odd frame."""
    size = F.octet_length(data) + F.octet_length(data) % 2
    big = F.lpad(F.hex(size), 8, "0")
    little = F.concat(*[F.substring(big, k, 2) for k in (7, 5, 3, 1)])
    pad = F.when(F.octet_length(data) % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    return F.concat(F.unhex(F.concat(F.lit("FEFF00E0"), little)), data, pad)


def write_series(tiles: DataFrame, levels: DataFrame, folder: str, codec: str = "jpeg", lossless: bool = False, photometric: str | None = None, mpp: float = 0.0, sides: tuple = (), facts: dict | None = None, force: bool = False) -> list[str]:
    """One instance for each level of (level, col, row_, bytes), complete levels only, numbered from 1, then one for each
    side image (type, width, height, codec and one strip): the files' names.

    A series of equal tiles has equal UIDs. Level 0 is level-0.dcm. Uncompressed frames are native pixel data, others
    items. The folder is written under another name beside it and renamed when whole; one that is there is refused,
    unless `force` lets it be replaced.
    """
    syntax_of(codec, lossless)
    if exists(folder) and not force:
        raise ValueError(f"{folder} is there already")
    shape, tiles = level_rows(levels), settled(tiles.select("level", "col", "row_", "bytes"))
    name, beside, out = folder.rpartition("/")[2], f"{folder}.writing-{uuid.uuid4().hex}", []
    look = photometric or photometric_of(codec, lossless)
    try:
        for number, v in enumerate(shape, 1):
            frames = v["cols"] * v["rows_"]
            own = tiles.where(F.col("level") == v["level"])
            found, nbytes = own.agg(F.count(F.lit(1)), F.sum(F.octet_length("bytes"))).first()
            if found != frames:
                raise ValueError(f"level {v['level']} has {found} of {frames} tiles")
            head = header(name, number, v, shape[0]["width"], codec, lossless, look, mpp, frames, nbytes, facts=facts)
            if codec == "none":
                rows, tail = own, b"\0" * (nbytes % 2)
                head += struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OB", 0, nbytes + nbytes % 2)
            else:
                rows, tail = own.withColumn("bytes", item(F.col("bytes"))), struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
                head += struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OB", 0, 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0)
            rows = rows.withColumn("nbytes", F.octet_length("bytes").cast("long")).withColumn("slide_id", F.lit(0))
            parts = write_parts(placed(rows, F.col("row_") * v["cols"] + F.col("col"), len(head), unit=1), f"{beside}/_parts-{v['level']}", 1)
            put(f"{beside}/level-{v['level']}.dcm", framed(head, parts, tail))
            remove(f"{beside}/_parts-{v['level']}")
            out.append(f"level-{v['level']}.dcm")
        for number, side in enumerate(sides, len(shape) + 1):
            out.append(f"{side.type}.dcm")
            put(f"{beside}/{side.type}.dcm", [side_instance(name, number, side, shape[0]["width"], facts)])
        if force:
            remove(folder)
        rename(beside, folder)
    finally:
        remove(beside)
    return out


def side_instance(name: str, number: int, side, w0: int, facts: dict | None) -> bytes:
    """A side image of one frame: JPEG and JPEG 2000 as it is, anything else decoded to native RGB."""
    data, codec = b"".join(side.strips), side.codec
    if codec not in ("jpeg", "jpeg2000") or len(side.strips) > 1 or side.tables:
        from tessera.codecs import decode

        rows, y, planes = side.rows_per_strip or side.height, 0, []
        for raw in side.strips:
            h = min(rows, side.height - y)
            rgb = decode(codec, raw, side.width, h, side.tables or None)
            planes.append((np.cumsum(rgb, 1, dtype=np.uint8) if side.predictor == 2 else rgb).tobytes())
            y += h
        data, codec = b"".join(planes), "none"
    v = {"level": 0, "width": side.width, "height": side.height, "tile": side.width, "tile_w": side.width, "tile_h": side.height}
    head = header(name, number, v, w0, codec, False, photometric_of(codec, False), 0.0, 1, len(data), side.type, facts)
    data += b"\0" * (len(data) % 2)
    if codec == "none":
        return head + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OB", 0, len(data)) + data
    items = struct.pack("<HHI", 0xFFFE, 0xE000, 0) + struct.pack("<HHI", 0xFFFE, 0xE000, len(data)) + data + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    return head + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OB", 0, 0xFFFFFFFF) + items


def read_elements(data: bytes) -> dict[tuple[int, int], bytes]:
    """Top-level elements of an instance; encapsulated frames under (0x7FE0, 0x10, n)."""
    if data[128:132] != b"DICM":
        raise ValueError("no DICOM preamble")
    at, out = 132, {}
    while at < len(data):
        group, number, vr = struct.unpack_from("<HH2s", data, at)
        if vr.decode() in LONG_FORMS:
            size, at = struct.unpack_from("<I", data, at + 8)[0], at + 12
        else:
            size, at = struct.unpack_from("<H", data, at + 6)[0], at + 8
        if size == 0xFFFFFFFF:
            n = -1
            while struct.unpack_from("<HH", data, at) == (0xFFFE, 0xE000):
                size = struct.unpack_from("<I", data, at + 4)[0]
                if n >= 0:
                    out[group, number, n] = data[at + 8 : at + 8 + size]
                n, at = n + 1, at + 8 + size
            at += 8
        else:
            out[group, number] = data[at : at + size]
            at += size
    return out
