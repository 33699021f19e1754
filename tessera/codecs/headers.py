"""What the header of a JPEG, JPEG 2000 or WebP codestream says, without decoding it."""

from __future__ import annotations

import struct
from dataclasses import asdict, dataclass

from tessera.functions.jpeg import LUMINANCE


@dataclass
class Facts:
    codec: str = ""
    width: int = 0
    height: int = 0
    components: int = 0
    depth: int = 0
    colorspace: str = ""
    chroma: str = ""
    lossless: bool = False
    quality: int = 0
    layers: int = 0


SCHEMA = "codec string, width int, height int, components int, depth int, colorspace string, chroma string, lossless boolean, quality int, layers int"
SAMPLING = {(1, 1): "4:4:4", (2, 1): "4:2:2", (2, 2): "4:2:0", (4, 1): "4:1:1", (1, 2): "4:4:0"}


def segments(data: bytes):
    """Markers of a JPEG up to the first scan, with their payloads."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        yield marker, data[at + 4 : at + 2 + size]
        if marker == 0xDA:
            return
        at += 2 + size


def table_quality(table: list[int]) -> int:
    ratios = [q * 100 / s for q, s in zip(table, LUMINANCE, strict=True) if q]
    if not ratios:
        return 0
    mean = sum(ratios) / len(ratios)
    return max(1, min(100, int((5000 / mean if mean >= 100 else (200 - mean) / 2) + 0.5)))


def jpeg(data: bytes, tables: bytes | None = None) -> Facts:
    out = Facts("jpeg", depth=8)
    found: dict[int, list[int]] = {}
    jfif, adobe, ids, sampling = False, None, [], []
    for marker, body in [*(segments(tables) if tables else ()), *segments(data)]:
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide, number = body[at] >> 4, body[at] & 15
                size = 128 if wide else 64
                found.setdefault(number, list(struct.unpack_from(">64H" if wide else "64B", body, at + 1)))
                at += 1 + size
        elif marker == 0xE0 and body[:5] == b"JFIF\0":
            jfif = True
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker in (0xC0, 0xC1, 0xC2):
            out.depth, out.height, out.width, out.components = struct.unpack_from(">BHHB", body)
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(out.components)]
            ids, sampling = [p[0] for p in parts], [(p[1] >> 4, p[1] & 15) for p in parts]
    if out.components == 1:
        out.colorspace = "grayscale"
    elif out.components == 3:
        if jfif or adobe in (1, 2):
            out.colorspace = "YCbCr"
        elif adobe == 0:
            out.colorspace = "RGB"
        else:
            out.colorspace = "YCbCr" if ids == [1, 2, 3] else "RGB"
        if sampling[1:] == [(1, 1), (1, 1)]:
            out.chroma = SAMPLING.get(sampling[0], "")
    if found:
        out.quality = table_quality(found.get(0) or found[min(found)])
    return out


def jpeg2000(data: bytes) -> Facts:
    start = data.find(b"\xff\x4f\xff\x51")
    if start < 0:
        raise ValueError("no JPEG 2000 codestream")
    out, at = Facts("jpeg2000"), start + 2
    while at + 4 <= len(data):
        marker, size = struct.unpack_from(">HH", data, at)
        body = data[at + 4 : at + 2 + size]
        if marker == 0xFF51:
            _, x1, y1, x0, y0 = struct.unpack_from(">HIIII", body)
            out.width, out.height = x1 - x0, y1 - y0
            out.components = struct.unpack_from(">H", body, 34)[0]
            out.depth = (body[36] & 127) + 1
        elif marker == 0xFF52:
            out.layers = struct.unpack_from(">H", body, 2)[0]
            mixed, reversible = body[4], body[9] == 1
            out.lossless = reversible
            out.colorspace = "grayscale" if out.components == 1 else "RGB" if mixed else ""
        elif marker == 0xFF90:
            break
        at += 2 + size
    return out


def webp(data: bytes) -> Facts:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP")
    out, at = Facts("webp", components=3, depth=8), 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if kind == b"VP8L" and len(body) >= 5:
            packed = struct.unpack_from("<I", body, 1)[0]
            out.lossless, out.width, out.height, out.colorspace = True, (packed & 0x3FFF) + 1, (packed >> 14 & 0x3FFF) + 1, "RGB"
        elif kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
            out.width, out.height = (x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
            out.colorspace, out.chroma = "YCbCr", "4:2:0"
        at += 8 + size + size % 2
    return out


#: Codec name -> inspector; the last one set holds.
INSPECTORS = {"jpeg": jpeg, "jpeg2000": jpeg2000, "webp": webp}


def inspect(codec: str, data: bytes) -> dict:
    """The facts as a row; those of an unknown or broken codestream are only its codec's name."""
    try:
        return asdict(INSPECTORS[codec](data)) if codec in INSPECTORS else asdict(Facts(codec))
    except (ValueError, IndexError, struct.error):
        return asdict(Facts(codec))
