"""Baseline JPEG on arrays: an encoder, a decoder that also reduces by 2, 4 or 8, and abbreviated streams."""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass, field

import numpy as np

from tessera.functions.jpeg import LUMINANCE

# The published example quantisation table for colour, by rows; the luminance one is in functions.jpeg.
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32,
)
#: Places of a block by rows, in zigzag order: along each diagonal, the direction changing.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
SAMPLINGS = {"4:4:4": (1, 1), "4:2:2": (2, 1), "4:2:0": (2, 2)}
#: The Huffman tables that are written have codes of one length: 4 bits for DC, 8 for AC.
DC_SYMBOLS = list(range(12))
AC_SYMBOLS = [0x00, 0xF0, *[run << 4 | size for run in range(16) for size in range(1, 11)]]


class Unsupported(ValueError):
    """A JPEG that is no baseline one of 8 bits with one or three components."""


@functools.cache
def cosines(n: int) -> np.ndarray:
    k, x = np.mgrid[:n, :n]
    return np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n)))


def quantiser(base: tuple[int, ...], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def to_ycc(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.float64) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402], -1)


def to_rgb(ycc: np.ndarray) -> np.ndarray:
    y, cb, cr = ycc[..., 0], ycc[..., 1] - 128, ycc[..., 2] - 128
    return np.stack([y + 1.402 * cr, y - (0.299 * 1.402 * cr + 0.114 * 1.772 * cb) / 0.587, y + 1.772 * cb], -1)


def blocks_of(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)


def scan_bits(coefficients: np.ndarray, component: np.ndarray) -> bytes:
    """The entropy-coded scan of blocks (zigzag rows) in scan order."""
    n = len(coefficients)
    dc = coefficients[:, 0]
    step = np.zeros(n, np.int64)
    for c in np.unique(component):
        own = np.flatnonzero(component == c)
        step[own] = np.diff(dc[own], prepend=0)

    def amplitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
        return size, np.where(v < 0, v + (1 << size) - 1, v)

    size, bits = amplitude(step)
    keys, values, lengths = [np.arange(n) * 256], [size << size | bits], [4 + size]
    row, k = np.nonzero(coefficients[:, 1:])
    k += 1
    before = np.zeros(len(k), np.int64)
    before[1:] = np.where(row[1:] == row[:-1], k[:-1], 0)
    run = k - before - 1
    size, bits = amplitude(coefficients[row, k])
    symbol = 2 + (run % 16) * 10 + size - 1
    keys.append(row * 256 + 2 * k + 1)
    values.append(symbol << size | bits)
    lengths.append(8 + size)
    far = np.repeat(np.arange(len(k)), run // 16)  # sixteen zeros each
    keys.append(row[far] * 256 + 2 * k[far])
    values.append(np.ones(len(far), np.int64))
    lengths.append(np.full(len(far), 8))
    last = np.zeros(n, np.int64)
    last[row] = k  # ascending within a row, so the last one stays
    ends = np.flatnonzero(last < 63)
    keys.append(ends * 256 + 200)
    values.append(np.zeros(len(ends), np.int64))
    lengths.append(np.full(len(ends), 8))
    order = np.argsort(np.concatenate(keys), kind="stable")
    value, length = np.concatenate(values)[order], np.concatenate(lengths)[order]
    upto = np.cumsum(length)
    place = np.repeat(upto, length) - np.arange(upto[-1]) - 1  # of each bit above its value's lowest
    flat = (np.repeat(value, length) >> place & 1).astype(np.uint8)
    packed = np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)]))
    return packed.tobytes().replace(b"\xff", b"\xff\0")


def encode(rgb: np.ndarray, knobs: dict) -> bytes:
    """A JFIF of RGB rows. Knobs: q from 1 to 100, ss one of SAMPLINGS."""
    quality, (sx, sy) = int(knobs.get("q", 85)), SAMPLINGS[knobs.get("ss", "4:2:0")]
    h, w, _ = rgb.shape
    padded = np.pad(rgb, ((0, -h % (8 * sy)), (0, -w % (8 * sx)), (0, 0)), mode="edge")
    ycc = to_ycc(padded)
    H, W = ycc.shape[:2]
    small = ycc[..., 1:].reshape(H // sy, sy, W // sx, sx, 2).mean((1, 3))
    tables = [quantiser(LUMINANCE, quality), quantiser(CHROMINANCE, quality)]
    D = cosines(8)
    planes = []
    for c, plane in enumerate((ycc[..., 0], small[..., 0], small[..., 1])):
        q = tables[min(c, 1)].reshape(8, 8)
        found = np.rint(D @ (blocks_of(plane) - 128) @ D.T / q).astype(np.int64)
        planes.append(found.reshape(*found.shape[:2], 64)[..., ZIGZAG])
    rows, cols = H // (8 * sy), W // (8 * sx)
    luma = planes[0].reshape(rows, sy, cols, sx, 64).swapaxes(1, 2).reshape(rows * cols, sx * sy, 64)
    units = np.concatenate([luma, *[p.reshape(rows * cols, 1, 64) for p in planes[1:]]], 1)
    component = np.tile([0] * (sx * sy) + [1, 2], rows * cols)
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].astype(np.uint8))) for i, t in enumerate(tables)]
    out.append(segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, sx << 4 | sy, 0, 2, 0x11, 1, 3, 0x11, 1])))
    out.append(segment(0xC4, bytes([0x00, 0, 0, 0, len(DC_SYMBOLS), *[0] * 12, *DC_SYMBOLS])))
    out.append(segment(0xC4, bytes([0x10, 0, 0, 0, 0, 0, 0, 0, len(AC_SYMBOLS), *[0] * 8, *AC_SYMBOLS])))
    out.append(segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])))
    return b"".join(out) + scan_bits(units.reshape(-1, 64), component) + b"\xff\xd9"


def segments(data: bytes) -> list[tuple[int, int, int]]:
    """Markers up to the first scan: marker, start and end of the whole segment."""
    if data[:2] != b"\xff\xd8":
        raise Unsupported("no JPEG")
    at, out = 2, []
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Unsupported(f"no marker at {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        out.append((marker, at, at + 2 + size))
        at += 2 + size
        if marker == 0xDA:
            break
    return out


def split_tables(data: bytes) -> tuple[bytes, bytes]:
    """A stream's quantisation and Huffman tables as a tables-only stream, and the abbreviated rest."""
    found = segments(data)
    tables = b"".join(data[a:b] for m, a, b in found if m in (0xDB, 0xC4))
    rest, at = [], 0
    for m, a, b in found:
        if m in (0xDB, 0xC4):
            rest.append(data[at:a])
            at = b
    return b"\xff\xd8" + tables + b"\xff\xd9", b"".join(rest) + data[at:]


def with_tables(data: bytes, tables: bytes) -> bytes:
    """An abbreviated stream made whole: the tables go behind its first marker."""
    body = b"".join(tables[a:b] for m, a, b in segments(tables) if m in (0xDB, 0xC4))
    return data[:2] + body + data[2:]


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # id, horizontal, vertical, quantiser
    quantisers: dict = field(default_factory=dict)
    codes: dict = field(default_factory=dict)
    scan: list = field(default_factory=list)
    interval: int = 0
    adobe: int | None = None
    start: int = 0


def read_frame(data: bytes) -> Frame:
    f = Frame()
    for marker, a, b in segments(data):
        body = data[a + 4 : b]
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                size = 128 if wide else 64
                f.quantisers[name] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                counts, n = body[1:17], sum(body[1:17])
                f.codes[body[0]] = lookup(bytes(counts), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3):
                raise Unsupported(f"{bits} bits, {n} components")
            f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
            raise Unsupported("not baseline")
        elif marker == 0xDD:
            f.interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xEE and body[:5] == b"Adobe":
            f.adobe = body[11]
        elif marker == 0xDA:
            f.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            f.start = b
    if not f.components or len(f.scan) != len(f.components):
        raise Unsupported("no frame, or a scan of some components")
    return f


@functools.lru_cache(maxsize=64)
def lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits the length of the code that they begin with and its symbol, as length << 8 | symbol."""
    out, code, i = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = [length << 8 | symbols[i]] * (1 << (16 - length))
            code, i = code + 1, i + 1
        code <<= 1
    return out


def read_units(data: bytes, f: Frame) -> list[np.ndarray]:
    """Every component's blocks in raster order: rows, columns, 64 coefficients in zigzag order."""
    sx, sy = max(c[1] for c in f.components), max(c[2] for c in f.components)
    if len(f.components) == 1:
        sx = sy = 1
        f.components = [(f.components[0][0], 1, 1, f.components[0][3])]
    cols, rows = -(-f.width // (8 * sx)), -(-f.height // (8 * sy))
    out = [np.zeros((rows * v, cols * h, 64), np.int64) for _, h, v, _ in f.components]
    tables = {c: (f.codes[d], f.codes[16 | a]) for c, d, a in f.scan}
    parts, at = [], f.start
    while True:  # stretches between restart markers, without the stuffed zeros
        end = at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                end = len(data)
                break
            if data[end + 1] == 0:
                end += 2
                continue
            break
        parts.append(data[at:end].replace(b"\xff\0", b"\xff") + b"\0" * 8)
        if end >= len(data) or not 0xD0 <= data[end + 1] <= 0xD7:
            break
        at = end + 2
    part, bit, last = 0, 0, [0] * len(f.components)
    raw = parts[0]

    def peek(n: int) -> int:
        byte = bit >> 3
        return int.from_bytes(raw[byte : byte + 4], "big") >> (32 - n - (bit & 7)) & ((1 << n) - 1)

    def signed(n: int) -> int:
        nonlocal bit
        if not n:
            return 0
        v = peek(n)
        bit += n
        return v if v >> (n - 1) else v - (1 << n) + 1

    for unit in range(rows * cols):
        if f.interval and unit and unit % f.interval == 0:
            part, bit, last = part + 1, 0, [0] * len(f.components)
            raw = parts[part]
        for i, (name, h, v, _) in enumerate(f.components):
            dc, ac = tables[name]
            for sub in range(h * v):
                block = out[i][unit // cols * v + sub // h, unit % cols * h + sub % h]
                found = dc[peek(16)]
                if not found or bit > 8 * len(raw):
                    raise ValueError("the scan is broken")
                bit += found >> 8
                last[i] += signed(found & 255)
                block[0] = last[i]
                k = 1
                while k < 64:
                    found = ac[peek(16)]
                    if not found or bit > 8 * len(raw):
                        raise ValueError("the scan is broken")
                    bit += found >> 8
                    symbol = found & 255
                    if not symbol:
                        break
                    k += symbol >> 4
                    if symbol & 15:
                        block[min(k, 63)] = signed(symbol & 15)
                    k += 1
    return out


def decode(data: bytes, tables: bytes | None = None, reduce: int = 1) -> np.ndarray:
    """RGB rows of a baseline JPEG; with `reduce` 2, 4 or 8 of that fraction of its sides, rounded up, from its low frequencies only."""
    if tables:
        data = with_tables(data, tables)
    f = read_frame(data)
    units = read_units(data, f)
    n = 8 // reduce
    D = cosines(n)
    sx, sy = max(c[1] for c in f.components), max(c[2] for c in f.components)
    w, h = -(-f.width // reduce), -(-f.height // reduce)
    planes = []
    for found, (_, cx, cy, q) in zip(units, f.components, strict=True):
        square = np.zeros(found.shape, np.float64)
        square[..., ZIGZAG] = found * f.quantisers[q]
        low = square.reshape(*found.shape[:2], 8, 8)[..., :n, :n] * (n / 8)
        pixels = (D.T @ low @ D + 128).swapaxes(1, 2).reshape(found.shape[0] * n, found.shape[1] * n)
        planes.append(np.repeat(np.repeat(pixels, sy // cy, 0), sx // cx, 1)[:h, :w])
    if len(planes) == 1:
        planes *= 3
        rgb = np.stack(planes, -1)
    else:
        whole = np.stack(planes, -1)
        plain = f.adobe == 0 or [c[0] for c in f.components] == [82, 71, 66]
        rgb = whole if plain else to_rgb(whole)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
