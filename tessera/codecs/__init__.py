"""Codecs by name: encoders of RGB tiles, inspectors of codestream headers. Others may be registered."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import jpeg as _jpeg


class Unavailable(RuntimeError):
    """The codec is known, but nothing here can encode it."""


@dataclass(frozen=True)
class Codec:
    name: str
    tag: int
    encode: Callable[[np.ndarray, dict], bytes] | None = None
    decode: Callable[[bytes], np.ndarray] | None = None
    knobs: dict = field(default_factory=dict)


def png_encode(rgb: np.ndarray, knobs: dict) -> bytes:
    """A PNG of 8-bit RGB: one IDAT, every row behind a filter byte 0."""
    h, w, _ = rgb.shape
    rows = np.zeros((h, 1 + 3 * w), np.uint8)
    rows[:, 1:] = rgb.reshape(h, 3 * w)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), int(knobs.get("level", 6)))) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """PNGs as png_encode writes them."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, held, w, h = 8, b"", 0, 0
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 2):
                raise ValueError("only 8-bit RGB")
        elif kind == b"IDAT":
            held += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(held), np.uint8).reshape(h, 1 + 3 * w)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].reshape(h, w, 3)


def raw_encode(rgb: np.ndarray, knobs: dict) -> bytes:
    return np.ascontiguousarray(rgb, np.uint8).tobytes()


def deflate_encode(rgb: np.ndarray, knobs: dict) -> bytes:
    return zlib.compress(raw_encode(rgb, knobs), int(knobs.get("level", 6)))


def lzw_encode(data: bytes) -> bytes:
    """TIFF LZW: codes of 9 to 12 bits, most significant first, growing one code early."""
    table = {bytes([i]): i for i in range(256)}
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        word = data[i : i + 1]
        size = len(table) + 2
        if size == 4095:
            put(256)
            table, width = {bytes([k]): k for k in range(256)}, 9
        elif size >= 1 << width:
            width += 1
    if word:
        put(table[word])
    if len(table) + 3 >= 1 << width and width < 12:
        width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, held, bits, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = table[:258], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


REGISTRY: dict[str, Codec] = {}


def register(codec: Codec) -> None:
    """The last registration of a name holds."""
    REGISTRY[codec.name] = codec


for _c in (
    Codec("png", 0, png_encode, png_decode),
    Codec("none", 1, raw_encode),
    Codec("deflate", 8, deflate_encode),
    Codec("lzw", 5, lambda rgb, knobs: lzw_encode(raw_encode(rgb, knobs))),
    Codec("jpeg", 7, _jpeg.encode, _jpeg.decode, knobs={"q": "85", "ss": "4:2:0"}),
    Codec("jpeg2000", 33003, knobs={"q": "85"}),
    Codec("htj2k", 60003, knobs={"q": "85"}),
    Codec("jpegxl", 50002, knobs={"distance": "1.0"}),
    Codec("avif", 60001, knobs={"q": "85"}),
    Codec("webp", 50001, knobs={"q": "85"}),
):
    register(_c)


def lookup(name: str) -> Codec:
    if name not in REGISTRY:
        raise KeyError(f"unknown codec {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def encode(name: str, rgb: np.ndarray, knobs: dict | None = None) -> bytes:
    codec = lookup(name)
    if codec.encode is None:
        raise Unavailable(f"no encoder for {name} is installed")
    return codec.encode(rgb, codec.knobs | (knobs or {}))


def decode(name: str, data: bytes, width: int, height: int, tables: bytes | None = None, reduce: int = 1) -> np.ndarray:
    """RGB rows of a tile of known sides; with `reduce` 2, 4 or 8 of that fraction, in the codec's own domain where it can."""
    codec = lookup(name)
    if name == "jpeg":
        return _jpeg.decode(data, tables, reduce)
    if name in ("none", "deflate", "lzw"):
        raw = data if name == "none" else zlib.decompress(data) if name == "deflate" else lzw_decode(data)
        rgb = np.frombuffer(raw, np.uint8)[: width * height * 3].reshape(height, width, 3)
    elif codec.decode is not None:
        rgb = codec.decode(data)
    else:
        raise Unavailable(f"no decoder for {name} is installed")
    while reduce > 1:
        wide = np.pad(rgb, ((0, rgb.shape[0] % 2), (0, rgb.shape[1] % 2), (0, 0)), mode="edge").astype(np.int32)
        rgb = ((wide[0::2, 0::2] + wide[1::2, 0::2] + wide[0::2, 1::2] + wide[1::2, 1::2]) // 4).astype(np.uint8)
        reduce //= 2
    return rgb


def emitted_sampling(name: str, knobs: dict | None = None) -> str:
    """The chroma subsampling that an encoder really writes, read from the header of a small tile; empty where it has none."""
    from .headers import inspect

    grey = np.full((16, 16, 3), 128, np.uint8)
    return inspect(name, encode(name, grey, knobs)).get("chroma", "") if lookup(name).encode else ""


def health() -> list[tuple[str, str, int]]:
    """For every codec whether it really encodes a grey tile: name, ok or unavailable, bytes."""
    grey = np.full((64, 64, 3), 128, np.uint8)
    out = []
    for name in sorted(REGISTRY):
        try:
            out.append((name, "ok", len(encode(name, grey))))
        except Unavailable:
            out.append((name, "unavailable", 0))
    return out
