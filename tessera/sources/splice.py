"""Edits of a TIFF file's directory chain: what lies before the edit stays where it is, the rest is written anew."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from tessera.functions.codes import TYPE_SIZES

from .files import Ranged, copied, put
from .tiff import FORMATS, Header, read_directory, read_header, unpack

#: Tags that place data, and those of its sizes.
DATA = {273: 279, 324: 325}


class Interleaved(ValueError):
    """An earlier directory has bytes behind the edit: the file must be rebuilt."""


@dataclass(frozen=True)
class Range:
    start: int
    end: int
    owner: int
    what: str


def directory_ranges(data) -> tuple[Header, list[int], list[Range]]:
    """The chain's offsets and the byte ranges of every directory: itself, values outside it, strips or tiles.

    Sub-directories, loops, and ranges that are empty or overlap are refused.
    """
    head = read_header(data)
    at, chain, out = head.first, [], []
    while at:
        if at in chain:
            raise ValueError(f"directories loop at {at}")
        owner = len(chain)
        chain.append(at)
        entries, following = read_directory(data, head, at)
        size = 16 + 20 * len(entries) if head.big else 6 + 12 * len(entries)
        out.append(Range(at, at + size, owner, "directory"))
        values = {t: v for t, _, _, v in entries}
        if 330 in values:
            raise ValueError("sub-directories are not edited")
        for i, (tag, kind, count, _) in enumerate(entries):
            nbytes = TYPE_SIZES.get(kind, 0) * count
            if nbytes > (8 if head.big else 4):
                place = at + (8 + 20 * i + 12 if head.big else 2 + 12 * i + 8)
                start = unpack(head.order + ("Q" if head.big else "I"), data, place)[0]
                out.append(Range(start, start + nbytes, owner, f"tag {tag}"))
        for places, sizes in DATA.items():
            out += [Range(a, a + n, owner, "data") for a, n in zip(values.get(places, []), values.get(sizes, []), strict=True) if n]
        at = following
    ordered = sorted(out, key=lambda r: (r.start, r.end))
    for a, b in zip(ordered, ordered[1:]):
        if a.end > b.start and (a.start, a.end) != (b.start, b.end):
            raise ValueError(f"{a.what} of directory {a.owner} and {b.what} of {b.owner} overlap")
    return head, chain, ordered


def cutoff(ranges: list[Range], target: int, size: int) -> int:
    """Where the rewriting begins: the least start of the target's and all later ranges. An earlier one behind it refuses."""
    at = min((r.start for r in ranges if r.owner >= target), default=size)
    if any(r.owner < target and r.end > at for r in ranges):
        raise Interleaved(f"an earlier directory has bytes behind {at}")
    return at


#: Data of a directory: bytes, or a range (start, end) of the file.
Blob = bytes | tuple[int, int]


def size_of(blob: Blob) -> int:
    return blob[1] - blob[0] if isinstance(blob, tuple) else len(blob)


def laid_out(entries: list[tuple], blobs: list[Blob], head: Header, at: int) -> tuple[list[Blob], int, int]:
    """A directory at an offset, with its data and outer values behind it, as pieces; the place of its next-pointer in it,
    and its whole size."""
    big, o = head.big, head.order
    size = 16 + 20 * len(entries) if big else 6 + 12 * len(entries)
    place = at + size + size % 2
    behind: list[Blob] = []
    offsets = []
    for b in blobs:
        offsets.append(place)
        behind += [b, b"\0" * (size_of(b) % 2)]
        place += size_of(b) + size_of(b) % 2
    rows = []
    for tag, kind, count, value in sorted(entries):
        if tag in DATA and blobs:
            value = offsets
        raw = packed(value, kind, o)
        if len(raw) > (8 if big else 4):
            rows.append(struct.pack(o + ("HHQQ" if big else "HHII"), tag, kind, count, place))
            behind.append(raw + b"\0" * (len(raw) % 2))
            place += len(behind[-1])
        else:
            rows.append(struct.pack(o + ("HHQ" if big else "HHI"), tag, kind, count) + raw.ljust(8 if big else 4, b"\0"))
    body = struct.pack(o + ("Q" if big else "H"), len(entries)) + b"".join(rows)
    pointer = len(body)
    body += struct.pack(o + ("Q" if big else "I"), 0)
    return [body + b"\0" * (len(body) % 2), *behind], pointer, place - at


def emitted(entries: list[tuple], blobs: list[bytes], head: Header, at: int) -> tuple[bytes, int]:
    pieces, pointer, _ = laid_out(entries, blobs, head, at)
    return b"".join(pieces), pointer


def packed(value, kind: int, order: str) -> bytes:
    if kind == 2:
        return value.encode() + b"\0"
    if isinstance(value, bytes):
        return value
    if kind in (5, 10):
        return struct.pack(order + ("I" if kind == 5 else "i") * 2 * len(value), *[int(x) for v in value for x in v.split("/")])
    return struct.pack(order + FORMATS[kind] * len(value), *value)


@dataclass(frozen=True)
class Edit:
    """An edited file: what is kept of the old one from its start, a new link in it, and the pieces behind."""

    keep: int
    link: int
    target: bytes
    pieces: tuple[Blob, ...]


def edited(data, target: int, mode: str, entries: list[tuple] | None = None, blobs: list[bytes] | None = None) -> Edit:
    """Directory `target` of a file (bytes, or one read by ranges) removed, replaced by (entries, blobs), or those inserted
    before it; a target behind the last appends. Bytes before the cutoff are kept; the directories behind are written
    again with their data, which stays a range of the old file."""
    head, chain, ranges = directory_ranges(data)
    target = min(target, len(chain))
    at = cutoff(ranges, target, len(data))
    parts: list[tuple[list[tuple], list[Blob]]] = []
    if mode in ("replace", "insert"):
        parts.append((entries or [], list(blobs or [])))
    for number in range(target + (mode in ("replace", "remove")), len(chain)):
        rows, _ = read_directory(data, head, chain[number])
        values = {t: v for t, _, _, v in rows}
        parts.append((rows, [(a, a + n) for p, s in DATA.items() for a, n in zip(values.get(p, []), values.get(s, []), strict=True)]))
    width = head.order + ("Q" if head.big else "I")
    if target == 0:
        link = 8 if head.big else 4
    else:
        n = unpack(head.order + ("Q" if head.big else "H"), data, chain[target - 1])[0]
        link = chain[target - 1] + (8 + 20 * n if head.big else 2 + 12 * n)
    pieces: list[Blob] = [b"\0" * (at % 2)]
    end = at + at % 2
    first, link_at = struct.pack(width, end if parts else 0), None
    for rows, own in parts:
        if link_at is not None:  # the directory before, which is the first of its pieces
            k, pointer = link_at
            body = bytearray(pieces[k])
            struct.pack_into(width, body, pointer, end)
            pieces[k] = bytes(body)
        made, pointer, size = laid_out(rows, own, head, end)
        link_at = (len(pieces), pointer)
        pieces += made
        end += size
    return Edit(at, link, first, tuple(pieces))


def splice(data: bytes, target: int, mode: str, entries: list[tuple] | None = None, blobs: list[bytes] | None = None) -> bytes:
    """`edited`, as bytes."""
    e = edited(data, target, mode, entries, blobs)
    out = bytearray(data[: e.keep])
    out[e.link : e.link + len(e.target)] = e.target
    return bytes(out) + b"".join(data[x[0] : x[1]] if isinstance(x, tuple) else x for x in e.pieces)


def splice_file(source: str, target: str, number: int, mode: str, entries: list[tuple] | None = None, blobs: list[bytes] | None = None) -> int:
    """`edited` from one file to another, a block at a time; the new file's size."""
    data = Ranged(source)
    try:
        e = edited(data, number, mode, entries, blobs)

        def chunks() -> Iterator[bytes]:
            at = 0
            for chunk in copied(source, e.keep):
                lo, hi = max(e.link, at), min(e.link + len(e.target), at + len(chunk))
                if lo < hi:
                    chunk = chunk[: lo - at] + e.target[lo - e.link : hi - e.link] + chunk[hi - at :]
                at += len(chunk)
                yield chunk
            for x in e.pieces:
                if isinstance(x, bytes):
                    yield x
                    continue
                for lo in range(x[0], x[1], 1 << 22):
                    yield data.source.read_at(min(1 << 22, x[1] - lo), lo)

        return put(target, chunks())
    finally:
        data.close()
