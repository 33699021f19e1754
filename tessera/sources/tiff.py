"""TIFF directories: a walker for classic and big files in both byte orders, and an encoder."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.codes import COMPRESSION_NAMES, PRIVATE_TAGS, TAG_NAMES, TYPE_NAMES, TYPE_SIZES
from tessera.shipping import ship

from .files import Ranged

FORMATS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "s", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
ENTRY = "path string, ifd int, parent int, ifd_offset long, tag int, tag_name string, type_name string, n long, value string, truncated boolean"
#: What a dump shows of long values.
MOST_ENTRIES, MOST_CHARACTERS, MOST_BYTES = 8, 200, 64


@dataclass
class Header:
    order: str
    big: bool
    first: int


#: The longest value that is read: more than any real tag has.
MOST_VALUE = 256 << 20


def unpack(form: str, data, at: int) -> tuple:
    """struct.unpack_from for bytes and for a file that is read by ranges."""
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


def read_header(data) -> Header:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("no TIFF byte order")
    magic = unpack(order + "H", data, 2)[0]
    if magic == 42:
        return Header(order, False, unpack(order + "I", data, 4)[0])
    if magic == 43:
        size, zero, first = unpack(order + "HHQ", data, 4)
        if (size, zero) == (8, 0):
            return Header(order, True, first)
    raise ValueError("no TIFF magic")


def read_directory(data, head: Header, at: int) -> tuple[list[tuple[int, int, int, object]], int]:
    """Entries (tag, type, count, value) of the directory at an offset, and the offset of the next."""
    o, wide = head.order, head.big
    n = unpack(o + ("Q" if wide else "H"), data, at)[0]
    at += 8 if wide else 2
    out = []
    for _ in range(n):
        tag, kind, count = unpack(o + ("HHQ" if wide else "HHI"), data, at)
        size, room = TYPE_SIZES.get(kind, 0) * count, 8 if wide else 4
        if size > MOST_VALUE:
            raise ValueError(f"tag {tag} has {size} bytes, more than {MOST_VALUE}")
        place = at + (12 if wide else 8)
        start = place if size <= room else unpack(o + ("Q" if wide else "I"), data, place)[0]
        out.append((tag, kind, count, decoded(data[start : start + size], kind, count, o)))
        at += 20 if wide else 12
    return out, unpack(o + ("Q" if wide else "I"), data, at)[0]


def decoded(raw: bytes, kind: int, count: int, order: str) -> object:
    if kind == 2:
        return raw.split(b"\0", 1)[0].decode("utf-8", "replace")
    if kind == 7 or kind not in TYPE_SIZES:
        return raw
    if kind in (5, 10):
        numbers = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
        return [f"{a}/{b}" for a, b in zip(numbers[::2], numbers[1::2], strict=True)]
    return list(struct.unpack(order + FORMATS[kind] * count, raw))


def walk(data) -> Iterator[tuple[int, int | None, int, list]]:
    """Directories (number, parent, offset, entries): the main chain first, then each one's sub-directories in order.

    An offset that comes again is a loop and an error.
    """
    head, seen, main = read_header(data), set(), []

    def chain(at: int) -> Iterator[tuple[int, list]]:
        while at:
            if at in seen:
                raise ValueError(f"directories loop at {at}")
            seen.add(at)
            entries, following = read_directory(data, head, at)
            yield at, entries
            at = following

    number = 0
    for at, entries in chain(head.first):
        main.append(entries)
        yield number, None, at, entries
        number += 1
    for parent, entries in enumerate(main):
        for tag, _, _, value in entries:
            if tag == 330:
                for sub in value:
                    for at, more in chain(sub):
                        yield number, parent, at, more
                        number += 1


def shown(value: object, full: bool) -> tuple[str, bool]:
    """A value as JSON text, cut unless `full`, and whether it was."""
    if isinstance(value, bytes):
        return json.dumps(value[: None if full else MOST_BYTES].hex()), not full and len(value) > MOST_BYTES
    if isinstance(value, str):
        return json.dumps(value[: None if full else MOST_CHARACTERS]), not full and len(value) > MOST_CHARACTERS
    return json.dumps(value[: None if full else MOST_ENTRIES]), not full and len(value) > MOST_ENTRIES


def parsed(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in ENTRY.split(", ")]
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            for number, parent, at, entries in walk(Ranged(path)):
                for tag, kind, n, value in entries:
                    rows.append((path, number, parent, at, tag, TAG_NAMES.get(tag, ""), TYPE_NAMES.get(kind, f"TYPE_{kind}"), n, *shown(value, full)))
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def read_entries(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """A row for every directory entry of the TIFF files under a path: ENTRY's columns. Spark lists the files, and of each
    only the ranges that hold directories are read."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(lambda it: parsed(it, full), ENTRY)


def read_directories(spark: SparkSession, path: str) -> DataFrame:
    """A row for every directory: path, ifd, parent, ifd_offset, width, height, tile_w, tile_h, compression, photometric,
    whether it has any of the private tags, description."""
    from pyspark.sql import functions as F

    entries = read_entries(spark, path, full=True)

    def number(tag: int):
        return F.max(F.when(F.col("tag") == tag, F.get_json_object("value", "$[0]").cast("bigint")))

    rows = entries.groupBy("path", "ifd", "parent", "ifd_offset").agg(
        F.bool_or(F.col("tag").isin(*PRIVATE_TAGS)).alias("has_private"), number(262).alias("photometric"), number(256).alias("width"), number(257).alias("height"), number(322).alias("tile_w"), number(323).alias("tile_h"), number(259).alias("tag"), F.max(F.when(F.col("tag") == 270, F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"))).alias("description")
    )
    named = F.coalesce(*[F.when(F.col("tag") == k, v) for k, v in COMPRESSION_NAMES.items()], F.concat(F.lit("tag-"), F.col("tag").cast("string")))
    return rows.select("path", "ifd", "parent", "ifd_offset", "width", "height", "tile_w", "tile_h", named.alias("compression"), "photometric", "has_private", "description")


class Entries:
    """Builds one directory: entries in order of their tags, small values inside, others behind it."""

    def __init__(self, big: bool):
        self.big, self.rows = big, {}

    def add(self, tag: int, kind: int, values) -> Entries:
        if kind == 2:
            raw = values.encode() + b"\0"
            self.rows[tag] = (kind, len(raw), raw)
        elif kind == 7:
            self.rows[tag] = (kind, len(values), bytes(values))
        else:
            values = list(values) if isinstance(values, (list, tuple)) else [values]
            flat = [x for v in values for x in v] if kind == 5 else values
            self.rows[tag] = (kind, len(values), struct.pack("<" + ("I" if kind == 5 else FORMATS[kind]) * len(flat), *flat))
        return self

    def size(self) -> int:
        """Bytes of the directory with what lies behind it, each value at an even offset."""
        room = 8 if self.big else 4
        head = 8 + 20 * len(self.rows) + 8 if self.big else 2 + 12 * len(self.rows) + 4
        return head + head % 2 + sum(len(r) + len(r) % 2 for _, _, r in self.rows.values() if len(r) > room)

    def encode(self, at: int, following: int) -> bytes:
        room = 8 if self.big else 4
        head = 8 + 20 * len(self.rows) + 8 if self.big else 2 + 12 * len(self.rows) + 4
        place, out, behind = at + head + head % 2, [], []
        out.append(struct.pack("<Q" if self.big else "<H", len(self.rows)))
        for tag, (kind, n, raw) in sorted(self.rows.items()):
            out.append(struct.pack("<HHQ" if self.big else "<HHI", tag, kind, n))
            if len(raw) <= room:
                out.append(raw.ljust(room, b"\0"))
            else:
                out.append(struct.pack("<Q" if self.big else "<I", place))
                behind.append(raw + b"\0" * (len(raw) % 2))
                place += len(behind[-1])
        out.append(struct.pack("<Q" if self.big else "<I", following))
        body = b"".join(out)
        return body + b"\0" * (len(body) % 2) + b"".join(behind)
