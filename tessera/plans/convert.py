"""The planner of conversions: from a request and a slide's facts to the cheapest plan that gives the same tiles."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.codes import CAPABILITIES, COPIED, TILED_FORMATS

ORDERS = {"cog-wsi": ("hilbert", "morton", "row-major"), "tiff": ("hilbert", "morton", "row-major"), "svs": ("row-major",), "ome-tiff": ("row-major",)}
FACTORS = (1, 2, 4, 8, 16)


class Refused(ValueError):
    """A request that no plan can meet."""


@dataclass(frozen=True)
class Request:
    to: str = ""
    codec: str = ""
    quality: str = ""
    factor: int = 1
    target_magnification: float = 0.0
    rect: tuple[int, int, int, int] | None = None
    tile: int = 0
    order: str = "row-major"
    lossless: bool = False
    allow_nonconformant: bool = False
    no_associated: bool = False


@dataclass(frozen=True)
class Source:
    format: str
    width: int
    height: int
    tile: int
    codec: str
    levels: tuple[tuple[int, int], ...] = ()
    magnification: float = 0.0
    mpp: float = 0.0
    overlapping: bool = False
    bits: int = 8
    channels: int = 3
    quality: int = 0


@dataclass(frozen=True)
class Plan:
    how: str  # copy, octaves, engine, crop or lossless-crop
    to: str
    codec: str
    quality: dict = field(default_factory=dict)
    factor: int = 1
    tile: int = 256
    width: int = 0
    height: int = 0
    mpp: float = 0.0
    magnification: float = 0.0
    rect: tuple[int, int, int, int] | None = None
    octaves: tuple[int, ...] = ()
    warnings: tuple[str, ...] = ()
    overlap: int = 0
    order: str = "row-major"


def check_codec(container: str, codec: str, allowed: bool) -> str | None:
    """A warning, or None; an error for what the container can't hold."""
    good, loose = CAPABILITIES.get(container, ((), ()))
    if codec in good:
        return None
    if codec in loose:
        if allowed:
            return f"{codec} in {container} does not conform"
        raise Refused(f"{codec} in {container} does not conform; allow it expressly")
    raise Refused(f"{container} cannot hold {codec}")


def resolve_factor(request: Request, source: Source) -> int:
    if request.target_magnification:
        if source.magnification <= 0:
            raise Refused("the source's magnification is unknown")
        ratio = source.magnification / request.target_magnification
        factor = int(ratio + 0.0001)
        if factor not in FACTORS[1:] or factor != ratio:
            raise Refused(f"{source.magnification:g}x to {request.target_magnification:g}x is not a factor of 2, 4, 8 or 16")
        return factor
    if request.factor not in FACTORS:
        raise Refused(f"factor {request.factor} is not 1, 2, 4, 8 or 16")
    return request.factor


def octaves_of(source: Source, tolerance: int = 2) -> tuple[int, ...] | None:
    """The octaves of the source's levels; None if a level is off its octave or two share one."""
    out = []
    for w, h in source.levels or ((source.width, source.height),):
        kw, kh = (floor(log2(a / b) + 0.5) for a, b in ((source.width, w), (source.height, h)))
        if kw != kh or kw < 0 or any(abs(-(-a // 2**kw) - b) > tolerance for a, b in ((source.width, w), (source.height, h))):
            return None
        out.append(kw)
    return tuple(out) if len(set(out)) == len(out) else None


def knobs(codec: str, quality: str, source_quality: int) -> dict:
    """The encoder's knobs: what is asked for; else the default, but not below the source's own estimate."""
    if codec in ("png", "none", "lzw", "deflate"):
        return {}
    if not quality:
        return {"distance": "1.0"} if codec == "jpegxl" else {"q": str(max(85, source_quality))}
    out = {"q": "85"}
    if "=" in quality:
        for part in quality.split(","):
            k, eq, v = (x.strip() for x in part.partition("="))
            if not eq or not k:
                raise Refused(f"{part!r} is no key=value")
            out[k] = v
    else:
        out["q"] = quality.strip()
    if not out["q"].isdigit() or not 1 <= int(out["q"]) <= 100:
        raise Refused(f"quality {out['q']!r} is not 1 to 100")
    return out


def plan(request: Request, source: Source) -> Plan:
    """Checks in the order in which a user meets them, then the first way that applies: copy, octaves, engine."""
    if source.bits != 8 or source.channels not in (1, 3):
        raise Refused("only 8-bit sources of one or three channels")
    factor = resolve_factor(request, source)
    to = request.to or {"generic-tiff": "tiff"}.get(source.format, source.format)
    if to not in CAPABILITIES:
        raise Refused(f"{to} is no target")
    if request.lossless and (to not in ("dzi", "szi") and request.rect is None or factor > 1):
        raise Refused("lossless needs dzi, szi or a rectangle, and no factor")
    codec = request.codec or (source.codec if source.codec in CAPABILITIES[to][0] + CAPABILITIES[to][1] else "png" if to in ("dzi", "szi") else "jpeg")
    warning = check_codec(to, codec, request.allow_nonconformant)
    if request.order not in ORDERS.get(to, ("row-major",)):
        raise Refused(f"{to} does not take the order {request.order}")
    if to == "ife" and (request.tile or 256) != 256:
        raise Refused("ife has tiles of 256 pixels")
    tile = 256 if to == "ife" else request.tile or source.tile or 256
    width, height = source.width // factor, source.height // factor
    if min(width, height) < 1:
        raise Refused("nothing is left of the image")
    rect = request.rect
    if rect:
        x, y, w, h = rect
        if w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > source.width or y + h > source.height:
            raise Refused("the rectangle is not inside the image")
        if request.lossless:
            x0, y0 = x // source.tile * source.tile, y // source.tile * source.tile
            rect = (x0, y0, min(-(-(x + w) // source.tile) * source.tile, source.width) - x0, min(-(-(y + h) // source.tile) * source.tile, source.height) - y0)
        width, height = rect[2] // factor, rect[3] // factor
    octaves = octaves_of(source)
    tiled = source.format in TILED_FORMATS
    same_tile = not request.tile or request.tile == source.tile
    copied = same_tile and to not in ("dzi", "szi") and not request.codec and tiled and source.codec in COPIED.get(to, ()) and factor == 1 and not rect
    if to == "ife":
        copied = not request.codec and source.tile == 256 and source.codec in ("jpeg", "avif") and not source.overlapping and factor == 1 and not rect
    shift = factor.bit_length() - 1
    if rect:
        how = "lossless-crop" if request.lossless else "crop"
    elif copied and not source.overlapping:
        how = "copy"
    elif octaves and tiled and not source.overlapping and shift in octaves:
        how = "octaves"
    else:
        how = "engine"
    kept = tuple(k - shift for k in octaves or () if k >= shift)
    return Plan(how, to, codec, {} if how == "copy" else knobs(codec, request.quality, source.quality), factor, tile, width, height, source.mpp * factor, source.magnification / factor, rect, kept, (warning,) if warning else (), int(to in ("dzi", "szi")), request.order)


def output_levels(p: Plan) -> list[tuple[int, int, int]]:
    """Levels (octave, width, height) that a plan writes: the source's octaves, or all down to one tile; a Deep Zoom
    pyramid has all down to one pixel."""
    out, k, w, h = [], 0, p.width, p.height
    deep = p.to in ("dzi", "szi")
    while True:
        if deep or not p.octaves or k in p.octaves:
            out.append((k, w, h))
        if max(w, h) <= 1 if deep else (k >= max(p.octaves)) if p.octaves and p.how in ("octaves", "crop") else min(w, h) <= p.tile:
            return out
        k, w, h = k + 1, -(-w // 2), -(-h // 2)


def numbers(p: Plan) -> dict[int, int]:
    """The number that a container gives to each octave: from the finest on, but in a Deep Zoom pyramid from the coarsest."""
    levels = output_levels(p)
    return {k: len(levels) - 1 - i if p.to in ("dzi", "szi") else i for i, (k, _, _) in enumerate(levels)}


#: Containers whose tiles are all of full size.
FULL_TILES = ("tiff", "svs", "ome-tiff", "cog-wsi", "dicom", "bif", "ife")
TILES_OUT = "level int, col int, row_ int, bytes binary"


def cropped(p: Plan, pixels: DataFrame) -> DataFrame:
    """The plan's image at its own size: the rectangle at the origin, reduced by the factor."""
    from tessera.operators import pyramid as P

    image = P.crop(pixels, *p.rect) if p.rect else pixels.select("x", "y", "r", "g", "b")
    shift = p.factor.bit_length() - 1
    if shift:
        image = P.pyramid(image, shift).where(F.col("level") == shift).where((F.col("x") < p.width) & (F.col("y") < p.height)).drop("level")
    return image


def encoded_tiles(p: Plan, levels: DataFrame) -> DataFrame:
    """Tiles (level, col, row_, bytes) of pixels (level, x, y, r, g, b) whose levels are octaves of the plan.

    A task holds one tile. Neighbours' pixels come along where tiles overlap; tiles at an edge are filled up by its last
    pixels where the container wants full ones.
    """
    import numpy as np
    import pyarrow as pa

    from tessera.codecs import encode
    from tessera.operators import pyramid as P
    from tessera.shipping import ship

    ship(levels.sparkSession)
    shape, number = output_levels(p), numbers(p)

    def literal(values: dict[int, int]) -> Column:
        return F.coalesce(*[F.when(F.col("octave") == k, F.lit(v).cast("bigint")) for k, v in values.items()])

    rows = levels.withColumnRenamed("level", "octave").where(F.col("octave").isin(*number))
    rows = P.retile(rows, literal({k: w for k, w, _ in shape}), literal({k: h for k, _, h in shape}), p.tile, p.overlap, ("octave",))
    size, codec, quality, full = p.tile, p.codec, p.quality, p.to in FULL_TILES

    def encoded(table: pa.Table) -> pa.Table:
        level, col, row = (table.column(c)[0].as_py() for c in ("level", "col", "row_"))
        x, y = table.column("px").to_numpy(), table.column("py").to_numpy()
        raster = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), np.uint8)
        raster[y, x] = np.stack([table.column(c).to_numpy() for c in "rgb"], 1)
        if full:
            raster = np.pad(raster, ((0, size - raster.shape[0]), (0, size - raster.shape[1]), (0, 0)), mode="edge")
        return pa.table({"level": pa.array([level], pa.int32()), "col": pa.array([col], pa.int32()), "row_": pa.array([row], pa.int32()), "bytes": pa.array([encode(codec, raster, quality)], pa.binary())})

    cells = rows.select(literal(number).cast("int").alias("level"), F.col("col").cast("int").alias("col"), F.col("row_").cast("int").alias("row_"), "px", "py", "r", "g", "b")
    return cells.groupBy("level", "col", "row_").applyInArrow(encoded, TILES_OUT)


def execute(p: Plan, pixels: DataFrame | None, tiles: DataFrame | None = None) -> DataFrame:
    """Output tiles (level, col, row_, bytes): copied as they are, or encoded from reduced pixels.

    A lossless crop keeps the source's tiles on its finest level and encodes the levels below from their pixels.
    """
    from tessera.operators import pyramid as P

    if p.how in ("copy", "lossless-crop") and tiles is None:
        raise Refused("a copy needs the source's tiles")
    if p.how == "copy":
        return tiles.select("level", "col", "row_", "bytes")
    image = cropped(p, pixels)
    deepest = max(k for k, _, _ in output_levels(p))
    every = image.select(F.lit(0).alias("level"), "x", "y", "r", "g", "b")
    if deepest:
        every = every.unionByName(P.pyramid(image, deepest))
    if p.how != "lossless-crop" or p.overlap:
        return encoded_tiles(p, every)
    x, y, w, h = p.rect
    col, row = F.col("col") - x // p.tile, F.col("row_") - y // p.tile
    finest = tiles.where(F.col("level") == 0).select(F.lit(numbers(p)[0]).alias("level"), col.cast("int").alias("col"), row.cast("int").alias("row_"), "bytes")
    finest = finest.where(F.col("col").between(0, -(-w // p.tile) - 1) & F.col("row_").between(0, -(-h // p.tile) - 1))
    return finest.unionByName(encoded_tiles(p, every.where(F.col("level") > 0)))
