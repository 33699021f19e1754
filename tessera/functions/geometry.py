"""Geometry of levels, tiles and rectangles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FACTORS = (2, 4, 8, 16)


def big(value: Column | int) -> Column:
    return value.cast("bigint") if isinstance(value, Column) else F.lit(value).cast("bigint")


def whole_div(a: Column | int, b: Column | int) -> Column:
    """Integer division that rounds toward zero, in 64 bits."""
    a, b = big(a), big(b)
    return F.floor((a - F.pmod(a, b)) / b).cast("bigint")


def ceil_div(n: Column, d: Column | int) -> Column:
    """ceil(n / d), but at least 1."""
    return F.greatest(F.lit(1).cast("bigint"), whole_div(n + d - 1, d))


def power2(k: Column) -> Column:
    return F.expr("1L") * F.pow(F.lit(2.0), k).cast("bigint")


def ceil_halved(size: Column, times: Column) -> Column:
    """A side after so many halvings that round up."""
    return whole_div(size + power2(times) - 1, power2(times))


def align_up(n: Column, unit: int) -> Column:
    return whole_div(n + (unit - 1), unit) * unit


def next_power2(n: Column) -> Column:
    return power2(F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))))


def dzi_max_level(w: Column, h: Column) -> Column:
    """The number of halvings from the longer side down to 1."""
    return F.length(F.regexp_replace(F.bin(F.greatest(w, h) - 1), "^0$", "")).cast("bigint")


def edge_extent(size: Column, tile: Column, index: Column) -> Column:
    """The side of a tile that may be cut by the level's edge."""
    return F.least(tile, size - index * tile)


def floored_levels(w: Column, h: Column, tile: Column) -> Column:
    """Levels of a pyramid that stops at the first whose shorter side is at most a tile."""
    short = F.least(w, h)
    return F.array_min(F.filter(F.sequence(F.lit(0), F.lit(40)), lambda n: ceil_halved(short, n) <= tile)).cast("bigint") + 1


def octave(full: Column, size: Column) -> Column:
    """round(log2(full / size)), halves upward."""
    return F.floor(F.ln(full.cast("double") / size) / F.ln(F.lit(2.0)) + 0.5).cast("bigint")


def factor_for_magnification(magnification: Column, target: Column) -> Column:
    """The factor from a target magnification; null if it is not one of FACTORS exactly, or the source's is unknown."""
    ratio = magnification / F.nullif(target, F.lit(0.0))
    factor = F.floor(ratio + 0.0001).cast("bigint")
    return F.when((magnification > 0) & factor.isin(*FACTORS) & (factor == ratio), factor)


def pixels_per_cm(mpp: Column) -> tuple[Column, Column]:
    """Resolution as numerator and denominator: (0, 0) if the pixel size is unknown, saturating at 32 bits."""
    top = (1 << 32) - 1
    known = (mpp > 0) & ~F.isnan(mpp)
    scaled = F.floor(F.lit(100000.0) / F.when(known, mpp) + 0.5)
    return F.when(known, F.least(scaled, F.lit(float(top)))).otherwise(0).cast("bigint"), F.when(known, F.lit(10)).otherwise(0).cast("bigint")


def thumb_extent(size: Column, longest: Column, most: int) -> Column:
    """A thumbnail's side: the longest becomes `most`, never larger than it was, at least 1."""
    return F.greatest(F.lit(1).cast("bigint"), F.when(longest <= most, size).otherwise(F.floor(size.cast("double") * most / longest + 0.5).cast("bigint")))


def letterbox(sw: Column, sh: Column, dw: Column, dh: Column) -> dict[str, Column]:
    """An image fitted into a canvas: its scaled sides, truncated, and where it lies in the middle."""
    scale = F.least(dw.cast("double") / sw, dh.cast("double") / sh)
    w, h = (F.greatest(F.lit(1).cast("bigint"), F.floor(x.cast("double") * scale).cast("bigint")) for x in (sw, sh))
    return {"fit_w": w, "fit_h": h, "fit_x": whole_div(dw - w, 2), "fit_y": whole_div(dh - h, 2)}


def aspect_mismatch(sw: Column, sh: Column, dw: Column, dh: Column) -> Column:
    a, b = sw.cast("double") / sh, dw.cast("double") / dh
    return F.greatest(a / b, b / a) > 2.0


def snapped(x: Column, y: Column, w: Column, h: Column, tile: Column | int, bw: Column | int, bh: Column | int) -> dict[str, Column]:
    """A rectangle snapped outward to the tile grid, inside the image."""
    x0, y0 = whole_div(x, tile) * tile, whole_div(y, tile) * tile
    x1 = F.least(whole_div(x + w + tile - 1, tile) * tile, big(bw))
    y1 = F.least(whole_div(y + h + tile - 1, tile) * tile, big(bh))
    return {"snap_x": x0, "snap_y": y0, "snap_w": x1 - x0, "snap_h": y1 - y0}


def overlap(tile_x: Column, tile_y: Column, tile_w: Column, tile_h: Column, x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """Where a tile (in pixels) meets a rectangle: place in the tile, place in the rectangle, extent (not positive: apart)."""
    left, top = F.greatest(tile_x, x), F.greatest(tile_y, y)
    right, bottom = F.least(tile_x + tile_w, x + w), F.least(tile_y + tile_h, y + h)
    return {"local_x": left - tile_x, "local_y": top - tile_y, "dst_x": left - x, "dst_y": top - y, "ow": right - left, "oh": bottom - top}
