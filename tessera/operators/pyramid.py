"""Operators on pixels (x, y, r, g, b): box reduction, pyramids, re-tiling, padding, filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import whole_div
from tessera.session import settled
from tessera.shipping import ship

CHANNELS = ("r", "g", "b")


Size = int | Column
Keys = tuple[str, ...]


def sized(value: Size) -> Column:
    """A side given as a number for all rasters, or as a column of each row's own."""
    return F.lit(value).cast("bigint") if isinstance(value, int) else value


def box_halve(pixels: DataFrame, width: Size, height: Size, duplicate_edge: bool = True, keys: Keys = ()) -> DataFrame:
    """Means of 2 x 2 pixels, truncated. An odd last column or row counts twice, or without `duplicate_edge` not at all.

    `keys` name the columns that tell rasters apart; sides may be columns.
    """
    width, height = sized(width), sized(height)

    def weight(at: str, size: Column) -> Column:
        return F.when((F.col(at) == size - 1) & (size % 2 == 1), 2).otherwise(1)

    rows = pixels if duplicate_edge else pixels.where((F.col("x") < width - width % 2) & (F.col("y") < height - height % 2))
    each = weight("x", width) * weight("y", height) if duplicate_edge else F.lit(1)
    grouped = rows.groupBy(*keys, whole_div(F.col("x"), 2).alias("x"), whole_div(F.col("y"), 2).alias("y"))
    return grouped.agg(*[F.floor(F.sum(F.col(c) * each) / 4).cast("int").alias(c) for c in CHANNELS])


def halved(raster: np.ndarray) -> np.ndarray:
    """The same on an array of rows, columns and channels."""
    raster = np.pad(raster, ((0, raster.shape[0] % 2), (0, raster.shape[1] % 2), (0, 0)), mode="edge")
    return (raster[0::2, 0::2] + raster[1::2, 0::2] + raster[0::2, 1::2] + raster[1::2, 1::2]) // 4


PIXEL_OUT = "level int, x long, y long, r int, g int, b int"
#: Levels that one shuffle makes: a block then has 256 pixels a side.
DEPTH = 8


def pyramid(pixels: DataFrame, levels: int, keys: Keys = (), depth: int = DEPTH) -> DataFrame:
    """Levels 1 to `levels` of every raster, each the box reduction of the rounded level before: keys, level, x, y, r, g, b.

    Blocks of 2 ** depth pixels a side never share a pixel of any of these levels, so one shuffle by block makes all of
    them; only blocks at an odd edge of the raster have one of their own. A deeper pyramid takes the last level, settled
    in the shared folder, as the next call's raster, so that no block grows. A raster of one pixel stays one.
    """
    ship(pixels.sparkSession)
    if levels > depth:
        upper = settled(pyramid(pixels, depth, keys, depth))
        last = upper.where(F.col("level") == depth).drop("level")
        return upper.unionByName(pyramid(last, levels - depth, keys, depth).withColumn("level", F.col("level") + depth))
    side = 1 << levels

    def reduce_block(table: pa.Table) -> pa.Table:
        x, y, *channels = (table.column(c).to_numpy() for c in ("x", "y", *CHANNELS))
        bx, by = int(x.min()) // side * side, int(y.min()) // side * side
        raster = np.zeros((int(y.max()) - by + 1, int(x.max()) - bx + 1, 3), np.int32)
        raster[y - by, x - bx] = np.stack(channels, 1)
        out = []
        for level in range(1, levels + 1):
            raster = halved(raster)
            yy, xx = (g.ravel() for g in np.mgrid[: raster.shape[0], : raster.shape[1]])
            flat = raster.reshape(-1, 3).astype(np.int32)
            own = {k: pa.array([table.column(k)[0].as_py()] * len(xx), table.schema.field(k).type) for k in keys}
            out.append(pa.table({**own, "level": np.full(len(xx), level, np.int32), "x": xx + (bx >> level), "y": yy + (by >> level), **{c: flat[:, k] for k, c in enumerate(CHANNELS)}}))
        return pa.concat_tables(out)

    blocks = pixels.select(*keys, "x", "y", *CHANNELS, whole_div(F.col("x"), side).alias("bx"), whole_div(F.col("y"), side).alias("by"))
    schema = "".join(f"{k} {pixels.schema[k].dataType.simpleString()}, " for k in keys) + PIXEL_OUT
    return blocks.groupBy(*keys, "bx", "by").applyInArrow(reduce_block, schema)


def subsample(pixels: DataFrame, stride: int, keys: Keys = ()) -> DataFrame:
    """Nearest reduction: the last pixel, in row order, of every stride x stride cell."""
    cell = [whole_div(F.col(c), stride).alias(c) for c in ("x", "y")]
    last = F.max_by(F.struct(*CHANNELS), F.struct("y", "x"))
    return pixels.groupBy(*keys, *cell).agg(last.alias("p")).select(*keys, "x", "y", "p.*")


def retile(pixels: DataFrame, width: Size, height: Size, tile: int, halo: int, keys: Keys = ()) -> DataFrame:
    """Pixels by output tile, with a border of `halo` pixels of the neighbours: keys, col, row_, px, py, r, g, b.

    A pixel goes to every tile whose bordered extent holds it, at most four for a border below half a tile.
    """

    def homes(at: str, size: Column) -> Column:
        lo = F.greatest(F.lit(0).cast("bigint"), whole_div(F.greatest(F.col(at) - halo, F.lit(0)), tile))
        hi = F.least(whole_div(size - 1, tile), whole_div(F.col(at) + halo, tile))
        return F.explode(F.sequence(lo, hi))

    rows = pixels.withColumn("col", homes("x", sized(width))).withColumn("row_", homes("y", sized(height)))
    start = {c: F.greatest(F.lit(0).cast("bigint"), F.col(k) * tile - halo) for c, k in (("x", "col"), ("y", "row_"))}
    return rows.select(*keys, "col", "row_", (F.col("x") - start["x"]).alias("px"), (F.col("y") - start["y"]).alias("py"), *CHANNELS)


def pad_edges(pixels: DataFrame, width: Size, height: Size, tile: int, keys: Keys = ()) -> DataFrame:
    """Rasters out to whole tiles, their last column and row repeated: every edge pixel makes its own copies."""

    def copies(at: str, size: Column) -> Column:
        full = F.ceil(size / tile) * tile
        return F.explode(F.when(F.col(at) == size - 1, F.sequence(size - 1, full - 1)).otherwise(F.array(F.col(at))))

    rows = pixels.withColumn("px", copies("x", sized(width))).withColumn("py", copies("y", sized(height)))
    return rows.select(*keys, F.col("px").alias("x"), F.col("py").alias("y"), *CHANNELS)


def predictor(pixels: DataFrame, keys: Keys = ()) -> DataFrame:
    """Horizontal differencing modulo 256; the first column stays."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    return pixels.select(*keys, "x", "y", *[F.pmod(F.col(c) - F.coalesce(F.lag(c).over(row), F.lit(0)), F.lit(256)).cast("int").alias(c) for c in CHANNELS])


def rotate_clockwise(pixels: DataFrame, height: Size, keys: Keys = ()) -> DataFrame:
    return pixels.select(*keys, (sized(height) - 1 - F.col("y")).alias("x"), F.col("x").alias("y"), *CHANNELS)


def read_region(pixels: DataFrame, x: int, y: int, w: int, h: int, white: int | None = 255) -> DataFrame:
    """The pixels of a rectangle. With `white`, every place of it, those outside the raster white; else those inside.

    The bounds are compared with the raster's own columns, so that they reach a sorted scan; the grid is one range.
    """
    inside = pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    if white is None:
        return inside.select("x", "y", *CHANNELS)
    cells = pixels.sparkSession.range(w * h).select((F.floor(F.col("id") % w) + x).cast("bigint").alias("x"), (F.floor(F.col("id") / w) + y).cast("bigint").alias("y"))
    return cells.join(inside, ["x", "y"], "left").select("x", "y", *[F.coalesce(c, F.lit(white)).alias(c) for c in CHANNELS])


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int, keys: Keys = ()) -> DataFrame:
    """The part of a rectangle that lies inside each raster, moved to the origin."""
    inside = pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    return inside.select(*keys, (F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"), *CHANNELS)


def tile_hashes(pixels: DataFrame, tile: int, keys: Keys = ()) -> DataFrame:
    """SHA-256 of the tight RGB rows of every tile: keys, col, row_, sha256. The text form is hex, two digits a channel."""
    hexed = F.lower(F.concat(*[F.lpad(F.hex(c), 2, "0") for c in CHANNELS]))
    cells = pixels.select(*keys, whole_div(F.col("x"), tile).alias("col"), whole_div(F.col("y"), tile).alias("row_"), F.struct("y", "x", hexed.alias("p")).alias("s"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]), "")
    return cells.groupBy(*keys, "col", "row_").agg(F.sha2(F.unhex(rows), 256).alias("sha256"))


def raster_hashes(pixels: DataFrame, keys: Keys = ()) -> DataFrame:
    """SHA-256 of every raster's RGB bytes in row order: keys, nbytes, sha256.

    A raster's bytes pass through one task in order, and nothing of it is held: the digest is a chain by definition.
    """
    import hashlib

    ship(pixels.sparkSession)
    n = len(keys)

    def run(batches):
        now, digest, size = None, None, 0

        def row():
            return pa.record_batch([*[pa.array([v], t) for v, t in zip(now, kinds, strict=True)], pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], names=[*keys, "nbytes", "sha256"])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(n)]
            own = [batch.column(i).to_pylist() for i in range(n)]
            rgb = np.stack([batch.column(n + k).to_numpy() for k in range(3)], 1).astype(np.uint8)
            heads = list(zip(*own, strict=True)) if n else [()] * batch.num_rows
            cuts = [0, *[i for i in range(1, len(heads)) if heads[i] != heads[i - 1]], len(heads)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if heads[lo] != now:
                    if digest is not None:
                        yield row()
                    now, digest, size = heads[lo], hashlib.sha256(), 0
                digest.update(rgb[lo:hi].tobytes())
                size += 3 * (hi - lo)
        if digest is not None:
            yield row()

    dealt = pixels.repartition(*keys) if keys else pixels.coalesce(1)
    ordered = dealt.sortWithinPartitions(*keys, "y", "x").select(*keys, *CHANNELS)
    schema = "".join(f"{k} {pixels.schema[k].dataType.simpleString()}, " for k in keys) + "nbytes long, sha256 string"
    return ordered.mapInArrow(run, schema)
