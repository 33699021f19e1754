"""Where bytes go in a file: prefix sums over ordered tiles, directory chains, file-size decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import align_up, big


def by_rows(col: Column, row: Column) -> Column:
    """The key of tiles row by row, for grids of any size: 64 bits, the column in the lower 32."""
    return F.shiftleft(big(row), 32) + col


def placed(tiles: DataFrame, key: Column, start: int, unit: int = 16, bits: int = 12) -> DataFrame:
    """The offset of every tile of a slide's file: coarsest level first, tiles by `key`, each at a multiple of `unit`.

    A walk with a cursor is an exclusive running sum of the aligned sizes. Equal keys don't occur in a level. The sum is
    taken in two steps, of the totals of stretches of 2 ** bits keys and inside a stretch, so that a task holds one of
    these, and of a slide only a row for each.
    """
    size = align_up(F.col("nbytes"), unit)
    keyed = tiles.withColumn("key", key).withColumn("stretch", F.shiftright(F.col("key").cast("bigint"), bits))
    inside = Window.partitionBy("slide_id", "level", "stretch").orderBy("key")
    totals = keyed.groupBy("slide_id", "level", "stretch").agg(F.sum(size).alias("total"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("slide_id").orderBy(F.desc("level"), "stretch").rowsBetween(Window.unboundedPreceding, -1)
    in_level = Window.partitionBy("slide_id", "level").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("slide_id", "level", "stretch", (F.coalesce(F.sum("total").over(before), F.lit(0)) + start).alias("base"), F.coalesce(F.sum("n").over(in_level), F.lit(0)).alias("first"))
    rows = keyed.join(bases, ["slide_id", "level", "stretch"])
    upto = F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("offset", F.col("base") + upto - size).withColumn("rank", (F.col("first") + F.row_number().over(inside) - 1).cast("int")).drop("base", "first", "key", "stretch")


def appended(tiles: DataFrame, order: list[str], start: int) -> DataFrame:
    """Offsets of blobs written one after the other in each slide's file."""
    upto = Window.partitionBy("slide_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tiles.withColumn("offset", (F.sum("nbytes").over(upto) - F.col("nbytes") + start).cast("bigint"))


def chained(ifds: DataFrame) -> DataFrame:
    """Every directory with the offset of the next, 0 for the last."""
    return ifds.withColumn("next_offset", F.lead("ifd_offset", 1, 0).over(Window.partitionBy("slide_id").orderBy("ifd_index")))


def bigtiff_choices(tiles: DataFrame, levels: DataFrame, factor: int = 2, meta: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The four decisions: from exact bytes by slide of `tiles`; from pixels by slide of `levels`."""
    exact = tiles.groupBy("slide_id").agg((F.sum("nbytes") + meta + 65536 > 2**31).alias("exact"))
    area = F.col("width") * F.col("height")
    top = F.col("level") == 0
    by_pixels = levels.groupBy("slide_id").agg(
        (F.sum(area) > 2**31).alias("all_pixels"),
        (F.max(F.when(top, area * 3)) > 2**32).alias("raw_top"),
        (F.sum(F.floor(F.floor(F.col("width") / factor) * F.floor(F.col("height") / factor) * 3 / 8)) > 2**31).alias("estimated"),
    )
    return exact, by_pixels


def lossy_ratio(tiles: DataFrame, tile: int) -> DataFrame:
    """Uncompressed over compressed bytes of every level."""
    return tiles.groupBy("slide_id", "level").agg(F.round(F.count(F.lit(1)) * float(tile * tile * 3) / F.sum("nbytes"), 6).alias("ratio"))


def instance_numbers(levels: DataFrame, associated: DataFrame, skipped: tuple[str, ...] = ("map", "probability")) -> DataFrame:
    """Numbers of a series' instances: levels in order, then associated images; a skipped one takes none."""
    rows = levels.select("slide_id", F.lit(0).alias("part"), F.col("level").alias("place"), F.concat(F.lit("level-"), F.col("level").cast("string")).alias("name"))
    more = associated.where(~F.col("type").isin(*skipped)).select("slide_id", F.lit(1).alias("part"), F.col("ifd_offset").alias("place"), F.col("type").alias("name"))
    order = Window.partitionBy("slide_id").orderBy("part", "place")
    return rows.unionByName(more).select("slide_id", "name", F.row_number().over(order).cast("bigint").alias("number"))
