"""Tables of levels: geometry, octaves, and which octaves an output keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import big, ceil_div, ceil_halved, edge_extent, octave, power2, whole_div

TOLERANCE = 2


def level_table(levels: DataFrame) -> DataFrame:
    """Grid, corner tile and downsample of every level; the downsample is of the widths, to level 0."""
    full = Window.partitionBy("slide_id")
    return levels.select(
        "slide_id",
        "level",
        "width",
        "height",
        ceil_div(F.col("width"), F.col("tile_w")).alias("cols"),
        ceil_div(F.col("height"), F.col("tile_h")).alias("rows_"),
        (F.max(F.when(F.col("level") == 0, F.col("width"))).over(full).cast("double") / F.col("width")).alias("scale"),
        "tile_w",
        "tile_h",
    )


def corner_tiles(levels: DataFrame) -> DataFrame:
    """The extent of every level's last tile."""
    t = level_table(levels)
    return t.select("slide_id", "level", edge_extent(F.col("width"), F.col("tile_w"), F.col("cols") - 1).alias("corner_w"), edge_extent(F.col("height"), F.col("tile_h"), F.col("rows_") - 1).alias("corner_h"))


def with_octaves(levels: DataFrame) -> DataFrame:
    """Every level with its octave in each axis and whether it lies on one, within TOLERANCE pixels of the halved side."""
    top = levels.where("level = 0").select("slide_id", F.col("width").alias("w0"), F.col("height").alias("h0"))
    kw, kh = octave(F.col("w0"), F.col("width")), octave(F.col("h0"), F.col("height"))
    rows = levels.join(top, "slide_id").withColumn("kw", kw).withColumn("kh", kh)

    def off(full: str, size: str) -> Column:
        return F.abs(ceil_halved(F.col(full), F.greatest(F.col("kw"), F.lit(0))) - F.col(size)) > TOLERANCE

    return rows.withColumn("aligned", (F.col("kw") >= 0) & (F.col("kw") == F.col("kh")) & ~off("w0", "width") & ~off("h0", "height"))


def octave_sets(levels: DataFrame) -> DataFrame:
    """Per slide: the octaves of its levels in order, the deepest, whether all are aligned, whether one occurs twice."""
    return (
        with_octaves(levels)
        .groupBy("slide_id")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_set("kw")), lambda k: k.cast("string")), ",").alias("octaves"),
            F.max("kw").alias("deepest"),
            F.bool_and("aligned").alias("aligned"),
            (F.count(F.lit(1)) > F.count_distinct("kw")).alias("duplicate"),
        )
    )


def planned_octaves(levels: DataFrame, extent: dict[str, Column] | None = None, shift: int = 0) -> DataFrame:
    """Per aligned slide the levels of an output that keeps the source's octaves: index (-1 for one that is only passed
    through), octave k, width, height. `extent` gives other sides of level 0 (a crop); `shift` drops the first octaves
    (a downsample by 2 ** shift), for slides that have that octave.
    """
    rows = with_octaves(levels)
    per = rows.groupBy("slide_id").agg(F.collect_set("kw").alias("have"), F.max("kw").alias("deepest"), F.max("w0").alias("w0"), F.max("h0").alias("h0"), F.bool_and("aligned").alias("aligned"))
    per = per.where(F.col("aligned") & F.array_contains("have", F.lit(shift).cast("bigint")))
    if extent:
        per = per.withColumn("w0", extent["w"]).withColumn("h0", extent["h"])
    every = per.select("slide_id", "have", "w0", "h0", F.explode(F.sequence(F.lit(shift).cast("bigint"), F.col("deepest"))).alias("octave"))
    rank = F.size(F.filter("have", lambda x: (x >= shift) & (x < F.col("octave"))))
    return every.select(
        "slide_id",
        (F.col("octave") - shift).alias("k"),
        F.when(F.expr("array_contains(have, octave)"), rank).otherwise(-1).cast("bigint").alias("index_"),
        ceil_halved(F.col("w0"), F.col("octave")).alias("width"),
        ceil_halved(F.col("h0"), F.col("octave")).alias("height"),
    )


def dzi_levels(slides: DataFrame, tile: int) -> DataFrame:
    """Every Deep Zoom level of every slide, 0 being one pixel: sides and grid."""
    from tessera.functions.geometry import dzi_max_level

    rows = slides.select("slide_id", "width", "height", dzi_max_level(F.col("width"), F.col("height")).alias("top"))
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))))
    w, h = (whole_div(F.col(c) + power2(F.col("top") - F.col("level")) - 1, power2(F.col("top") - F.col("level"))) for c in ("width", "height"))
    return rows.select("slide_id", "level", w.alias("w"), h.alias("h"), ceil_div(w, tile).alias("cols"), ceil_div(h, tile).alias("rows_"))


def spatial(levels: DataFrame, slides: DataFrame) -> DataFrame:
    """Pixel spacing (mm) of every level and imaged volume (mm) of its slide; unknown pixel sizes are left out."""
    top = levels.where("level = 0").select("slide_id", F.col("width").alias("w0"), F.col("height").alias("h0"))
    known = slides.where("mpp > 0").select("slide_id", "mpp")
    rows = levels.join(top, "slide_id").join(known, "slide_id")

    def ratio(a: str, b: str) -> Column:
        return F.col(a).cast("double") / F.col(b)

    return rows.select(
        "slide_id",
        "level",
        F.round(F.col("mpp") * ratio("h0", "height") / 1000, 9).alias("spacing_row"),
        F.round(F.col("mpp") * ratio("w0", "width") / 1000, 9).alias("spacing_col"),
        F.round(big(F.col("w0")) * F.col("mpp") / 1000, 6).alias("volume_w"),
        F.round(big(F.col("h0")) * F.col("mpp") / 1000, 6).alias("volume_h"),
    )
