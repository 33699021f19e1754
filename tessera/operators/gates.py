"""What is allowed and what is picked: gates by format, type domains, level choice, tile substitution, merges of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.codes import IMAGE_TYPES

# Fixed values.
#: Formats whose side images are edited, and the container that a reduced slide of a format is written to.
EDITED_FORMATS = ("svs", "generic-tiff", "cog-wsi", "ome-tiff")
REDUCED_TARGETS = {"svs": "svs", "ome-tiff": "ome-tiff", "generic-tiff": "tiff", "cog-wsi": "cog-wsi", "dicom": "dicom"}
#: Types of side images that a cog-wsi file takes; types that show the whole slide.
COG_TYPES = ("label", "macro", "thumbnail", "overview")
OVERVIEW_TYPES = ("overview", "macro")


def edits_side_images(format_: Column) -> Column:
    return format_.isin(*EDITED_FORMATS)


def reduced_target(format_: Column) -> Column:
    """The container of a reduced slide; null for a format that has none."""
    return F.coalesce(*[F.when(format_ == k, v) for k, v in REDUCED_TARGETS.items()])


def is_image_type(kind: Column) -> Column:
    return F.coalesce(kind.isin(*IMAGE_TYPES), F.lit(False))


def split_by_type(associated: DataFrame, allowed: tuple[str, ...] = COG_TYPES) -> tuple[DataFrame, DataFrame]:
    """Side images that a container takes, and warnings (slide_id, type, warning) for those that are left out."""
    types = associated.sparkSession.createDataFrame([(t,) for t in allowed], "type string")
    left_out = associated.join(F.broadcast(types), "type", "left_anti")  # a row for each allowed type
    warnings = left_out.select("slide_id", "type", F.concat(F.lit("left out: type "), "type").alias("warning"))
    return associated.join(F.broadcast(types), "type", "left_semi"), warnings


def first_of_types(associated: DataFrame, types: tuple[str, ...] = OVERVIEW_TYPES, order: str = "ifd_offset") -> DataFrame:
    """The first side image of each slide that is of one of the types: one aggregate, no sort of a slide's images."""
    some = associated.where(F.col("type").isin(*types))
    return some.groupBy("slide_id").agg(F.min_by(F.struct(*[c for c in some.columns if c != "slide_id"]), F.struct(order, "type")).alias("p")).select("slide_id", "p.*")


def choose_level(wanted: DataFrame, levels: DataFrame) -> DataFrame:
    """Wanted levels (slide_id, level) with their sides; those that are not there say how many there are."""
    there = levels.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n_levels"))
    rows = wanted.join(levels.select("slide_id", "level", "width", "height"), ["slide_id", "level"], "left").join(there, "slide_id", "left")
    error = F.when(F.col("width").isNull(), F.concat(F.lit("level "), F.col("level").cast("string"), F.lit(" is not one of "), F.coalesce("n_levels", F.lit(0)).cast("string")))
    return rows.select("slide_id", "level", "width", "height", error.alias("error"))


def substituted(encoded: DataFrame, stored: DataFrame, width: Column, height: Column, tile: Column) -> DataFrame:
    """Engine tiles of the finest level, replaced by the source's own where a whole tile lies inside the image.

    Both tables have (slide_id, col, row_, bytes); sides are columns of `encoded`. An equi-join on the tile's place.
    """
    interior = ((F.col("col") + 1) * tile <= width) & ((F.col("row_") + 1) * tile <= height)
    own = stored.select("slide_id", "col", "row_", F.col("bytes").alias("stored"))
    rows = encoded.withColumn("interior", interior).join(own, ["slide_id", "col", "row_"], "left")
    return rows.select("slide_id", "col", "row_", "interior", F.when(F.col("interior") & F.col("stored").isNotNull(), F.col("stored")).otherwise(F.col("bytes")).alias("bytes"))


def merged_properties(raw: Column, made: dict[str, Column]) -> Column:
    """A map of a source's own properties and of made ones, which win; those that are null or empty are left out."""
    given = F.map_from_entries(F.array_compact(F.array(*[F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))) for k, v in made.items()])))
    kept = F.map_filter(raw, lambda k, _: ~F.map_contains_key(given, k))
    return F.map_concat(kept, given)


def sorted_properties(properties: Column) -> Column:
    """Entries in order of their keys: what is written does not depend on a map's own order."""
    return F.array_sort(F.map_entries(properties))


def ambiguous_series(instances: DataFrame) -> DataFrame:
    """Folders (folder, series) that hold several series, with a list of them."""
    per = instances.groupBy("folder").agg(F.count_distinct("series").alias("n"), F.array_join(F.array_sort(F.collect_set("series")), ", ").alias("candidates"))
    return per.where("n > 1")


def snapped_rects(rects: DataFrame, width: Column, height: Column) -> DataFrame:
    """Rectangles with what is wrong with each, null if nothing: sides must be positive, and it must lie inside the image."""
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= width) & (F.col("y") + F.col("h") <= height)
    fault = F.when((F.col("w") <= 0) | (F.col("h") <= 0), "empty").when(~inside, "outside")
    return rects.withColumn("fault", fault)


def in_order_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
