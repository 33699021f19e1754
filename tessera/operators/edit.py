"""Edits of associated images and the byte ranges that they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import aspect_mismatch


def remove(associated: DataFrame, kind: str) -> DataFrame:
    return associated.where(F.col("type") != kind)


def replace(associated: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` take the place of those of their slide and type, or are added."""
    return associated.join(new.select("slide_id", "type"), ["slide_id", "type"], "left_anti").unionByName(new)


def replacement_check(associated: DataFrame, kind: str, width: int, height: int, default_w: int, default_h: int, slides: DataFrame) -> DataFrame:
    """For every slide the sides of the target, those of its image of that kind or the defaults, the replacement's
    codec, whether its aspect differs too much, and whether it replaces or is added."""
    old = associated.where(F.col("type") == kind).select("slide_id", F.col("width").alias("old_w"), F.col("height").alias("old_h"))
    rows = slides.select("slide_id").join(old, "slide_id", "left")
    w, h = (F.coalesce(a, F.lit(b).cast("bigint")) for a, b in (("old_w", default_w), ("old_h", default_h)))
    codec = "lzw" if kind == "label" else "jpeg"
    size = F.lit(width).cast("bigint"), F.lit(height).cast("bigint")
    return rows.select("slide_id", w.alias("target_w"), h.alias("target_h"), F.lit(codec).alias("codec"), aspect_mismatch(*size, w, h).alias("mismatch"), F.when(F.col("old_w").isNull(), "append").otherwise("replace").alias("mode"))


def overlaps(ranges: DataFrame) -> DataFrame:
    """Ranges of a file that begin before an earlier one ends: the furthest end so far is a running maximum."""
    before = Window.partitionBy("file_id").orderBy("start_", "range_id").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("reached", F.max("end_").over(before)).where("reached > start_").select("file_id", "range_id", "start_", "reached")


def tails(ranges: DataFrame) -> DataFrame:
    """For every owner of a file the least start of it and of those from it on: what an edit of it must move."""
    own = ranges.groupBy("file_id", "owner").agg(F.min("start_").alias("own_start"), F.max("end_").alias("own_end"))
    later = Window.partitionBy("file_id").orderBy("owner").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return own.withColumn("cutoff", F.min("own_start").over(later))


def refusals(ranges: DataFrame) -> DataFrame:
    """Owners whose edit is refused: an earlier owner has bytes at or behind the cutoff."""
    earlier = Window.partitionBy("file_id").orderBy("owner").rowsBetween(Window.unboundedPreceding, -1)
    rows = tails(ranges).withColumn("earlier_end", F.max("own_end").over(earlier))
    return rows.select("file_id", "owner", "cutoff", F.coalesce(F.col("earlier_end") > F.col("cutoff"), F.lit(False)).alias("refused"))
