"""Image directories: what each entry shows, and how its values read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["slide_id", "width", "height", "compression"]


def classify(ifds: DataFrame, levels: DataFrame, associated: DataFrame) -> DataFrame:
    """Every directory with the level or associated image of equal sides and codec: ifd_index, image_type, level_index.

    Among levels the last wins, levels win over associated images, among those the first; without one it is
    (unclassified). One aggregate a key keeps the winner, so the join has one row on its build side.
    """
    known = levels.select(*KEY, F.lit(1).alias("rank"), F.col("level").alias("place"), F.lit("pyramid").alias("image_type"), F.col("level").alias("level_index"))
    sides = associated.select(*KEY, F.lit(0).alias("rank"), (-F.col("ifd_offset")).alias("place"), F.col("type").alias("image_type"), F.lit(None).cast("bigint").alias("level_index"))
    best = known.unionByName(sides).groupBy(*KEY).agg(F.max_by(F.struct("image_type", "level_index"), F.struct("rank", "place")).alias("found"))
    rows = ifds.join(best, KEY, "left")
    return rows.select("slide_id", "ifd_index", "width", "height", "compression", F.coalesce("found.image_type", F.lit("(unclassified)")).alias("image_type"), F.col("found.level_index").alias("level_index"))


def locate(associated: DataFrame, ifds: DataFrame) -> DataFrame:
    """The directory of every associated image, by byte offset; null if the chain has none there."""
    at = ifds.select("slide_id", "ifd_offset", "ifd_index")
    return associated.select("slide_id", "type", "ifd_offset").join(at, ["slide_id", "ifd_offset"], "left").select("slide_id", "type", "ifd_offset", "ifd_index")
