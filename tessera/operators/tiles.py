"""Operators on the tile relation: catalogues, completeness, duplicates, neighbours, rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import big, overlap, whole_div


def tile_catalog(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("slide_id", "level").agg(F.count(F.lit(1)).alias("n_tiles"), F.sum("nbytes").alias("nbytes"), F.max(F.col("grid") * F.col("grid")).alias("n_cells"))


def incomplete_levels(tiles: DataFrame) -> DataFrame:
    """Levels with fewer tiles than cells."""
    return tile_catalog(tiles).where("n_tiles < n_cells").select("slide_id", "level", "n_tiles", "n_cells")


def duplicate_tiles(events: DataFrame) -> DataFrame:
    return events.groupBy("slide_id", "level", "col", "row_").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sparse_grid(tiles: DataFrame) -> DataFrame:
    """Every cell of every level that has a tile, with the tile's bytes or null: a missing tile is a null offset in a file.

    The grid is made from one row a level and joined on the tile key, so that both sides are dealt by it.
    """
    levels = tiles.groupBy("slide_id", "level").agg(F.max("grid").alias("grid"))
    cells = levels.withColumn("row_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("grid") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("grid") - 1)))
    found = tiles.select("slide_id", "level", "col", "row_", "nbytes")
    return cells.drop("grid").join(found, ["slide_id", "level", "col", "row_"], "left").select("slide_id", "level", "col", "row_", "nbytes")


def neighbour_joints(tiles: DataFrame, number) -> DataFrame:
    """Pairs of a tile and its right or upper neighbour, both by their number on the stage, counted from 1.

    `number(col, row, cols, rows)` is an order of tessera.functions.curves. Each tile is expanded to its own key and the
    keys of its two neighbours' pairs; one grouping by that key finds both, instead of two self-joins.
    """
    at = (number(F.col("col"), F.col("row_"), F.col("grid"), F.col("grid")) + 1).cast("bigint")
    ends = F.array(
        F.struct(F.lit("RIGHT").alias("direction"), F.col("col").alias("c"), F.col("row_").alias("r"), F.lit(1).alias("end")),
        F.struct(F.lit("RIGHT").alias("direction"), (F.col("col") - 1).alias("c"), F.col("row_").alias("r"), F.lit(2).alias("end")),
        F.struct(F.lit("UP").alias("direction"), F.col("col").alias("c"), F.col("row_").alias("r"), F.lit(1).alias("end")),
        F.struct(F.lit("UP").alias("direction"), F.col("col").alias("c"), (F.col("row_") + 1).alias("r"), F.lit(2).alias("end")),
    )
    rows = tiles.select("slide_id", "level", at.alias("tile"), F.explode(ends).alias("e")).select("slide_id", "level", "tile", "e.*")
    pairs = rows.groupBy("slide_id", "level", "direction", "c", "r").agg(F.max(F.when(F.col("end") == 1, F.col("tile"))).alias("tile1"), F.max(F.when(F.col("end") == 2, F.col("tile"))).alias("tile2"))
    return pairs.where("tile1 is not null and tile2 is not null").select("slide_id", "level", "direction", "tile1", "tile2")


def tiles_in_rects(tiles: DataFrame, rects: DataFrame, tile: int) -> DataFrame:
    """Tiles of level 0 that a rectangle touches: an overlap join as an equi-join on grid cells.

    Tiles are the grid's cells, so each rectangle becomes the cells that it touches and no pair is looked at twice.
    """
    last = {"cx": (F.col("x"), F.col("w")), "cy": (F.col("y"), F.col("h"))}
    cells = rects
    for name, (at, extent) in last.items():
        cells = cells.withColumn(name, F.explode(F.sequence(whole_div(at, tile), whole_div(at + extent - 1, tile))))
    cells = cells.select("rect_id", "slide_id", "x", "y", "w", "h", F.col("cx").alias("col"), F.col("cy").alias("row_"))
    return tiles.where("level = 0").select("slide_id", "col", "row_", "nbytes").join(cells, ["slide_id", "col", "row_"])


def crop_plan(tiles: DataFrame, rects: DataFrame, tile: int) -> DataFrame:
    """What to copy for every rectangle: from where in a tile to where in the rectangle, and how much."""
    found = tiles_in_rects(tiles, rects, tile)
    meet = overlap(F.col("col") * tile, F.col("row_") * tile, big(tile), big(tile), *[F.col(c) for c in "xywh"])
    return found.select("rect_id", "slide_id", "col", "row_", *[big(v).alias(k) for k, v in meet.items()])


def out_of_bounds(rects: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Rectangles that don't lie inside the image, with the first reason."""
    reason = (
        F.when((F.col("x") < 0) | (F.col("y") < 0), "origin")
        .when((F.col("w") <= 0) | (F.col("h") <= 0), "size")
        .when(F.col("x") + F.col("w") > width, "right")
        .when(F.col("y") + F.col("h") > height, "bottom")
    )
    return rects.withColumn("reason", reason).where("reason is not null").select("rect_id", "slide_id", "reason")
