"""Queries on tile orders, file layouts and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.fixtures import Slides
from tessera.functions import curves as C
from tessera.operators import layout as Y
from tessera.operators import tiles as T

from .registry import query


def key(name: str):
    return C.order_key(name)(F.col("col"), F.col("row_"), F.col("grid"), F.col("grid"))


def ordered(s: Slides, name: str) -> DataFrame:
    """Every tile with its key and its rank on the curve in its level."""
    rows = s["v_tiles"].withColumn("key", key(name))
    rank = F.row_number().over(Window.partitionBy("slide_id", "level").orderBy("key")) - 1
    return rows.select("slide_id", "level", "col", "row_", F.col("key").cast("bigint").alias("key"), rank.cast("bigint").alias("rank"))


RANKED = "SELECT slide_id, level, col, row_, key, row_number() OVER (PARTITION BY slide_id, level ORDER BY key) - 1 AS rank FROM ({}) q"
MORTON = " + ".join(f"(CAST(floor(col / {1 << k}) AS BIGINT) % 2) * {1 << 2 * k} + (CAST(floor(row_ / {1 << k}) AS BIGINT) % 2) * {1 << 2 * k + 1}" for k in range(6))


def hilbert_sql() -> str:
    """A nested SELECT for each of six bits, from the top; bits above the grid's side are skipped."""
    sql = "SELECT *, col AS hx, row_ AS hy, CAST(0 AS BIGINT) AS hd FROM v_tiles"
    for k in reversed(range(6)):
        s = 1 << k
        use = f"{s} < grid"
        rx, ry = f"(CAST(floor(hx / {s}) AS BIGINT) % 2)", f"(CAST(floor(hy / {s}) AS BIGINT) % 2)"
        fx = f"(CASE WHEN {ry} = 0 AND {rx} = 1 THEN {s} - 1 - hx % {s} ELSE hx % {s} END)"
        fy = f"(CASE WHEN {ry} = 0 AND {rx} = 1 THEN {s} - 1 - hy % {s} ELSE hy % {s} END)"
        sql = f"""SELECT slide_id, level, col, row_, nbytes, grid,
          CASE WHEN NOT {use} THEN hx WHEN {ry} = 0 THEN {fy} ELSE {fx} END AS hx,
          CASE WHEN NOT {use} THEN hy WHEN {ry} = 0 THEN {fx} ELSE {fy} END AS hy,
          CASE WHEN NOT {use} THEN hd ELSE hd + {s * s} * (CASE WHEN {rx} = 1 THEN 3 - {ry} ELSE {ry} END) END AS hd FROM ({sql}) h{k}"""
    return f"SELECT slide_id, level, col, row_, nbytes, grid, CAST(hd AS BIGINT) AS key FROM ({sql}) h"


SERPENTINE = "(grid - 1 - row_) * grid + CASE WHEN (grid - 1 - row_) % 2 = 1 THEN grid - 1 - col ELSE col END"


@query(RANKED.format("SELECT *, row_ * grid + col AS key FROM v_tiles"))
def order_row_major(s: Slides) -> DataFrame:
    return ordered(s, "row-major")


@query(RANKED.format(f"SELECT *, CAST({MORTON} AS BIGINT) AS key FROM v_tiles"))
def order_morton(s: Slides) -> DataFrame:
    return ordered(s, "morton")


@query(RANKED.format(hilbert_sql()))
def order_hilbert(s: Slides) -> DataFrame:
    return ordered(s, "hilbert")


@query(RANKED.format(f"SELECT *, {SERPENTINE} AS key FROM v_tiles"))
def order_serpentine(s: Slides) -> DataFrame:
    return ordered(s, "serpentine")


@query(f"SELECT slide_id, level, col, row_, i, CAST(i % grid AS BIGINT) AS back_col, CAST(floor(i / grid) AS BIGINT) AS back_row FROM (SELECT *, row_ * grid + col AS i FROM v_tiles) q")
def order_inverse(s: Slides) -> DataFrame:
    """The cell of a row-major index: the inverse gives the cell back."""
    rows = s["v_tiles"].withColumn("i", key("row-major"))
    col, row = C.row_major_cell(F.col("i"), F.col("grid"))
    return rows.select("slide_id", "level", "col", "row_", "i", col.cast("bigint").alias("back_col"), row.alias("back_row"))


@query("""
SELECT slide_id, level, col, row_, col AS hilbert_col, row_ AS hilbert_row, col AS morton_col, row_ AS morton_row, col AS serpentine_col, row_ AS serpentine_row FROM v_tiles""")
def curves_inverse(s: Slides) -> DataFrame:
    """Cells of grids that are no powers of two, three columns wider than high, by their places on three curves."""
    cols, rows = F.col("grid") + 3, F.col("grid")
    at = {name: C.order_key(name)(F.col("col"), F.col("row_"), cols, rows).alias(name) for name in ("hilbert", "morton", "serpentine")}
    found = s["v_tiles"].select("slide_id", "level", "col", "row_", "grid", *at.values())
    cells = {"hilbert": C.hilbert_cell(F.col("hilbert"), cols, rows), "morton": C.morton_cell(F.col("morton")), "serpentine": C.serpentine_cell(F.col("serpentine"), cols, rows)}
    back = [c.cast("bigint").alias(f"{name}_{part}") for name, cell in cells.items() for part, c in zip(("col", "row"), cell, strict=True)]
    return found.select("slide_id", "level", "col", "row_", *back)


@query(f"""
SELECT slide_id, level, col, row_, nbytes, row_number() OVER (PARTITION BY slide_id, level ORDER BY key) - 1 AS rank,
       CAST(4096 + sum(a) OVER (PARTITION BY slide_id ORDER BY level DESC, key ROWS UNBOUNDED PRECEDING) - a AS BIGINT) AS "offset"
FROM (SELECT *, CAST(floor((nbytes + 15) / 16) AS BIGINT) * 16 AS a FROM ({hilbert_sql()}) z) q""")
def cog_layout_offsets(s: Slides) -> DataFrame:
    placed = Y.placed(s["v_tiles"], key("hilbert"), start=4096)
    return placed.select("slide_id", "level", "col", "row_", "nbytes", F.col("rank").cast("bigint").alias("rank"), F.col("offset").cast("bigint").alias("offset"))


@query("""
SELECT slide_id, level, col, row_, CAST(38 + sum(nbytes) OVER (PARTITION BY slide_id ORDER BY level, row_, col ROWS UNBOUNDED PRECEDING) - nbytes AS BIGINT) AS "offset" FROM v_tiles""")
def append_offsets(s: Slides) -> DataFrame:
    return Y.appended(s["v_tiles"], ["level", "row_", "col"], start=38).select("slide_id", "level", "col", "row_", "offset")


@query("SELECT slide_id, ifd_index, ifd_offset, lead(ifd_offset, 1, 0) OVER (PARTITION BY slide_id ORDER BY ifd_index) AS next_offset FROM v_ifds")
def ifd_chain(s: Slides) -> DataFrame:
    return Y.chained(s["v_ifds"]).select("slide_id", "ifd_index", "ifd_offset", F.col("next_offset").cast("bigint").alias("next_offset"))


@query("""
SELECT slide_id, sum(width * height) > 2147483648 AS all_pixels, max(CASE WHEN level = 0 THEN width * height * 3 END) > 4294967296 AS raw_top,
       sum(floor(floor(width / 2) * floor(height / 2) * 3 / 8)) > 2147483648 AS estimated FROM v_levels GROUP BY slide_id""")
def bigtiff_decision(s: Slides) -> DataFrame:
    return Y.bigtiff_choices(s["v_tiles"], s["v_levels"])[1]


@query("SELECT slide_id, sum(nbytes) + 4096 + 65536 > 2147483648 AS exact FROM v_tiles GROUP BY slide_id")
def bigtiff_exact(s: Slides) -> DataFrame:
    return Y.bigtiff_choices(s["v_tiles"], s["v_levels"])[0]


@query("""
SELECT l.slide_id, l.level, CAST(c.i AS BIGINT) AS col, CAST(r.i AS BIGINT) AS row_, t.nbytes
FROM (SELECT DISTINCT slide_id, level, grid FROM v_tiles) l JOIN (SELECT unnest(generate_series(0, 63)) AS i) c ON c.i < l.grid JOIN (SELECT unnest(generate_series(0, 63)) AS i) r ON r.i < l.grid
LEFT JOIN v_tiles t ON t.slide_id = l.slide_id AND t.level = l.level AND t.col = c.i AND t.row_ = r.i""")
def sparse_tile_grid(s: Slides) -> DataFrame:
    return T.sparse_grid(s["v_tiles"])


@query("SELECT slide_id, level, col, row_, CAST(count(*) AS BIGINT) AS n FROM v_tile_events GROUP BY slide_id, level, col, row_ HAVING count(*) > 1")
def duplicate_tiles(s: Slides) -> DataFrame:
    return T.duplicate_tiles(s["v_tile_events"])


@query("SELECT slide_id, level, CAST(count(*) AS BIGINT) AS n_tiles, max(grid * grid) AS n_cells FROM v_tiles GROUP BY slide_id, level HAVING count(*) < max(grid * grid)")
def incomplete_levels(s: Slides) -> DataFrame:
    return T.incomplete_levels(s["v_tiles"])


@query(f"""
WITH n AS (SELECT *, 1 + {SERPENTINE} AS k FROM v_tiles)
SELECT a.slide_id, a.level, 'RIGHT' AS direction, a.k AS tile1, b.k AS tile2 FROM n a JOIN n b ON a.slide_id = b.slide_id AND a.level = b.level AND a.row_ = b.row_ AND b.col = a.col + 1
UNION ALL
SELECT a.slide_id, a.level, 'UP', a.k, b.k FROM n a JOIN n b ON a.slide_id = b.slide_id AND a.level = b.level AND a.col = b.col AND b.row_ = a.row_ - 1""")
def neighbour_joints(s: Slides) -> DataFrame:
    return T.neighbour_joints(s["v_tiles"], C.serpentine)


@query("SELECT slide_id, level, round(count(*) * 12288.0 / sum(nbytes), 6) AS ratio FROM v_tiles GROUP BY slide_id, level")
def lossy_ratio(s: Slides) -> DataFrame:
    return Y.lossy_ratio(s["v_tiles"], 64)


@query("""
SELECT slide_id, name, row_number() OVER (PARTITION BY slide_id ORDER BY part, place) AS number
FROM (SELECT slide_id, 0 AS part, level AS place, 'level-' || level AS name FROM v_levels
      UNION ALL SELECT slide_id, 1, ifd_offset, type FROM v_associated WHERE type NOT IN ('map', 'probability')) q""")
def instance_numbers(s: Slides) -> DataFrame:
    return Y.instance_numbers(s["v_levels"], s["v_associated"])
