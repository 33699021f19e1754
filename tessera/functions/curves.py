"""Orders of tiles on a grid as column expressions, and the registry of their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import big, next_power2


def row_major(col: Column, row: Column, cols: Column, rows: Column) -> Column:
    return row * cols + col


def row_major_cell(index: Column, cols: Column) -> tuple[Column, Column]:
    return F.pmod(index, cols), F.floor(index / cols).cast("bigint")


def spread_bits(v: Column, bits: int = 21) -> Column:
    """The bits of v at the even places: shift and mask, halving the stride."""
    v = big(v)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def morton(col: Column, row: Column, cols: Column, rows: Column) -> Column:
    """Bits of the column at even places, of the row at odd ones."""
    return spread_bits(col).bitwiseOR(F.shiftleft(spread_bits(row), 1))


def gathered_bits(v: Column) -> Column:
    """The bits at the even places of v, side by side: `spread_bits` undone."""
    v = big(v).bitwiseAND(F.lit(0x5555555555555555).cast("bigint"))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def morton_cell(index: Column) -> tuple[Column, Column]:
    return gathered_bits(index), gathered_bits(F.shiftright(big(index), 1))


def hilbert_cell(index: Column, cols: Column, rows: Column) -> tuple[Column, Column]:
    """The cell at a distance along the curve: a fold over pairs of bits from the lowest."""
    side = next_power2(F.greatest(cols, rows))
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.log2(side.cast("double")).cast("int") - 1))
    start = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), big(index).alias("t"))

    def step(a: Column, k: Column) -> Column:
        s = F.pow(F.lit(2.0), k).cast("bigint")
        rx = F.pmod(F.floor(a["t"] / 2), F.lit(2)).cast("bigint")
        ry = F.pmod(a["t"] + rx, F.lit(2)).cast("bigint")
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - a["x"]).otherwise(a["x"]), F.when(flip, s - 1 - a["y"]).otherwise(a["y"])
        x, y = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        return F.struct((x + s * rx).cast("bigint").alias("x"), (y + s * ry).cast("bigint").alias("y"), F.floor(a["t"] / 4).cast("bigint").alias("t"))

    cell = F.aggregate(steps, start, step, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y")))
    return cell["x"], cell["y"]


def hilbert(col: Column, row: Column, cols: Column, rows: Column) -> Column:
    """Distance along the Hilbert curve of the least power of two that holds the grid: a fold over the bits from the top."""
    side = next_power2(F.greatest(cols, rows))
    steps = F.reverse(F.sequence(F.lit(0), F.greatest(F.lit(0), F.log2(side.cast("double")).cast("int") - 1)))
    start = F.struct(big(col).alias("x"), big(row).alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(a: Column, k: Column) -> Column:
        s = F.pow(F.lit(2.0), k).cast("bigint")
        rx = F.when(F.pmod(F.floor(a["x"] / s), F.lit(2)) == 1, 1).otherwise(0).cast("bigint")
        ry = F.when(F.pmod(F.floor(a["y"] / s), F.lit(2)) == 1, 1).otherwise(0).cast("bigint")
        x, y = F.pmod(a["x"], s), F.pmod(a["y"], s)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - x).otherwise(x), F.when(flip, s - 1 - y).otherwise(y)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).cast("bigint").alias("x"), F.when(ry == 0, fx).otherwise(fy).cast("bigint").alias("y"), (a["d"] + s * s * (3 * rx).bitwiseXOR(ry)).cast("bigint").alias("d"))

    return F.aggregate(steps, start, step, lambda a: a["d"])


def serpentine(col: Column, row: Column, cols: Column, rows: Column) -> Column:
    """Rows from the bottom up, odd ones from the right."""
    up = rows - 1 - row
    return up * cols + F.when(F.pmod(up, F.lit(2)) == 1, cols - 1 - col).otherwise(col)


def serpentine_cell(index: Column, cols: Column, rows: Column) -> tuple[Column, Column]:
    up = F.floor(index / cols).cast("bigint")
    at = F.pmod(index, cols)
    return F.when(F.pmod(up, F.lit(2)) == 1, cols - 1 - at).otherwise(at), rows - 1 - up


#: Name -> key(col, row, cols, rows). Others may be added.
ORDERS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {"hilbert": hilbert, "morton": morton, "row-major": row_major, "serpentine": serpentine}


def order_key(name: str) -> Callable[[Column, Column, Column, Column], Column]:
    if name not in ORDERS:
        raise ValueError(f"unknown tile order {name!r}; known: {', '.join(sorted(ORDERS))}")
    return ORDERS[name]
