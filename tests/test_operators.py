"""Operators on rasters and tiles, with fixed values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pyramid as P
from tessera.operators import tiles as T


def pixels(spark, raster):
    h, w, _ = raster.shape
    rows = [(x, y, *map(int, raster[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "x long, y long, r int, g int, b int")


def back(df, w, h):
    out = np.zeros((h, w, 3), int)
    for p in df.collect():
        out[p.y, p.x] = p.r, p.g, p.b
    return out


def test_box(spark):
    raster = np.array([[[64 * y, 64 * x, 100] for x in range(4)] for y in range(4)])
    assert tuple(back(P.box_halve(pixels(spark, raster), 4, 4), 2, 2)[0, 0]) == (32, 32, 100)


@pytest.mark.parametrize("w,h", [(9, 7), (1, 1), (5, 8), (16, 3)])
def test_pyramid_is_repeated_halving(spark, w, h):
    raster = np.random.default_rng(w * h).integers(0, 256, (h, w, 3))
    found = P.pyramid(pixels(spark, raster), 3)
    want = raster
    for level in (1, 2, 3):
        one = P.box_halve(pixels(spark, want), want.shape[1], want.shape[0])
        want = P.halved(want)
        assert (back(one, want.shape[1], want.shape[0]) == want).all()
        assert (back(found.where(F.col("level") == level), want.shape[1], want.shape[0]) == want).all()


def test_floor_halving_drops_the_edge(spark):
    raster = np.random.default_rng(1).integers(0, 256, (5, 7, 3))
    assert P.box_halve(pixels(spark, raster), 7, 5, duplicate_edge=False).count() == 3 * 2


def test_region_is_white_outside(spark):
    raster = np.zeros((2, 2, 3), int)
    found = back(P.read_region(pixels(spark, raster), 1, 1, 2, 2).withColumn("x", F.col("x") - 1).withColumn("y", F.col("y") - 1), 2, 2)
    assert found[0, 0].tolist() == [0, 0, 0] and found[1, 1].tolist() == [255] * 3


def test_crop_plan(spark):
    tiles = spark.createDataFrame([(0, 0, c, r, 1, 2) for c in range(2) for r in range(2)], "slide_id long, level long, col long, row_ long, nbytes long, grid long")
    rects = spark.createDataFrame([(1, 0, 100, 80, 300, 300)], "rect_id long, slide_id long, x long, y long, w long, h long")
    found = {(r.col, r.row_): (r.local_x, r.local_y, r.dst_x, r.dst_y, r.ow, r.oh) for r in T.crop_plan(tiles, rects, 256).collect()}
    assert found[0, 0] == (100, 80, 0, 0, 156, 176) and found[1, 1] == (0, 0, 156, 176, 144, 124)


def test_rotation_and_predictor(spark):
    raster = np.arange(18).reshape(2, 3, 3)
    turned = back(P.rotate_clockwise(pixels(spark, raster), 2), 2, 3)
    assert (turned == np.rot90(raster, -1)).all()
    assert (back(P.predictor(pixels(spark, raster)), 3, 2)[:, 1:] == 3).all()


def test_plans_hold_no_cross_join(spark):
    from tessera.fixtures import Slides
    from tests.conftest import SF

    s = Slides(spark, SF)
    plan = T.crop_plan(s["v_tiles"], s["v_rects"], 64)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
