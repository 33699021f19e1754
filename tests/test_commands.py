"""Whole commands on a small raster."""

import hashlib

import numpy as np
import pytest

from tessera import codecs
from tessera.operators.pyramid import halved
from tessera.plans import commands as Q
from tessera.plans.convert import Refused, Request, Source
from tessera.sources import files, tiff

RASTER = np.random.default_rng(5).integers(0, 256, (70, 90, 3)).astype(np.uint8)
SOURCE = Source("generic-tiff", 90, 70, 32, "lzw", ((90, 70),), 20.0, 0.5)


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(x, y, *map(int, RASTER[y, x])) for y in range(70) for x in range(90)]
    return spark.createDataFrame(rows, "x long, y long, r int, g int, b int").cache()


def test_region(pixels, tmp_path):
    found = Q.region(pixels, 80, 60, 20, 20)
    assert (found[:10, :10] == RASTER[60:, 80:]).all() and (found[10:] == 255).all()
    Q.region_png(pixels, f"file://{tmp_path}/x.png", 0, 0, 9, 7)
    assert (codecs.png_decode(files.get(f"file://{tmp_path}/x.png")) == RASTER[:7, :9]).all()
    with pytest.raises(Refused):
        Q.region(pixels, 0, 0, 1 << 13, 1 << 13)


def test_pixel_hash_is_stable(pixels):
    assert Q.hash_pixels(pixels, 32).first() == Q.hash_pixels(pixels.repartition(5), 32).first()


def test_convert_to_deep_zoom_and_back(spark, pixels, tmp_path):
    p = Q.convert(Request(to="dzi", codec="png", tile=32, factor=2), SOURCE, pixels, f"file://{tmp_path}/s")
    assert (p.how, p.width, p.height, p.mpp) == ("engine", 45, 35, 1.0)
    want = halved(RASTER.astype(int))[:35, :45]
    tiles = spark.read.format("deepzoom").load(f"file://{tmp_path}/s").collect()
    top = max(t.level for t in tiles)
    for t in (t for t in tiles if t.level == top):
        found = codecs.png_decode(bytes(t.bytes))
        y, x = max(0, t.row_ * 32 - 1), max(0, t.col * 32 - 1)  # a pixel of the neighbours on each side
        assert (found == want[y : t.row_ * 32 + 33, x : t.col * 32 + 33]).all()
    assert top == 6 and {t.level for t in tiles} == set(range(7))
    assert codecs.png_decode(bytes(next(t.bytes for t in tiles if t.level == 0))).shape == (1, 1, 3)


def test_copy_keeps_bytes(spark, pixels, tmp_path):
    source = Source("svs", 90, 70, 32, "jpeg", ((90, 70),), 20.0, 0.5)
    rows = [(0, c, r, f"{c} {r}".encode()) for c in range(3) for r in range(3)]
    tiles = spark.createDataFrame(rows, "level int, col int, row_ int, bytes binary")
    assert Q.convert(Request(to="cog-wsi", order="hilbert"), source, pixels, f"file://{tmp_path}/c.tiff", tiles).how == "copy"
    data = files.get(f"file://{tmp_path}/c.tiff")
    values = {t: v for t, _, _, v in next(tiff.walk(data))[3]}
    assert [data[a : a + n] for a, n in zip(values[324], values[325])] == [f"{c} {r}".encode() for r in range(3) for c in range(3)]
    assert Q.hash_files(spark, f"file://{tmp_path}/c.tiff").first().sha256 == hashlib.sha256(data).hexdigest()


def test_names_and_extract(spark):
    assert Q.edited_name("a/b.svs", set()) == "a/b_edited.svs" and Q.edited_name("b.svs", {"b_edited.svs"}) == "b_edited_2.svs" and Q.edited_name("a.b/c", set()) == "a.b/c_edited"
    side = spark.createDataFrame([(1, "label", b"x"), (1, "macro", b"y")], "slide_id long, type string, bytes binary")
    assert Q.extract(side, 1, "label") == b"x"
    with pytest.raises(Refused, match="label, macro"):
        Q.extract(side, 1, "map")
