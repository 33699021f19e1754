"""Slides as files: opened, converted, reduced, cropped, edited, and the JPEG codec against another decoder."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import codecs
from tessera.codecs import headers
from tessera.codecs import jpeg as J
from tessera.plans import commands as Q
from tessera.plans.convert import Refused, Request
from tessera.sources import bif, containers, dicom, files, slides, tiff

YY, XX = np.mgrid[:150, :210]
IMAGE = np.stack([127 + 100 * np.sin(XX / 19) * np.cos(YY / 23), 127 + 90 * np.cos(XX / 31 + YY / 17), (XX + YY) / 2], -1).clip(0, 255).astype(np.uint8)
LABEL = np.random.default_rng(3).integers(0, 256, (20, 30, 3)).astype(np.uint8)
KNOBS = {"q": "92", "ss": "4:4:4"}


def tiles_of(image, tile, codec, knobs):
    rows = []
    for r in range(-(-image.shape[0] // tile)):
        for c in range(-(-image.shape[1] // tile)):
            part = image[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]
            part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)), mode="edge")
            rows.append((0, c, r, codecs.encode(codec, part, knobs)))
    return rows


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """A tiled TIFF of JPEG tiles with a label and a macro image; its URI and its tiles."""
    rows = tiles_of(IMAGE, 64, "jpeg", KNOBS)
    tiles = spark.createDataFrame(rows, "level int, col int, row_ int, bytes binary")
    levels = spark.createDataFrame([(0, 210, 150, 64, 4, 3)], "level int, width int, height int, tile int, cols int, rows_ int")
    target = f"file://{tmp_path_factory.mktemp('slides')}/source.tiff"
    strips = (codecs.encode("lzw", LABEL[:8]), codecs.encode("lzw", LABEL[8:16]), codecs.encode("lzw", LABEL[16:]))
    sides = (containers.Side("label", 30, 20, "lzw", strips, 8), containers.Side("macro", 40, 24, "jpeg", (codecs.encode("jpeg", IMAGE[:24, :40]),), 24, subsampling=(2, 2)), containers.Side("map", 30, 20, "lzw", strips, 8))
    containers.write_tiff(tiles, levels, target, "jpeg", mpp=0.5, look=containers.Look(subsampling=(1, 1), make="maker", private=True, magnification=20.0, mpp=(0.5, 0.5)), sides=sides)
    return target, {(c, r): b for _, c, r, b in rows}


def pixels_of(spark, path, level=0, reduce=1):
    slide = slides.open_slide(path)
    v = slide.levels[level]
    out = np.zeros((-(-v.height // reduce), -(-v.width // reduce), 3), np.int64)
    for p in slides.read_pixels(spark, slide, level, reduce).collect():
        out[p.y, p.x] = p.r, p.g, p.b
    return out


def off(a, b):
    return np.abs(a.astype(int) - b.astype(int)).mean()


def test_open(spark, source):
    slide = slides.open_slide(source[0])
    assert (slide.format, slide.mpp, slide.magnification, slide.make) == ("generic-tiff", 0.5, 20.0, "maker")
    v = slide.levels[0]
    assert (v.width, v.height, v.cols, v.rows, v.codec, v.photometric, v.subsampling) == (210, 150, 4, 3, "jpeg", 6, (1, 1))
    assert [a.type for a in slide.associated] == ["label", "macro", "map"]
    assert (slides.side_pixels(slide.associated[0]) == LABEL).all()
    assert off(pixels_of(spark, source[0]), IMAGE) < 2
    small = pixels_of(spark, source[0], reduce=4)
    assert small.shape == (38, 53, 3) and off(small[:36, :52], IMAGE[:144, :208].reshape(36, 4, 52, 4, 3).mean((1, 3))) < 3
    slides.register(spark)
    read = spark.read.format("slide").option("tilesPerTask", 5)
    assert {(r.col, r.row_): bytes(r.bytes) for r in read.load(source[0]).collect()} == source[1]
    assert [tuple(r) for r in read.option("table", "associated").load(source[0]).collect()][0][:4] == ("label", 30, 20, "lzw")


def test_no_slide(tmp_path):
    (tmp_path / "x").write_bytes(b"nothing at all")
    (tmp_path / "empty").mkdir()
    for name in ("x", "empty"):
        with pytest.raises(slides.NotASlide):
            slides.open_slide(f"file://{tmp_path}/{name}")


@pytest.mark.parametrize("to", ["cog-wsi", "ome-tiff", "svs"])
def test_copy(spark, source, tmp_path, to):
    p = Q.convert_file(spark, Request(to=to), source[0], f"file://{tmp_path}/x.tiff")
    assert p.how == "copy"
    slide = slides.open_slide(f"file://{tmp_path}/x.tiff")
    assert slide.format == to
    assert {(r.col, r.row_): bytes(r.bytes) for r in slides.read_tiles(spark, slide).collect()} == source[1]
    before = {a.type: slides.side_bytes(a) for a in slides.open_slide(source[0]).associated}
    after = {a.type: slides.side_bytes(a) for a in slide.associated}
    assert after == {k: v for k, v in before.items() if to != "cog-wsi" or k != "map"}
    assert p.warnings == (("left out: type map",) if to == "cog-wsi" else ())
    assert slide.levels[0].photometric == 6 and abs(slide.mpp - 0.5) < 1e-3
    assert tiff.read_directories(spark, f"file://{tmp_path}/x.tiff").where("has_private").count() == (3 if to == "cog-wsi" else 0)


def test_abbreviated_tiles_keep_their_tables(spark, tmp_path):
    rows = tiles_of(IMAGE, 64, "jpeg", KNOBS)
    tables = J.split_tables(rows[0][3])[0]
    short = spark.createDataFrame([(a, b, c, J.split_tables(d)[1]) for a, b, c, d in rows], "level int, col int, row_ int, bytes binary")
    levels = spark.createDataFrame([(0, 210, 150, 64, 4, 3)], "level int, width int, height int, tile int, cols int, rows_ int")
    containers.write_tiff(short, levels, f"file://{tmp_path}/a.tiff", "jpeg", look=containers.Look(tables=tables, subsampling=(1, 1)))
    Q.convert_file(spark, Request(to="cog-wsi"), f"file://{tmp_path}/a.tiff", f"file://{tmp_path}/b.tiff")
    assert slides.open_slide(f"file://{tmp_path}/b.tiff").levels[0].tables == tables
    assert off(pixels_of(spark, f"file://{tmp_path}/b.tiff"), IMAGE) < 2


def test_transcode_downsample_crop(spark, source, tmp_path):
    Q.transcode(spark, source[0], f"file://{tmp_path}/t.tiff", "jpeg", "q=95,ss=4:4:4")
    assert off(pixels_of(spark, f"file://{tmp_path}/t.tiff"), IMAGE) < 2.5
    assert slides.open_slide(f"file://{tmp_path}/t.tiff").levels[0].subsampling == (1, 1)
    with pytest.raises(Refused):
        Q.transcode(spark, source[0], f"file://{tmp_path}/u.tiff", "")
    p = Q.downsample(spark, source[0], f"file://{tmp_path}/d.tiff", 2)
    half = slides.open_slide(f"file://{tmp_path}/d.tiff")
    assert (half.levels[0].width, half.levels[0].height, p.mpp, half.magnification) == (105, 75, 1.0, 0.0)
    assert off(pixels_of(spark, f"file://{tmp_path}/d.tiff"), IMAGE.reshape(75, 2, 105, 2, 3).mean((1, 3))) < 5
    assert Q.downsample(spark, source[0], f"file://{tmp_path}/e.tiff", target_magnification=10.0).factor == 2
    p = Q.crop(spark, source[0], f"file://{tmp_path}/c.tiff", (70, 66, 60, 60), lossless=True)
    assert (p.how, p.rect) == ("lossless-crop", (64, 64, 128, 64))
    cut = slides.open_slide(f"file://{tmp_path}/c.tiff")
    found = {(r.col, r.row_): bytes(r.bytes) for r in slides.read_tiles(spark, cut, [0]).collect()}
    assert found == {(c, 0): source[1][c + 1, 1] for c in range(2)}
    Q.crop(spark, source[0], f"file://{tmp_path}/f.tiff", (70, 66, 60, 61))
    assert off(pixels_of(spark, f"file://{tmp_path}/f.tiff"), IMAGE[66:127, 70:130]) < 5


def test_zip_and_dicom(spark, source, tmp_path):
    Q.convert_file(spark, Request(to="szi", codec="png", tile=64), source[0], f"file://{tmp_path}/s.szi")
    slide = slides.open_slide(f"file://{tmp_path}/s.szi")
    assert (slide.format, len(slide.levels), slide.levels[-1].width, slide.levels[0].width) == ("szi-overlapping", 9, 1, 210)
    first = slides.read_tiles(spark, slide, [0]).where("col = 1 and row_ = 1").first()
    assert off(codecs.png_decode(bytes(first.bytes)), IMAGE[63:129, 63:129]) < 2
    assert (codecs.png_decode(files.get(f"file://{tmp_path}/s_associated/label.png")) == LABEL).all()
    Q.convert_file(spark, Request(to="dicom", codec="jpeg", quality="95"), source[0], f"file://{tmp_path}/series")
    slide = slides.open_slide(f"file://{tmp_path}/series")
    assert slide.format == "dicom" and sorted(a.type for a in slide.associated) == ["label", "macro", "macro"]
    assert abs(slide.mpp - 0.5) < 1e-6 and off(pixels_of(spark, f"file://{tmp_path}/series"), IMAGE) < 5
    tiles = spark.createDataFrame([(0, 0, 0, bytes(192))], "level int, col int, row_ int, bytes binary")
    one = spark.createDataFrame([(0, 8, 8, 8, 1, 1)], "level int, width int, height int, tile int, cols int, rows_ int")
    dicom.write_series(tiles, one, f"file://{tmp_path}/other", "none")
    (tmp_path / "series" / "other.dcm").write_bytes((tmp_path / "other" / "level-0.dcm").read_bytes())
    with pytest.raises(slides.AmbiguousSeries, match="2 series"):
        slides.open_slide(f"file://{tmp_path}/series")


@pytest.mark.parametrize("to", ["tiff", "cog-wsi", "ome-tiff"])
def test_edit_side_images(spark, source, tmp_path, to):
    Q.convert_file(spark, Request(to=to), source[0], f"file://{tmp_path}/a.tiff")
    how = Q.edit_associated(spark, f"file://{tmp_path}/a.tiff", f"file://{tmp_path}/b.tiff", "macro")
    b = slides.open_slide(f"file://{tmp_path}/b.tiff")
    assert "macro" not in [a.type for a in b.associated] and (slides.side_pixels(b.associated[0]) == LABEL).all()
    new = LABEL[::-1].copy()
    Q.edit_associated(spark, f"file://{tmp_path}/b.tiff", f"file://{tmp_path}/c.tiff", "label", new)
    Q.edit_associated(spark, f"file://{tmp_path}/c.tiff", f"file://{tmp_path}/d.tiff", "macro", IMAGE[:24, :40])
    d = slides.open_slide(f"file://{tmp_path}/d.tiff")
    sides = {a.type: a for a in d.associated}
    assert (slides.side_pixels(sides["label"]) == new).all() and off(slides.side_pixels(sides["macro"]), IMAGE[:24, :40]) < 8
    assert {(r.col, r.row_): bytes(r.bytes) for r in slides.read_tiles(spark, d).collect()} == source[1]
    assert how in ("spliced", "rebuilt")
    with pytest.raises(Refused, match="no thumbnail"):
        Q.edit_associated(spark, f"file://{tmp_path}/a.tiff", f"file://{tmp_path}/e.tiff", "thumbnail")
    with pytest.raises(Refused, match="no side image"):
        Q.edit_associated(spark, f"file://{tmp_path}/a.tiff", f"file://{tmp_path}/e.tiff", "pyramid")


@pytest.mark.parametrize("ss", ["4:4:4", "4:2:0"])
def test_jpeg_against_the_jvm(spark, tmp_path, ss):
    """What the encoder writes is read alike by Java's decoder, through Spark's image source."""
    data = codecs.encode("jpeg", IMAGE, {"q": "90", "ss": ss})
    (tmp_path / "x.jpg").write_bytes(data)
    theirs = Q.read_image(spark, f"{tmp_path}/x.jpg")
    assert theirs.shape == IMAGE.shape and off(theirs, J.decode(data)) < (0.6 if ss == "4:4:4" else 2)
    assert off(theirs, IMAGE) < 3 and headers.inspect("jpeg", data)["chroma"] == ss == codecs.emitted_sampling("jpeg", {"ss": ss})
    (tmp_path / "x.png").write_bytes(codecs.encode("png", LABEL))
    assert (Q.read_image(spark, f"{tmp_path}/x.png") == LABEL).all()


def test_jpeg_edges():
    for shape in ((1, 1), (7, 9), (8, 8), (17, 33)):
        flat = np.full((*shape, 3), 77, np.uint8)
        assert (np.abs(J.decode(codecs.encode("jpeg", flat)).astype(int) - 77) <= 2).all()
    noise = np.random.default_rng(0).integers(0, 256, (40, 40, 3)).astype(np.uint8)
    assert off(J.decode(codecs.encode("jpeg", noise, {"q": "100", "ss": "4:4:4"})), noise) < 1
    with pytest.raises(J.Unsupported):
        J.decode(b"\xff\xd8\xff\xd9")
    with pytest.raises(ValueError):
        J.decode(codecs.encode("jpeg", noise)[:700])


def test_lazy_transcode(spark, source):
    slide = slides.open_slide(source[0])
    found = {(r.col, r.row_): codecs.png_decode(bytes(r.bytes)) for r in slides.transcoded_tiles(spark, slide, "png").collect()}
    assert all((found[k] == J.decode(b)).all() for k, b in source[1].items()) and len(found) == len(source[1])


def test_layered_and_bif(spark, source, tmp_path):
    """Both containers, from a source whose tiles must be made anew, read back with their side images and facts."""
    p = Q.convert_file(spark, Request(to="ife", quality="92"), source[0], f"file://{tmp_path}/x.iris")
    slide = slides.open_slide(f"file://{tmp_path}/x.iris")
    assert (p.how, slide.format, slide.make, round(slide.mpp, 3), slide.magnification) == (p.how, "ife", "maker", 0.5, 20.0)
    assert [a.type for a in slide.associated] == ["label", "macro", "map"]
    assert (slides.side_pixels(slide.associated[0]) == LABEL).all()
    assert off(pixels_of(spark, f"file://{tmp_path}/x.iris"), IMAGE) < 5
    Q.convert_file(spark, Request(to="bif", quality="92"), source[0], f"file://{tmp_path}/x.bif")
    slide = slides.open_slide(f"file://{tmp_path}/x.bif")
    assert (slide.format, slide.levels[0].width, slide.levels[0].height) == ("bif", 256, 192)
    assert off(pixels_of(spark, f"file://{tmp_path}/x.bif")[:150, :210], IMAGE) < 5
    assert (slide.associated[0].width, slide.associated[0].height) == bif.OVERVIEW
    entries = {(r.ifd, r.tag): r.value for r in tiff.read_entries(spark, f"file://{tmp_path}/x.bif", full=True).collect()}
    xmp = bytes(json.loads(entries[1, 700])).decode()
    assert xmp.count("<Frame ") == 12 and xmp.count('Direction="LEFT"') == 9 and xmp.count('Direction="UP"') == 8
    assert json.loads(entries[1, 270]).startswith("level=0 mag=20")
    shown = bif.overview(None, np.zeros((10, 20, 3), np.uint8))
    assert (shown[: bif.OVERVIEW[1] // 3] == 255).all() and (shown[bif.OVERVIEW[1] // 3 :] == 0).any()


def test_zip64(tmp_path):
    """Offsets and counts beyond 32 and 16 bits are read as they were written."""
    line = containers.zip_central(b"a", 1, 5, 1 << 33)
    end = containers.zip_end(70_000, len(line), 1 << 34)
    assert end[:4] == b"PK\6\6" and b"PK\6\7" in end and len(containers.zip_end(3, 9, 9)) == 22
    n = 66_000
    lines = b"".join(containers.zip_central(f"m{i}".encode(), 0, i, (1 << 33) + i) for i in range(n))
    (tmp_path / "z").write_bytes(lines + containers.zip_end(n, len(lines), 0))
    found = slides.zip_members("z", files.Ranged(f"file://{tmp_path}/z"))
    assert len(found) == n and found["m65999"] == ("z", (1 << 33) + 65_999 + 30 + 6, 65_999)


def test_rectangles_and_text(spark):
    assert Q.rect_of("1, 2,3,4") == (1, 2, 3, 4) == Q.rect_of(x=1, y=2, w=3, h=4)
    for bad in ({"rect": "1,2,3"}, {"rect": "1,2,3,x"}, {"rect": "1,2,0,4"}, {"rect": "1,2,3,4", "x": 1}, {"x": 1}, {}):
        with pytest.raises(Refused):
            Q.rect_of(**bad)
    assert Q.progress(50, 200, 5.0) == (25.0, 10.0, 15.0) and Q.progress(0, 0, 0.0)[0] == 100.0
    df = spark.createDataFrame([(1, "x"), (22, None)], "a int, b string").orderBy("a")
    assert Q.rendered(df).split("\n") == ["a   b", "1   x", "22"]
    assert Q.rendered(df, as_json=True).split("\n")[0] == '{"a":1,"b":"x"}'


def test_ranged_reads(tmp_path):
    data = np.random.default_rng(1).integers(0, 256, 300_000).astype(np.uint8).tobytes()
    (tmp_path / "x").write_bytes(data)
    r = files.Ranged(f"file://{tmp_path}/x", block=1000, keep=3)
    for a, b in ((0, 10), (995, 1005), (2500, 9000), (299_990, 300_000), (5, 5), (299_999, 400_000)):
        assert r[a:b] == data[a:b]
    assert len(r) == len(data) and len(r.held) <= 3


def test_pyramid_in_steps(spark):
    """A pyramid deeper than one shuffle makes is the same as by halving again and again, for two rasters at once."""
    from tessera.operators import pyramid as P

    rows, want = [], {}
    for k, (w, h) in enumerate(((23, 9), (5, 18))):
        raster = np.random.default_rng(k).integers(0, 256, (h, w, 3))
        rows += [(k, x, y, *map(int, raster[y, x])) for y in range(h) for x in range(w)]
        for level in range(1, 6):
            raster = P.halved(raster)
            want |= {(k, level, x, y): tuple(raster[y, x]) for y in range(raster.shape[0]) for x in range(raster.shape[1])}
    df = spark.createDataFrame(rows, "slide_id long, x long, y long, r int, g int, b int")
    found = {(p.slide_id, p.level, p.x, p.y): (p.r, p.g, p.b) for p in P.pyramid(df, 5, ("slide_id",), depth=2).collect()}
    assert found == want
    assert P.box_halve(df.withColumn("w", F.lit(23)), F.col("w"), F.lit(9), keys=("slide_id",)).where("slide_id = 0").count() == 12 * 5


@pytest.mark.parametrize("to", ["szi", "ife", "bif"])
def test_more_than_2048_rows_of_tiles(spark, tmp_path, to):
    """Keys of tiles by rows are 64 bits wide: 2048 * 2 ** 20 is beyond 32."""
    n, tile, target = 2050, 256, f"file://{tmp_path}/x.{to}"
    tiles = spark.createDataFrame([(12 if to == "szi" else 0, 0, r, b"%d" % r) for r in range(n)], "level int, col int, row_ int, bytes binary")
    levels = spark.createDataFrame([(0, tile, n * tile, tile, 1, n)], "level int, width int, height int, tile int, cols int, rows_ int")
    if to == "szi":
        containers.write_szi(tiles, target, "x", 1, 0, "png", 1, n, "<image/>")
    elif to == "ife":
        containers.write_ife(tiles, levels, target, "jpeg")
    else:
        bif.write_bif(tiles, levels, target, np.zeros((1, 1, 3), np.uint8))
    found = slides.read_tiles(spark, slides.open_slide(target), [0]).collect()
    assert sorted((r.col, r.row_, bytes(r.bytes)) for r in found) == sorted((0, r, b"%d" % r) for r in range(n))
