"""Codecs, containers, the planner and streams."""

import struct

import numpy as np
import pytest

from tessera import codecs
from tessera.codecs import headers
from tessera.plans import convert as C
from tessera.sources import containers, files, tiff


def test_png_and_lzw():
    rgb = np.random.default_rng(0).integers(0, 256, (33, 17, 3)).astype(np.uint8)
    assert (codecs.png_decode(codecs.encode("png", rgb)) == rgb).all()
    for data in (b"", b"a", bytes(5000), rgb.tobytes() * 9, np.arange(70000, dtype=np.uint16).tobytes()):
        assert codecs.lzw_decode(codecs.lzw_encode(data)) == data


def test_unavailable():
    with pytest.raises(codecs.Unavailable):
        codecs.encode("avif", np.zeros((1, 1, 3), np.uint8))
    with pytest.raises(KeyError):
        codecs.lookup("gif")


def jpeg_header(sampling=0x22, jfif=True, scale=50):
    table = bytes(max(1, (q * scale + 50) // 100) for q in headers.LUMINANCE)

    def part(marker, body):
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    sof = struct.pack(">BHHB", 8, 20, 30, 3) + bytes([1, sampling, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + (part(0xE0, b"JFIF\0\1\1") if jfif else b"") + part(0xDB, b"\0" + table) + part(0xC0, sof) + part(0xDA, b"")


def test_jpeg_facts():
    f = headers.inspect("jpeg", jpeg_header())
    assert (f["width"], f["height"], f["chroma"], f["colorspace"], f["quality"]) == (30, 20, "4:2:0", "YCbCr", 75)
    assert headers.inspect("jpeg", jpeg_header(0x11))["chroma"] == "4:4:4"
    assert headers.inspect("webp", b"broken")["codec"] == "webp"


@pytest.mark.parametrize("kind,order,big", [("tiff", "row-major", False), ("svs", "row-major", True), ("ome-tiff", "row-major", False), ("cog-wsi", "hilbert", False), ("cog-wsi", "morton", True)])
def test_tiff_roundtrip(spark, tmp_path, kind, order, big):
    shape = [(0, 300, 200, 64, 5, 4), (1, 150, 100, 64, 3, 2), (2, 75, 50, 64, 2, 1)]
    rows = [(level, c, r, f"tile {level} {c} {r} ".encode() * (1 + c + r)) for level, _, _, _, cols, n in shape for c in range(cols) for r in range(n)]
    tiles = spark.createDataFrame(rows, "level int, col int, row_ int, bytes binary")
    levels = spark.createDataFrame(shape, "level int, width int, height int, tile int, cols int, rows_ int")
    target = f"file://{tmp_path}/x.tiff"
    size = containers.write_tiff(tiles, levels, target, "jpeg", kind=kind, order=order, big=big, description="text", mpp=0.25)
    data = files.get(target)
    assert len(data) == size and tiff.read_header(data).big is big
    if kind == "cog-wsi":
        assert containers.parse_ghost(data[16 if big else 8 :].split(b"\0")[0])["LAYOUT"] == "IFDS_BEFORE_DATA"
    want = {(level, c, r): b for level, c, r, b in rows}
    places = []
    for number, parent, _, entries in tiff.walk(data):
        values = {t: v for t, _, _, v in entries}
        assert (values[256], values[257]) == ([shape[number][1]], [shape[number][2]])
        assert (parent == 0) is (kind == "ome-tiff" and number > 0)
        for i, (at, n) in enumerate(zip(values[324], values[325], strict=True)):
            assert data[at : at + n] == want.pop((number, i % shape[number][4], i // shape[number][4])) and at % 16 == 0
            places.append((number, at))
    assert not want
    assert [n for n, _ in sorted(places, key=lambda p: p[1])] == sorted([n for n, _ in places], reverse=True)
    found = tiff.read_directories(spark, target).orderBy("ifd").collect()
    assert [(r.width, r.height, r.compression) for r in found] == [(w, h, "jpeg") for _, w, h, *_ in shape]
    assert found[0].description == "text"


def test_directory_loop():
    data = bytearray(struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<HI", 0, 8))
    with pytest.raises(ValueError, match="loop"):
        list(tiff.walk(bytes(data)))
    with pytest.raises(ValueError):
        tiff.read_header(b"nothing here")


def test_ife_nulls(spark, tmp_path):
    tiles = spark.createDataFrame([(0, 0, 0, b"abc"), (0, 1, 1, b"de")], "level int, col int, row_ int, bytes binary")
    levels = spark.createDataFrame([(0, 512, 512, 256, 2, 2)], "level int, width int, height int, tile int, cols int, rows_ int")
    containers.write_ife(tiles, levels, f"file://{tmp_path}/x.iris", "jpeg")
    data = files.get(f"file://{tmp_path}/x.iris")
    table = data.index(b"abcde") + 5 + 56 + 16 + 12 + 16
    entries = [struct.unpack("<Q", data[table + 8 * i : table + 8 * i + 8])[0] for i in range(4)]
    assert [(e & (1 << 40) - 1, e >> 40) for e in entries] == [(38, 3), (containers.NULL_OFFSET, 0), (containers.NULL_OFFSET, 0), (41, 2)]
    with pytest.raises(ValueError):
        containers.write_ife(tiles, levels, f"file://{tmp_path}/y.iris", "webp")


SVS = C.Source("svs", 46000, 32914, 240, "jpeg", ((46000, 32914), (11500, 8228), (2875, 2057)), 20.0, 0.5)


def test_planner():
    assert C.octaves_of(SVS) == (0, 2, 4)
    assert C.plan(C.Request(), SVS).how == "copy"
    assert C.plan(C.Request(codec="jpeg"), SVS).how == "octaves"
    assert C.plan(C.Request(to="tiff", tile=512), SVS).how == "octaves"
    assert C.plan(C.Request(factor=4), SVS).octaves == (0, 2)
    assert C.plan(C.Request(factor=2), SVS).how == "engine"
    assert C.plan(C.Request(target_magnification=5.0), SVS).factor == 4
    assert C.plan(C.Request(to="dzi"), SVS).codec == "jpeg"
    assert C.plan(C.Request(to="svs", codec="webp", allow_nonconformant=True), SVS).warnings
    crop = C.plan(C.Request(rect=(250, 250, 300, 300), lossless=True), SVS)
    assert (crop.how, crop.rect) == ("lossless-crop", (240, 240, 480, 480))
    for bad in (C.Request(factor=3), C.Request(to="bif", codec="png"), C.Request(to="svs", codec="webp"), C.Request(lossless=True), C.Request(rect=(0, 0, 50000, 1)), C.Request(to="svs", order="hilbert"), C.Request(codec="jpeg", quality="0"), C.Request(target_magnification=6.0)):
        with pytest.raises(C.Refused):
            C.plan(bad, SVS)


def test_duplicate_tile_fails(spark, tmp_path):
    from tessera.sources import deepzoom

    deepzoom.register(spark)
    tiles = spark.createDataFrame([(0, 0, 0, b"a"), (0, 0, 0, b"b")], "level int, col int, row_ int, bytes binary")
    with pytest.raises(Exception, match="written twice"):
        tiles.write.format("deepzoom").mode("append").option("width", 1).option("height", 1).save(f"file://{tmp_path}/x")


def test_reorder_stream(spark, tmp_path):
    from tessera.streaming.strips import in_order

    def run(name, rows):
        spark.createDataFrame(rows, "slide_id long, idx long, nbytes long").coalesce(1).write.parquet(f"{tmp_path}/{name}/in")
        stream = spark.readStream.schema("slide_id long, idx long, nbytes long").parquet(f"{tmp_path}/{name}/in")
        q = in_order(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema("slide_id long, idx long, nbytes long").parquet(f"{tmp_path}/{name}/out").collect()

    found = run("good", [(1, 2, 12), (1, 0, 10), (1, 1, 11), (1, 4, 14)])
    assert sorted((r.idx, r.nbytes) for r in found) == [(0, 10), (1, 11), (2, 12)]
