"""DICOM series and edits of TIFF files."""

import struct

import pytest

from tessera.sources import containers, dicom, files, splice, tiff


def stripped(big=False):
    """Three directories with one strip each, each directory followed by its own data."""
    data = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    head = tiff.Header("<", big, 0)
    link, width = (8, "Q") if big else (4, "I")
    out = bytearray(data)
    for i in range(3):
        entries = [(256, 4, 1, [10 + i]), (259, 3, 1, [1]), (270, 2, 12, f"directory {i}"), (273, 4, 1, [0]), (279, 4, 1, [5 + i])]
        struct.pack_into("<" + width, out, link, len(out))
        body, pointer = splice.emitted(entries, [bytes([65 + i]) * (5 + i)], head, len(out))
        link = len(out) + pointer
        out += body
    return bytes(out)


def seen(data):
    out = []
    for _, _, _, entries in tiff.walk(data):
        v = {t: x for t, _, _, x in entries}
        out.append((v[270], data[v[273][0] : v[273][0] + v[279][0]]))
    return out


ALL = [(f"directory {i}", bytes([65 + i]) * (5 + i)) for i in range(3)]
NEW = [(256, 4, 1, [9]), (270, 2, 4, "new"), (273, 4, 1, [0]), (279, 4, 1, [3])]


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("at", [0, 1, 2])
def test_splice(big, at):
    data = stripped(big)
    assert seen(data) == ALL
    assert seen(splice.splice(data, at, "remove")) == ALL[:at] + ALL[at + 1 :]
    assert seen(splice.splice(data, at, "replace", NEW, [b"xyz"])) == [*ALL[:at], ("new", b"xyz"), *ALL[at + 1 :]]
    assert seen(splice.splice(data, at, "insert", NEW, [b"xyz"])) == [*ALL[:at], ("new", b"xyz"), *ALL[at:]]
    kept = splice.splice(data, 2, "remove")
    assert kept[8:100] == data[8:100] or at or big


def test_append_and_refusal():
    data = stripped()
    assert seen(splice.splice(data, 9, "insert", NEW, [b"xyz"])) == [*ALL, ("new", b"xyz")]
    _, chain, _ = splice.directory_ranges(data)
    moved = bytearray(data + b"AAAAA")
    entries, _ = tiff.read_directory(data, tiff.read_header(data), chain[0])
    place = chain[0] + 2 + 12 * [t for t, *_ in entries].index(273) + 8
    struct.pack_into("<I", moved, place, len(data))
    with pytest.raises(splice.Interleaved):
        splice.splice(bytes(moved), 1, "remove")


def test_dicom(spark, tmp_path):
    shape = [(0, 100, 60, 32, 4, 2), (1, 50, 30, 32, 2, 1)]
    rows = [(level, c, r, f"frame {level}{c}{r}".encode() + b"x" * c) for level, _, _, _, cols, n in shape for c in range(cols) for r in range(n)]
    tiles = spark.createDataFrame(rows, "level int, col int, row_ int, bytes binary")
    levels = spark.createDataFrame(shape, "level int, width int, height int, tile int, cols int, rows_ int")
    folder = f"file://{tmp_path}/series"
    assert dicom.write_series(tiles, levels, folder, mpp=0.25) == ["level-0.dcm", "level-1.dcm"]
    for level, w, _, tile, cols, n in shape:
        e = dicom.read_elements(files.get(f"{folder}/level-{level}.dcm"))
        assert struct.unpack("<I", e[0x48, 6]) == (w,) and e[0x28, 8].strip() == str(cols * n).encode()
        for k in range(cols * n):
            want = next(b for lv, c, r, b in rows if (lv, c, r) == (level, k % cols, k // cols))
            assert e[0x7FE0, 0x10, k].rstrip(b"\0") == want and len(e[0x7FE0, 0x10, k]) % 2 == 0
    with pytest.raises(ValueError, match="of 8 tiles"):
        dicom.write_series(tiles.where("col < 3"), levels, f"{folder}-2")
    with pytest.raises(ValueError, match="there already"):
        dicom.write_series(tiles, levels, folder)
    with pytest.raises(ValueError, match="transfer syntax"):
        dicom.write_series(tiles, levels, f"{folder}-3", "webp")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["series"]
    elements = list(dicom.read_elements(files.get(f"{folder}/level-0.dcm")))
    top = [k[:2] for k in elements if k[0] > 2 and len(k) == 2]
    assert top == sorted(top)


def test_decimal_string():
    assert dicom.decimal_string(0.00025) == "0.00025" and dicom.decimal_string(4.0) == "4"
    assert len(dicom.decimal_string(1 / 3)) <= 16 and len(dicom.decimal_string(-1.23456789012345e-7)) <= 16


def test_ghost():
    data = containers.ghost_area()
    assert data.startswith(b"GDAL_STRUCTURAL_METADATA_SIZE=%06d bytes\n" % (len(data) - 43))
    found = containers.parse_ghost(data)
    assert found["LAYOUT"] == "IFDS_BEFORE_DATA" and found["BLOCK_ORDER"] == "ROW_MAJOR" and not any("LEADER" in k or "TRAILER" in k for k in found)
