"""Lookup tables of codecs, containers, tags and transfer syntaxes, as plain data and as small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
#: TIFF compression tag -> codec name.
COMPRESSION_NAMES = {1: "none", 5: "lzw", 7: "jpeg", 8: "deflate", 32946: "deflate", 33003: "jpeg2000", 33005: "jpeg2000", 34712: "jpeg2000", 50001: "webp", 50002: "jpegxl", 60001: "avif", 60003: "htj2k"}
#: Codec name -> the tag that is written; others have none.
COMPRESSION_TAGS = {"none": 1, "lzw": 5, "jpeg": 7, "deflate": 8, "jpeg2000": 33003, "webp": 50001, "jpegxl": 50002, "avif": 60001, "htj2k": 60003}
#: Container -> codecs that conform, codecs that need leave.
CAPABILITIES = {
    "tiff": (("jpeg", "jpeg2000", "htj2k", "avif", "webp", "jpegxl"), ()),
    "cog-wsi": (("jpeg", "jpeg2000", "htj2k", "avif", "webp", "jpegxl"), ()),
    "svs": (("jpeg", "jpeg2000"), ("htj2k", "avif", "webp", "jpegxl")),
    "ome-tiff": (("jpeg", "jpeg2000"), ("htj2k", "avif", "webp", "jpegxl")),
    "dicom": (("jpeg", "jpeg2000", "htj2k"), ()),
    "dzi": (("jpeg", "png"), ()),
    "szi": (("jpeg", "png"), ()),
    "bif": (("jpeg",), ()),
    "ife": (("jpeg", "avif"), ()),
}
#: Target -> codecs whose tiles it takes as they are.
COPIED = {
    "cog-wsi": ("jpeg", "webp", "jpeg2000", "avif", "jpegxl", "htj2k"),
    "tiff": ("jpeg", "webp", "jpeg2000", "avif", "jpegxl", "htj2k"),
    "ome-tiff": ("jpeg", "webp", "jpeg2000", "avif", "jpegxl", "htj2k"),
    "svs": ("jpeg", "jpeg2000"),
}
TILED_FORMATS = ("svs", "philips-tiff", "ome-tiff", "bif", "ife", "generic-tiff", "cog-wsi", "dicom", "szi")
#: Codec, lossless -> transfer syntax, lossy method.
SYNTAXES = {
    ("jpeg", False): ("1.2.840.10008.1.2.4.50", "ISO_10918_1"),
    ("jpeg2000", True): ("1.2.840.10008.1.2.4.90", None),
    ("jpeg2000", False): ("1.2.840.10008.1.2.4.91", "ISO_15444_1"),
    ("htj2k", True): ("1.2.840.10008.1.2.4.201", None),
    ("htj2k", False): ("1.2.840.10008.1.2.4.203", "ISO_15444_15"),
    ("jpegxl", False): ("1.2.840.10008.1.2.4.112", "ISO_18181_1"),
}
TYPE_NAMES = {1: "BYTE", 2: "ASCII", 3: "SHORT", 4: "LONG", 5: "RATIONAL", 6: "SBYTE", 7: "UNDEFINED", 8: "SSHORT", 9: "SLONG", 10: "SRATIONAL", 11: "FLOAT", 12: "DOUBLE", 13: "IFD", 16: "LONG8", 17: "SLONG8", 18: "IFD8"}
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TAG_NAMES = {
    254: "NewSubfileType",
    255: "SubfileType",
    256: "ImageWidth",
    257: "ImageLength",
    258: "BitsPerSample",
    259: "Compression",
    262: "PhotometricInterpretation",
    270: "ImageDescription",
    271: "Make",
    272: "Model",
    273: "StripOffsets",
    277: "SamplesPerPixel",
    278: "RowsPerStrip",
    279: "StripByteCounts",
    282: "XResolution",
    283: "YResolution",
    284: "PlanarConfiguration",
    296: "ResolutionUnit",
    305: "Software",
    306: "DateTime",
    317: "Predictor",
    322: "TileWidth",
    323: "TileLength",
    324: "TileOffsets",
    325: "TileByteCounts",
    330: "SubIFDs",
    339: "SampleFormat",
    347: "JPEGTables",
    530: "YCbCrSubSampling",
    34675: "ICCProfile",
    65080: "WSIImageType",
    65081: "WSILevelIndex",
    65082: "WSILevelCount",
    65083: "WSISourceFormat",
    65084: "WSIWriterVersion",
    65085: "WSIMPPX",
    65086: "WSIMPPY",
    65087: "WSIMagnification",
}
#: Private tags: the image's type, its level, the number of levels, the source's format, the writer, pixel sizes, magnification.
PRIVATE_TAGS = (65080, 65081, 65082, 65083, 65084, 65085, 65086, 65087)
PHOTOMETRICS = {0: "white-is-zero", 1: "black-is-zero", 2: "rgb", 3: "palette", 6: "ycbcr", 8: "cielab", 33005: "ycbcr-wavelet"}
IMAGE_TYPES = ("pyramid", "label", "macro", "thumbnail", "overview", "probability", "map", "associated")
ASSOCIATED_TYPES = ("label", "macro", "thumbnail", "overview", "probability", "map", "associated")


def one_of(column: Column, words: tuple[str, ...]) -> Column:
    return column.isin(*words) if words else F.lit(False)


def codec_verdict(container: Column, codec: Column, allowed: Column) -> Column:
    """conformant, nonconformant (allowed or not) or unsupported, from the capability table as one expression."""
    out = F.lit("unsupported")
    for name, (good, loose) in CAPABILITIES.items():
        verdict = F.when(one_of(codec, good), "conformant").when(one_of(codec, loose), F.when(allowed, "nonconformant-allowed").otherwise("nonconformant")).otherwise("unsupported")
        out = F.when(container == name, verdict).otherwise(out)
    return out


def copies_codec(target: Column, codec: Column) -> Column:
    out = F.lit(False)
    for name, words in COPIED.items():
        out = F.when(target == name, one_of(codec, words)).otherwise(out)
    return out


def compression_tag(codec: Column) -> Column:
    """The tag that is written for a codec, 0 for none."""
    return F.coalesce(*[F.when(codec == k, v) for k, v in COMPRESSION_TAGS.items()], F.lit(0)).cast("bigint")


def compression_name(tag: Column) -> Column:
    named = [F.when(tag == k, v) for k, v in COMPRESSION_NAMES.items()]
    return F.coalesce(*named, F.concat(F.lit("tag-"), tag.cast("string")))


def transfer_syntax(codec: Column, lossless: Column) -> tuple[Column, Column]:
    syntax = F.coalesce(*[F.when((codec == c) & (lossless == x), s) for (c, x), (s, _) in SYNTAXES.items()])
    method = F.coalesce(*[F.when((codec == c) & (lossless == x), m) for (c, x), (_, m) in SYNTAXES.items() if m])
    return syntax, method


def subfile_text(value: Column) -> Column:
    bits = ((1, "reduced-resolution"), (2, "page-of-multi"), (4, "transparency-mask"))
    return F.concat_ws("|", *[F.when(value.bitwiseAND(F.lit(b)) != 0, name) for b, name in bits])


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A lookup table of this module, whose size is fixed: it may be sent to all tasks."""
    return F.broadcast(spark.createDataFrame(rows, schema))
