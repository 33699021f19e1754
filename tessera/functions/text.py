"""Slide descriptions and small texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOFTWARE = "tessera/1"


def plain_number(x: Column) -> Column:
    """A double in its shortest form without an exponent: 0.25, 40, 1.5. For magnitudes from 1e-3 to 1e7."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def aperio_parts(text: Column) -> dict[str, Column]:
    """Banner, geometry and key = value chunks of an Aperio description, `pairs` in order of first appearance, each with
    its last value. Null for other texts, and for one without a second line."""
    flat = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    good = flat.startswith("Aperio") & flat.contains("\n")
    rest = F.when(good, F.substr(flat, F.instr(flat, "\n") + 1, F.length(flat)))
    chunks = F.split(rest, r"\|")
    split = F.transform(F.filter(F.slice(chunks, 2, F.size(chunks)), lambda c: c.contains("=")), lambda c: F.struct(F.trim(F.substr(c, F.lit(1), F.instr(c, "=") - 1)).alias("k"), F.trim(F.substr(c, F.instr(c, "=") + 1, F.length(c))).alias("v")))
    keys = F.array_distinct(F.transform(split, lambda p: p["k"]))
    pairs = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(split, lambda p: p["k"] == k), -1)["v"].alias("v")))
    return {"banner": F.when(good, F.substring_index(flat, "\n", 1)), "geometry": F.get(chunks, F.lit(0)), "pairs": pairs}


def pair_value(pairs: Column, key: str) -> Column:
    return F.get(F.filter(pairs, lambda p: p["k"] == key), F.lit(0))["v"]


def aperio_encoded(banner: Column, geometry: Column, pairs: Column) -> Column:
    return F.concat(banner, F.lit("\r\n"), geometry, F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("|"), p["k"], F.lit(" = "), p["v"])), ""))


def aperio_downsampled(parts: dict[str, Column], factor: int, width: Column, height: Column) -> dict[str, Column]:
    """The parts after a downsample: AppMag divided, MPP multiplied, sides in the geometry and original sides replaced.

    AppMag and MPP are set even where they were missing, but only those of the source are written.
    """
    geometry = parts["geometry"]
    head = F.substring_index(geometry, " ", 1)
    sides = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    changed = F.when(head.contains("x"), F.concat(sides, F.substr(geometry, F.length(head) + 1, F.length(geometry)))).otherwise(geometry)

    # ANSI casts fail on text, so only the two numeric keys are cast.
    def scaled(p: Column) -> Column:
        number = p["v"].try_cast("double")
        v = (
            F.when((p["k"] == "AppMag") & number.isNotNull(), plain_number(number / factor))
            .when((p["k"] == "MPP") & number.isNotNull(), plain_number(number * factor))
            .when(p["k"] == "OriginalWidth", width.cast("string"))
            .when(p["k"] == "OriginalHeight", height.cast("string"))
            .otherwise(p["v"])
        )
        return F.struct(p["k"].alias("k"), v.alias("v"))

    return {"banner": parts["banner"], "geometry": changed, "pairs": F.transform(parts["pairs"], scaled)}


def codec_descriptor(codec: Column) -> Column:
    return F.when(codec == "jpeg2000", "J2K/YUV16").otherwise("JPEG/RGB")


def crop_description(source: Column, base_w: Column, base_h: Column, x: Column, y: Column, w: Column, h: Column, tile: Column, codec: Column, quality: Column) -> Column:
    """The description of a crop: a new header line, the source's description behind a semicolon, the sides before the crop."""
    s = [c.cast("string") for c in (base_w, base_h, x, y, w, h, tile, quality)]
    return F.concat(
        F.lit(f"Aperio Image Library v{SOFTWARE}\r\n"), s[0], F.lit("x"), s[1], F.lit(" ["), s[2], F.lit(","), s[3], F.lit(" "), s[4], F.lit("x"), s[5], F.lit("] ("), s[6], F.lit("x"), s[6], F.lit(") "),
        codec_descriptor(codec), F.lit(" Q="), s[7], F.lit(";"), F.replace(source, F.lit("\r\n"), F.lit("\n")), F.lit("|OriginalWidth = "), s[0], F.lit("|OriginalHeight = "), s[1],
    )


def jpeg_quality_token(geometry: Column) -> Column:
    """The digits behind the first Q=, or null."""
    return F.nullif(F.regexp_extract(geometry, r"^(?:(?!Q=).)*Q=([0-9]+)", 1), F.lit("")).try_cast("bigint")


def quality_swapped(geometry: Column, quality: Column) -> Column:
    """The digits behind the first Q= replaced; a text without any as it is."""
    old = F.regexp_extract(geometry, r"^((?:(?!Q=[0-9]).)*Q=)[0-9]+(.*)$", 1)
    rest = F.regexp_extract(geometry, r"^((?:(?!Q=[0-9]).)*Q=)[0-9]+(.*)$", 2)
    return F.when(old == "", geometry).otherwise(F.concat(old, quality.cast("string"), rest))


def codec_swapped(geometry: Column, codec: Column) -> Column:
    """The first descriptor of a codec in a geometry line replaced by that of another codec."""
    parts = F.split(geometry, r"JPEG/RGB|J2K/YUV16", 2)
    return F.when(F.size(parts) < 2, geometry).otherwise(F.concat(F.get(parts, F.lit(0)), codec_descriptor(codec), F.get(parts, F.lit(1))))


def size_numbers(text: Column) -> Column:
    """WxH as an array of two positive integers, null for anything else."""
    parts = F.transform(F.split(F.lower(text), "x"), lambda p: F.trim(p).try_cast("bigint"))
    return F.when((F.size(parts) == 2) & F.coalesce(F.get(parts, F.lit(0)) > 0, F.lit(False)) & F.coalesce(F.get(parts, F.lit(1)) > 0, F.lit(False)), parts)


def colour_numbers(text: Column) -> Column:
    """#RRGGBB, the mark optional, as an array of three numbers from 0 to 255, null for anything else."""
    digits = F.regexp_extract(F.trim(text), r"^#?([0-9A-Fa-f]{6})$", 1)
    return F.when(digits != "", F.array(*[F.conv(F.substring(digits, k, 2), 16, 10).cast("bigint") for k in (1, 3, 5)]))


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def rect_numbers(text: Column) -> Column:
    """X,Y,W,H as an array of four integers; null unless there are four and the extent is positive."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("bigint"))
    good = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(good & (F.get(parts, F.lit(2)) > 0) & (F.get(parts, F.lit(3)) > 0) & (F.get(parts, F.lit(0)) >= 0) & (F.get(parts, F.lit(1)) >= 0), parts)


def quality_knob(text: Column) -> Column:
    """The knob q of `85` or `k=v,k=v`: 85 if it is not named, null if it isn't 1 to 100 or a chunk has no key."""
    chunks = F.transform(F.split(text, ","), lambda c: F.struct(F.trim(F.substring_index(c, "=", 1)).alias("k"), F.trim(F.substr(c, F.instr(c, "=") + 1, F.length(c))).alias("v"), c.contains("=").alias("named")))
    bad = F.exists(chunks, lambda c: ~c["named"] | (c["k"] == ""))
    named = F.coalesce(F.get(F.reverse(F.filter(chunks, lambda c: c["k"] == "q")), F.lit(0))["v"], F.lit("85"))
    q = F.when(F.coalesce(text, F.lit("")) == "", F.lit("85")).when(text.contains("="), F.when(~bad, named)).otherwise(F.trim(text)).try_cast("bigint")
    return F.when(q.between(1, 100), q)


def format_bytes(n: Column) -> Column:
    """1023 B, 1.0 KB, 1.5 MB, ... by powers of 1024, halves to even."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}B", F.bround(n.cast("double") / float(1024**k), 1))).otherwise(out)
    return out


def locus(pyramid: Column, level: Column, count: Column) -> Column:
    place = F.when(pyramid.isNotNull() & level.isNotNull(), F.concat(F.lit("P"), pyramid.cast("string"), F.lit("/L"), level.cast("string"))).when(pyramid.isNotNull(), F.concat(F.lit("P"), pyramid.cast("string"))).otherwise(F.lit(""))
    return F.concat(place, F.when(count > 1, F.concat(F.when(place != "", " ").otherwise(""), F.lit("×"), count.cast("string"))).otherwise(""))


def quality_text(lossless: Column, layers: Column, estimate: Column, codec: Column) -> Column:
    return (
        F.when(lossless & (layers > 0), F.concat(F.lit("lossless, "), layers.cast("string"), F.lit(" layers")))
        .when(lossless, F.lit("lossless"))
        .when(layers > 0, F.concat(F.lit("lossy, "), layers.cast("string"), F.lit(" layers")))
        .when(estimate > 0, F.concat(F.lit("Q≈"), estimate.cast("string")))
        .otherwise(codec)
    )


def memory_bytes(text: Column) -> Column:
    """A memory size: MiB unless MB, GB, MiB or GiB is named; 0 for off; null for anything else."""
    number = F.regexp_extract(F.trim(text), r"^(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:mib|gib|mb|gb)?$", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(F.trim(text), r"^(?i)[0-9.]+\s*([a-z]*)$", 1))
    size = F.when(unit == "gb", 1e9).when(unit == "mb", 1e6).when(unit == "gib", float(1 << 30)).otherwise(float(1 << 20))
    return F.when(F.lower(F.trim(text)) == "off", F.lit(0)).otherwise(F.floor(number * size)).cast("bigint")
