"""The planner's decision as columns: one plan for every slide of a table and each of some targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import codes


def octave_sets(octaves: DataFrame, tolerance: int = 2) -> DataFrame:
    """Per slide its levels' octaves, and whether they are clean: equal in both sides, each near its size, none twice."""
    near = [F.abs(F.ceil(F.col(a) / F.pow(F.lit(2.0), F.col("kw"))) - F.col(b)) <= tolerance for a, b in (("w0", "width"), ("h0", "height"))]
    good = (F.col("kw") == F.col("kh")) & (F.col("kw") >= 0) & near[0] & near[1]
    return octaves.groupBy("slide_id").agg((F.bool_and(good) & (F.count_distinct("kw") == F.count(F.lit(1)))).alias("clean"), F.collect_set("kw").alias("octaves"))


def planned(slides: DataFrame, octaves: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """slide_id, target, how, codec, width, height, mpp of slides with a `factor`, at the source's own tile size and
    without a codec asked for: as `plans.convert.plan` decides, but as expressions over the whole table."""
    rows = slides.join(octave_sets(octaves), "slide_id").withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    codec = F.lit("jpeg")
    refused = F.lit(False)
    for t in targets:
        good, loose = codes.CAPABILITIES[t]
        default = "png" if t in ("dzi", "szi") else "jpeg"
        own = F.col("compression").isin(*good, *loose)
        codec = F.when(F.col("target") == t, F.when(own, F.col("compression")).otherwise(default)).otherwise(codec)
        if loose:
            refused = F.when(F.col("target") == t, own & F.col("compression").isin(*loose)).otherwise(refused)
    tiled = F.col("format").isin(*codes.TILED_FORMATS)
    copied = tiled & (F.col("factor") == 1) & codes.copies_codec(F.col("target"), F.col("compression"))
    shift = F.log2(F.col("factor")).cast("bigint")
    how = F.when(refused, "refused").when(copied, "copy").when(F.col("clean") & tiled & F.array_contains("octaves", shift), "octaves").otherwise("engine")
    size = [F.floor(F.col(c) / F.col("factor")).alias(c) for c in ("width", "height")]
    return rows.select("slide_id", "target", how.alias("how"), codec.alias("codec"), *size, (F.col("mpp") * F.col("factor")).alias("mpp"))
