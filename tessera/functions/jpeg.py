"""JPEG quantisation tables and sampling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
#: The standard luminance table.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]


def standard() -> Column:
    return F.array(*[F.lit(v).cast("double") for v in LUMINANCE])


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def quality_estimate(table: Column) -> Column:
    """The quality whose scaled standard table has the table's mean scale, over entries that are not zero."""
    scales = F.filter(F.zip_with(table, standard(), lambda q, s: F.when(q != 0, q * 100.0 / s)), lambda x: x.isNotNull())
    scale = F.round(mean(scales), 9)
    quality = F.when(scale >= 100, F.lit(5000.0) / scale).otherwise((F.lit(200.0) - scale) / 2)
    return F.greatest(F.lit(1), F.least(F.lit(100), F.floor(quality + 0.5))).cast("bigint")


def variation(table: Column) -> Column:
    """Population standard deviation over mean of the ratios to the standard table: above 0.3 it is a table of its own."""
    ratios = F.zip_with(table, standard(), lambda q, s: q / s)
    middle = mean(ratios)
    return F.sqrt(mean(F.transform(ratios, lambda r: (r - middle) * (r - middle)))) / middle


def chroma_name(h: Column, v: Column, chroma: Column) -> Column:
    """The name of a subsampling, from luma factors; chroma factors other than 1 have none."""
    return F.when(chroma != 1, "unknown").when((h == 1) & (v == 1), "4:4:4").when((h == 2) & (v == 1), "4:2:2").when((h == 2) & (v == 2), "4:2:0").when((h == 4) & (v == 1), "4:1:1").otherwise("unknown")


def quant_tables(embeddings: DataFrame) -> DataFrame:
    """A table for each vector: the standard one at quality 5 to 99, every fourth disturbed."""
    quality = F.col("vec_id") % 95 + 5
    scale = F.when(quality < 50, F.floor(F.lit(5000) / quality)).otherwise(200 - 2 * quality).cast("double")
    bump = F.when(F.col("vec_id") % 4 == 0, 7).otherwise(1)
    places = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.pmod(i, F.col("bump")).cast("double"))
    rows = embeddings.select("vec_id", scale.alias("scale"), bump.alias("bump")).withColumn("bumps", places)
    scaled = F.zip_with(F.transform(standard(), lambda s: F.floor((s * F.col("scale") + 50) / 100).cast("double")), F.col("bumps"), lambda q, b: F.greatest(F.lit(1.0), F.least(F.lit(255.0), q + b)))
    return rows.select("vec_id", scaled.alias("table"))
