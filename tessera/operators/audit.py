"""Rules over slides and their levels, as queries that return findings (slide_id, code, severity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "error")


def findings(rows: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row for each rule (code -> severity, broken if true) that a row breaks; the table is read once."""
    each = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, (severity, broken) in rules.items()]))
    return rows.select("slide_id", F.explode(each).alias("f")).select("slide_id", "f.*")


def monotone(levels: DataFrame) -> DataFrame:
    """The first level of each slide that is not smaller than the one before in both sides."""
    order = Window.partitionBy("slide_id").orderBy("level")
    rows = levels.withColumn("pw", F.lag("width").over(order)).withColumn("ph", F.lag("height").over(order))
    bad = rows.where((F.col("width") >= F.col("pw")) | (F.col("height") >= F.col("ph")))
    return bad.groupBy("slide_id").agg(F.min("level").alias("level"))


def metadata(slides: DataFrame) -> DataFrame:
    mpp, mag = F.col("mpp"), F.col("magnification")
    return findings(
        slides,
        {
            "mpp-missing": ("warning", mpp <= 0),
            "magnification-range": ("warning", ~mag.between(0.5, 160.0)),
            "mpp-magnification": ("info", (mpp > 0) & (mag > 0) & (F.abs(mpp * mag - 10.0) > 1.0)),
            "dims-positive": ("error", (F.col("width") <= 0) | (F.col("height") <= 0)),
        },
    )


def geometry(levels: DataFrame, outputs: DataFrame, factor: int, tolerance: int = 2) -> DataFrame:
    """Level 0 of outputs against the floor of the source's by the factor."""
    top = levels.where("level = 0").select("slide_id", "width", "height")
    out = outputs.where("level = 0").select("slide_id", F.col("width").alias("ow"), F.col("height").alias("oh"))
    off = (F.abs(F.col("ow") - F.floor(F.col("width") / factor)) > tolerance) | (F.abs(F.col("oh") - F.floor(F.col("height") / factor)) > tolerance)
    return findings(top.join(out, "slide_id"), {"l0-dims-scaled": ("error", off)})


def codecs(levels: DataFrame, wanted: Column) -> DataFrame:
    """Slides whose levels have several codecs, or another than wanted, case and dashes aside."""

    def plain(c: Column) -> Column:
        return F.translate(F.lower(c), "-_", "")

    per = levels.groupBy("slide_id").agg(F.count_distinct(plain(F.col("compression"))).alias("n"), F.bool_and(plain(F.col("compression")) == plain(wanted)).alias("honoured"))
    return findings(per, {"codec-uniform": ("error", F.col("n") > 1), "codec-honoured": ("error", ~F.col("honoured"))})


def verdicts(*tables: DataFrame) -> DataFrame:
    """Findings of several rules by slide: how many of each severity, the worst, and whether it passes, also strictly."""
    every = reduce(DataFrame.unionByName, [t.select("slide_id", "severity") for t in tables])
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    counts = {f"n_{s}": F.count_if(F.col("severity") == s) for s in SEVERITIES}
    per = every.groupBy("slide_id").agg(*[v.alias(k) for k, v in counts.items()], F.max(rank).alias("rank"))
    return per.select("slide_id", *counts, F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank").cast("int")).alias("worst"), (F.col("n_error") == 0).alias("ok"), ((F.col("n_error") == 0) & (F.col("n_warning") == 0)).alias("ok_strict"))
