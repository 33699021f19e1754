"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import in_order, settle


def shuffle_key(ident: Column, seed: int) -> Column:
    """A hash-random key that any SQL engine can compute: MD5 of `seed:id`."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))


def named(source: Column) -> Column:
    """A source as a join key that is never null and tells null from empty."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def part_starts(rows: DataFrame) -> tuple[list[tuple[int, int]], int]:
    """For the parts of `in_order` the number of rows before each, and of all rows. A number for each task is collected."""
    starts, total = [], 0
    for part, n in sorted(tuple(r) for r in rows.groupBy("part").agg(F.max("nth") + 1).collect()):
        starts.append((part, total))
        total += n
    return starts, total


def budgets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Per source of `sizes` (named, source, source_size) its target.

    Sources in order of code points, null last, take the weights in turn. They share `share` of all sizes by weight;
    a target stops at `most` times its source's size, and the excess is dealt again by weight until no target is above.
    Only two sums a round and the count of each task's sources reach the driver.
    """
    spark = sizes.sparkSession
    sorted_ = in_order(sizes.select("named", "source", "source_size"), F.col("source").asc_nulls_last())
    starts, total = part_starts(sorted_)
    if not total:
        return sizes.withColumn("target", F.lit(0.0))
    place = F.col("start") + F.col("nth")
    state = sorted_.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").select(
        "named",
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1).cast("double").alias("weight"),
        F.lit(False).alias("full"),
    )
    state = settle(state)
    whole = state.agg(F.sum("source_size")).first()[0] or 0
    while True:
        left, taken = state.agg(F.sum(F.when(~F.col("full"), F.col("weight"))), F.sum(F.when(F.col("full"), most * F.col("source_size")))).first()
        rest = share * whole - (taken or 0.0)
        goal = F.when(F.col("full"), most * F.col("source_size")).otherwise(F.col("weight") * F.lit(float(rest)) / F.lit(float(left or 1.0)))
        now = state.withColumn("target", goal.cast("double"))
        above = now.where(~F.col("full") & (F.col("target") > most * F.col("source_size")))
        if left is None or above.isEmpty():
            return now.select("named", "source", "source_size", "weight", "target")
        state = settle(now.withColumn("full", F.col("full") | (F.col("target") > most * F.col("source_size"))).drop("target"))


def mix(
    docs: DataFrame,
    size: Column,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """How much of every document a mixture takes: doc_id, source, size, source_size, target, taken.

    `size` is the document's token count. Every source is put in the order of a hash-random key and read again and
    again until its budget, the floor of its target, is spent: the last document is cut at exactly that. Rows are
    range-sorted by source and key over all tasks, and prefix sums are distributed: sums by source and task give each
    such part its offset, and a window within it the rest, so a source of any size is spread over as many tasks as its
    share, and many small ones share a task.

    Defined results: a null or empty text has size 0 and is taken 0 times; a very long one is one document, which the
    budget may cut; a null source is a source of its own, last in order; a null id is hashed as an empty one; rows with
    equal keys follow id, then size; equal rows are taken one after the other; an empty table gives an empty one. Other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), size.alias("size")).withColumn("key", shuffle_key(F.col("doc_id"), seed))
    rows = in_order(settle(rows.withColumn("named", named(F.col("source")))), "named", "key", "doc_id", "size")
    bins = settle(rows.groupBy("named", "part").agg(F.first("source").alias("source"), F.sum("size").alias("bin_size")))
    goal = budgets(bins.groupBy("named").agg(F.first("source").alias("source"), F.sum("bin_size").alias("source_size")), weights, share, most)
    offset = F.sum("bin_size").over(Window.partitionBy("named").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bin_size")
    starts = bins.select("named", "part", offset.alias("offset")).join(goal.select("named", "source_size", "target"), "named")
    placed = rows.join(starts, ["named", "part"])
    inside = Window.partitionBy("named", "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("offset") + F.sum("size").over(inside) - F.col("size")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    return placed.withColumn("before", before).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before")))).cast("long").alias("taken"),
    )
