"""Proportional stratified interleaving into shards: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import in_order, settle
from .mixing import named, part_starts, shuffle_key


def interleave(docs: DataFrame, columns: dict[str, Column], shards: int, seed: int = 0) -> DataFrame:
    """Deal every row to one of `shards` shards: doc_id, source, the given columns, shard, slot.

    Rows are ranked within their source in the order of a hash-random key; the rank as a fraction of the source's rows
    orders the whole table, and that order is cut into shards whose counts differ by one at most. So every shard, and
    every stretch of one, holds each source in the mixture's share. Both orders are range sorts over all tasks, and both
    ranks are exact: counts by task and source give offsets to places within a task. Neither a source of any size nor
    any number of sources whose fractions tie lands in one task.

    Defined results: a null source is a source of its own; null ids are hashed as empty; equal fractions follow the
    source, null last, then key and id; equal rows take neighbouring places; what a column holds, an empty or very long
    text too, does not matter; an empty table gives an empty one. Columns that are not named are not read.
    """
    given = {f"given_{i}": c for i, c in enumerate(columns.values())}
    rows = docs.select("doc_id", "source", *[c.alias(k) for k, c in given.items()]).withColumn("key", shuffle_key(F.col("doc_id"), seed))
    rows = in_order(settle(rows.withColumn("named", named(F.col("source")))), "named", "key", "doc_id", *given)
    of = Window.partitionBy("named")
    up_to = of.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = rows.groupBy("named", "part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    starts = bins.select("named", "part", "first", (F.sum("n").over(up_to) - F.col("n")).alias("start"), F.sum("n").over(of).alias("of"))
    rank = F.col("start") + F.col("nth") - F.col("first") + 1
    ranked = rows.join(starts, ["named", "part"]).select("doc_id", "source", *given, "key", ((2 * rank - 1).cast("double") / (2 * F.col("of")).cast("double")).alias("fraction"))
    ranked = in_order(settle(ranked), "fraction", F.col("source").asc_nulls_last(), "key", "doc_id", *given)
    offsets, total = part_starts(ranked)
    offset = F.broadcast(docs.sparkSession.createDataFrame(offsets, "part int, before long"))  # a row for each task
    small, large = total // shards, total % shards  # the first `large` shards hold one row more
    edge = large * (small + 1)
    place = F.col("place")
    shard = F.when(place < edge, F.floor(place / (small + 1))).otherwise(large + F.floor((place - edge) / max(1, small)))
    start = F.when(F.col("shard") < large, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - large) * small)
    return (
        ranked.join(offset, "part")
        .withColumn("place", F.col("before") + F.col("nth"))
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("place") - start).cast("long"))
        .select("doc_id", "source", *[F.col(g).alias(k) for g, k in zip(given, columns, strict=True)], "shard", "slot")
    )
