"""What the operators of this subpackage share: shared folders, checkpoints, partition counts, exact id ranges."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of other characters than these (the class of Java and RE2 syntax).
SPACES = r"[ \t-\r]+"
WORD = r"[^ \t-\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Where none is named a temporary one serves a session on one machine; on a cluster that is an error, as executors
    would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder: a lost executor loses none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bucket(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Deal rows to tasks by the number in `bucket` itself, so that even buckets make even tasks."""
    n = parts(df.sparkSession)
    return df.repartitionById(n, F.pmod(F.col(bucket), F.lit(n)).cast("int"))


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows in one order over all tasks: `part`, and from 0 in each part `nth`. Settled, so that both stay.

    Ranges of the order go to tasks, whatever the values' shares: only rows that agree in the whole order share a task.
    """
    n = parts(df.sparkSession)
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = settle(dealt)
    return at.withColumns({"part": F.shiftright("_at", 33).cast("int"), "nth": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_ranges(df: DataFrame, col: str, most: int, bins: int = 1024) -> list[tuple[int, int, int]]:
    """Disjoint ascending ranges (low, high, rows) of the integer column that hold all its values, each of at most
    `most` rows unless a single value has more. Equal tables give equal ranges.

    Only counts of equal-width bins reach the driver: at most `bins` in a pass and, while a bin is too full, `bins`
    more for it. Nulls are left out.
    """

    def counted(lows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        found = []
        for low, high in lows:
            width = max(1, -(-(high - low + 1) // bins))
            rows = (
                df.where(F.col(col).between(low, high))
                .groupBy(F.expr(f"cast(floor(({col} - ({low}L)) / {width}L) as long)").alias("bin"))
                .agg(F.min(col).alias("low"), F.max(col).alias("high"), F.count(F.lit(1)).alias("n"))
                .collect()
            )
            found += [(r["low"], r["high"], r["n"]) for r in rows]
        return found

    low, high = df.agg(F.min(col), F.max(col)).first()
    if low is None:
        return []
    fine, todo = [], [(low, high)]
    while todo:
        got = counted(todo)
        fine += [x for x in got if x[2] <= most or x[0] == x[1]]
        todo = [x[:2] for x in got if x[2] > most and x[0] < x[1]]
    out: list[tuple[int, int, int]] = []
    for lo, hi, n in sorted(fine):
        if out and out[-1][2] + n <= most:
            out[-1] = (out[-1][0], hi, out[-1][2] + n)
        else:
            out.append((lo, hi, n))
    return out


def range_of(col: str, ranges: list[tuple[int, int, int]]) -> Column:
    """The number of the range that holds the value, found by halving; of the first range for null and before it."""
    lows = F.array(*[F.lit(low).cast("long") for low, _, _ in ranges])  # folded to one literal
    steps = F.sequence(F.lit(0), F.lit(max(1, len(ranges)).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(max(1, len(ranges))).alias("hi"))

    def halve(x: Column, _: Column) -> Column:
        mid = F.floor((x.lo + x.hi) / 2).cast("int")
        below = (x.hi - x.lo > 1) & (F.get(lows, mid) > F.col(col))
        above = (x.hi - x.lo > 1) & (F.get(lows, mid) <= F.col(col))
        return F.struct(F.when(above, mid).otherwise(x.lo).alias("lo"), F.when(below, mid).otherwise(x.hi).alias("hi"))

    return F.aggregate(steps, start, halve, lambda x: x.lo)
