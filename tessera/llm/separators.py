"""Token counts of documents in flat, unindexed token files, by their separators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.shipping import ship

from .frames import parts, settle
from .store import Atomic, opened
from .tokens import encoder


def flat_file(batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int, kind: str) -> Iterator[pa.RecordBatch]:
    code, out = encoder(path), None
    for batch in batches:
        for text in batch.column(0):
            ids = np.array([*code.encode(text.as_py() or "", added=False), end], kind)
            out = out or Atomic(f"{folder}/tokens-{TaskContext.get().partitionId():06d}.bin")
            out.write(ids.tobytes())
    if out:
        size = out.size // np.dtype(kind).itemsize
        yield pa.record_batch([pa.array([out.commit()]), pa.array([size], pa.int64())], names=["file", "n_tokens"])


def write_flat(docs: DataFrame, folder: str, path: str, end: int, kind: str = "<u2") -> DataFrame:
    """Token ids of all texts, each followed by `end`, in flat files, one for each task: file, n_tokens.

    Defined results: a null or empty text is `end` alone; a very long one is written as one document; rows are written
    one by one, equal ones too; an empty table makes no file. Only the text is read. An id that `kind` cannot hold is
    an error.
    """
    ship(docs.sparkSession)
    return settle(docs.select("text").mapInArrow(lambda it: flat_file(it, folder, path, end, kind), "file string, n_tokens long"))


def searched(batches: Iterator[pa.RecordBatch], folder: str, end: int, kind: str) -> Iterator[pa.RecordBatch]:
    files, path = opened(folder)
    width = np.dtype(kind).itemsize
    for batch in batches:
        found = []
        for file, start, length in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3)], strict=True):
            with files.open_input_file(f"{path}/{file}") as source:
                ids = np.frombuffer(source.read_at(length * width, start * width), kind)
            if len(ids) != length:
                raise ValueError(f"{file} ends before token {start + length}")
            found.append(start + np.flatnonzero(ids == end))
        yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=["file", "block", "start", "length", "ends"])


def count_tokens(files: DataFrame, folder: str, end: int, kind: str = "<u2", block: int = 1 << 20) -> DataFrame:
    """Documents of flat token files (file, n_tokens) in `folder`: file, ordinal, start, n_tokens, ended.

    Files are read in blocks of `block` tokens, each by any task, and a vectorised search finds the separators. A
    prefix scan over a file's blocks gives every block the number of separators before it and the place of the last,
    so that a document over several blocks is counted once. n_tokens is without the separator.

    Defined results: two separators in a row hold a document of 0 tokens; tokens behind the last separator are a
    document that has not ended; a document may be longer than any block; an empty file has none; a file named twice
    is read once; a null name or count is no file; an empty table gives an empty one. Columns other than file and
    n_tokens are not read.
    """
    spark = files.sparkSession
    ship(spark)
    cut = files.select("file", "n_tokens").dropDuplicates(["file"]).where("file is not null and n_tokens > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / block))))
    start = F.col("block") * block
    blocks = cut.select("file", "block", start.alias("start"), F.least(F.lit(block).cast("long"), F.col("n_tokens") - start).alias("length"))
    found = settle(blocks.repartition(parts(spark)).mapInArrow(lambda it: searched(it, folder, end, kind), "file string, block long, start long, length long, ends array<long>"))
    last_end = F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)
    light = found.select("file", "block", F.size("ends").alias("n"), last_end.alias("at"), (F.col("start") + F.col("length")).alias("upto"))
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # The scan of a file holds a number or two for each block; the separators stay where they were found.
    places = light.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("done"),
        F.coalesce(F.max("at").over(before), F.lit(-1)).alias("last"),
        "upto",
        F.lead("block").over(in_file).isNull().alias("final"),
    )
    scanned = found.select("file", "block", "ends").join(places, ["file", "block"])
    docs = scanned.select("file", "done", "last", "ends", F.posexplode("ends").alias("i", "at")).select(
        "file",
        (F.col("done") + F.col("i")).alias("ordinal"),
        (F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.col("last")) + 1).alias("start"),
        F.col("at"),
        F.lit(True).alias("ended"),
    )
    tip = F.greatest("last", F.coalesce(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1), F.lit(-1)))
    tail = scanned.where("final").select("file", (F.col("done") + F.size("ends")).alias("ordinal"), (tip + 1).alias("start"), F.col("upto").alias("at"), F.lit(False).alias("ended")).where("at > start")
    return docs.union(tail).select("file", F.col("ordinal").cast("long").alias("ordinal"), "start", (F.col("at") - F.col("start")).alias("n_tokens"), "ended")
