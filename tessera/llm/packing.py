"""Best-fit packing of token sequences: local best-fit, then a tree of merges of the bins that are not full."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.shipping import ship

from .frames import parts, settle
from .tokens import encoder

ITEM = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
#: A merge takes this many tasks' bins. Pieces that a task of the first round packs at a time.
FAN, CHUNK = 8, 1 << 19


def tokenized(batches: Iterator[pa.RecordBatch], path: str, end: int, most: int) -> Iterator[pa.RecordBatch]:
    code = encoder(path)
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.array([*code.encode(text.as_py() or ""), end], "<u4")
            lead = len(ids) % most or most  # the first piece takes what the full ones leave
            bounds = [0, *range(min(lead, len(ids)), len(ids) + 1, most)]
            rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
        if rows:
            doc, piece, start, length, crc = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, path: str, end: int = 0, most: int = 2048) -> DataFrame:
    """Token pieces of at most `most` ids of every document, its ids followed by `end`: doc_id, piece, start, length, ids_crc32.

    Only a document of more than `most` ids is cut, into full pieces behind a first one that may be shorter. An added
    token's literal in a text is that token's id. Nothing is shuffled.

    Defined results: a null or empty text's piece is `end` alone; a very long text, of white space too, has as many
    pieces as it needs; rows are cut one by one, those with equal or null ids too; an empty table gives an empty one.
    Other columns are not read.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda it: tokenized(it, path, end, most), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing: the bin of every item, and the number of bins. A bit set of the room left finds the fullest bin."""
    bin_of = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            left, b = capacity, bins
            bins += 1
        bin_of[i] = b
        left -= size
        if left:
            room[left].append(b)
            some |= 1 << left
    return bin_of, bins


def packed_bins(items: pa.ListArray, fills: np.ndarray, capacity: int, least: float, home: int, first: int = 0) -> pa.RecordBatch:
    """Bins of one task: the items of its parts joined, each with its place; the fill, whether the bin is finished, the task's number."""
    bin_of, n = best_fit(fills, capacity)
    order = np.argsort(bin_of, kind="stable")
    fill = np.bincount(bin_of, fills, n).astype(np.int64)
    taken = items.take(pa.array(order))
    counts = np.diff(np.asarray(taken.offsets))
    whole = np.bincount(bin_of[order], counts, n).astype(np.int64)
    flat = taken.flatten()
    lengths = flat.field("length").to_numpy()
    before = np.cumsum(lengths) - lengths
    bounds = np.concatenate([[0], np.cumsum(whole)])
    placed = before - np.repeat(before[bounds[:-1]], whole)
    names = [f.name for f in flat.type]
    flat = pa.StructArray.from_arrays([pa.array(placed) if k == "offset" else flat.field(k) for k in names], names=names)
    joined = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)
    done = fill >= least * capacity
    return pa.record_batch([joined, pa.array(fill), pa.array(done), pa.array(np.full(n, home, np.int32)), pa.array(np.arange(first, first + n, dtype=np.int64))], names=["items", "fill", "done", "home", "number"])


def first_round(batches: Iterator[pa.RecordBatch], capacity: int, least: float, chunk: int) -> Iterator[pa.RecordBatch]:
    """Bins of each `chunk` of a task's pieces, in an order that does not depend on how the pieces arrive."""
    held: list[pa.RecordBatch] = []
    first = 0

    def pack_held() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = ("ids_crc32", "start", "piece", "doc_id", "length")
        table = table.take(pa.array(np.lexsort([np.nan_to_num(table.column(k).to_numpy()) for k in keys]))).combine_chunks()
        columns = [c.combine_chunks() for c in table.columns]
        parts_ = pa.StructArray.from_arrays([*columns, pa.array(np.zeros(len(table), np.int64))], names=[*table.column_names, "offset"])
        items = pa.ListArray.from_arrays(pa.array(np.arange(len(parts_) + 1), pa.int32()), parts_)
        return packed_bins(items, table.column("length").to_numpy(), capacity, least, TaskContext.get().partitionId(), first)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= chunk:
            yield (out := pack_held())
            held, first = [], first + out.num_rows
    if sum(b.num_rows for b in held):
        yield pack_held()


def merge_round(batches: Iterator[pa.RecordBatch], capacity: int, least: float) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if rows:
        table = pa.Table.from_batches(rows).combine_chunks()
        order = np.lexsort((table.column("number").to_numpy(), table.column("home").to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        yield packed_bins(table.column("items").combine_chunks(), table.column("fill").to_numpy(), capacity, least, TaskContext.get().partitionId())


BIN = f"items array<{ITEM}>, fill long, done boolean, home int, number long"


def worth_merging(bins: DataFrame, capacity: int) -> DataFrame:
    """The open bins that a merge of whole bins can use, and no others: home, number.

    A merge saves a bin only by putting one into another, and of two such bins one is at most half full. So with s bins
    at most half full in all, s hosts are enough, and the emptiest of each task do: whatever fits beside a fuller bin
    fits beside an emptier one. Local best-fit leaves one such bin a chunk, so s does not grow with the pieces.
    """
    small = bins.where(~F.col("done") & (2 * F.col("fill") <= capacity))
    s, least = small.agg(F.count(F.lit(1)), F.min("fill")).first()
    if not s:
        return bins.where(F.lit(False)).select("home", "number")
    fits = bins.where(~F.col("done") & (F.col("fill") + least <= capacity))
    rank = F.row_number().over(Window.partitionBy("home").orderBy("fill", "number"))
    return fits.select("home", "number", "fill", rank.alias("rank")).where(F.col("rank") <= 2 * s).select("home", "number")


def pack(pieces: DataFrame, capacity: int = 2048, full: float = 0.998, chunk: int = CHUNK) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32), none longer than `capacity`, in sequences: their columns,
    sequence_id and offset.

    The pieces' rows, of some fifty bytes, are dealt by hash, so that every task has the whole table's mixture of
    lengths however the table is sorted. Every task packs its own pieces best-fit decreasing. Bins of at least the share
    `full` are finished; the others are items of the next round, in which one of FAN times fewer tasks packs what as
    many handed on, down to one task. The share falls from round to round. A bin that no other can go into or beside is
    finished as it is (`worth_merging`), so what is handed on has a bound, and no merge that could save a sequence is
    left out for it. Every round is settled before it is read twice.

    Defined results: equal rows are different pieces; pieces of one length are taken in order of id, piece, start and
    checksum; an empty table gives an empty one; columns other than the five are dropped.
    """
    spark = pieces.sparkSession
    ship(spark)
    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(parts(spark), F.xxhash64("doc_id", "piece", "start", "ids_crc32"))
    state = settle(dealt.mapInArrow(lambda it: first_round(it, capacity, full, chunk), BIN))
    tasks = (state.agg(F.max("home")).first()[0] or 0) + 1
    done, level = [], 0
    while True:
        open_ = worth_merging(state, capacity) if level == 0 or tasks > 1 else None
        if open_ is None:
            break
        open_ = settle(open_)
        left = state.join(open_, ["home", "number"], "left_semi")
        done.append(state.join(open_, ["home", "number"], "left_anti").withColumn("round", F.lit(level)))
        level += 1
        tasks = -(-tasks // FAN)
        least = full - 0.01 * level if tasks > 1 else 0.0
        dealt = left.repartitionById(tasks, F.floor(F.col("home") / FAN).cast("int"))
        state = settle(dealt.mapInArrow(lambda it, least=least: merge_round(it, capacity, least), BIN))
    done.append(state.withColumn("round", F.lit(level)))
    every = functools.reduce(DataFrame.unionByName, done)
    # Tasks in 2 ** 26, bins of one task in 2 ** 32, rounds in the rest.
    number = F.shiftleft(F.col("round").cast("long"), 58) + F.shiftleft(F.col("home").cast("long"), 32) + F.col("number")
    return every.select(number.alias("sequence_id"), F.explode("items").alias("x")).select("x.doc_id", "x.piece", "x.start", "x.length", "x.ids_crc32", "sequence_id", "x.offset")
