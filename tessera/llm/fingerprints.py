"""Document fingerprints by locally consistent parsing with deterministic coin tossing."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship

from .frames import by_bucket, id_ranges, parts, range_of
from .kernels import BASE, U, mix, pieces

#: The names of phrases of these levels make a fingerprint, a least one in each of BINS parts of the hash space.
LEVELS, BINS = (2, 3, 4), 128
#: Powers for the places of a phrase's symbols: a phrase has at most 12.
POWERS = np.array([pow(int(BASE), k, 1 << 64) for k in range(64)], U)


def tossed(high: int) -> np.ndarray:
    """The label of a symbol from its left neighbour's: twice the lowest place where they differ, plus the bit there."""
    left, own = np.meshgrid(np.arange(high), np.arange(high), indexing="ij")
    differ = left ^ own
    place = np.where(differ > 0, np.bitwise_count((differ & -differ) - 1), 0).astype(np.int64)
    return (2 * place + ((own >> place) & 1)).astype(np.uint8)


TOSS = tossed(128)


def phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names of the phrases of texts whose symbols begin at `first`, and where each text's phrases begin.

    Equal neighbours are one symbol with a count. Four rounds of coin tossing turn symbols into labels below 6 that
    differ between neighbours and depend on four symbols to the left only; a phrase begins at every local maximum. So
    where phrases begin depends on what is near, not on the offset.
    """
    n = len(names)
    lead = np.ones(n, bool)
    lead[1:] = names[1:] != names[:-1]
    begin = first[:-1][first[:-1] < n]
    lead[begin] = True
    at = np.flatnonzero(lead)
    run = np.diff(np.append(at, n))
    first = np.searchsorted(at, first)
    symbols = names[at]
    many = run > 1
    symbols[many] = mix(symbols[many] * BASE + run[many].astype(U))
    n = len(symbols)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    starts = np.flatnonzero(edge[:-1])
    differ = np.ones(n, U)
    differ[1:] = symbols[1:] ^ symbols[:-1]
    differ[starts] = 1
    place = np.bitwise_count(~differ & (differ - U(1)))
    label = (2 * place + ((symbols >> place.astype(U)) & U(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        before = np.empty_like(label)
        before[1:], before[:1] = label[:-1], 0
        before[starts] = 0
        label = TOSS[before, label]
    before, after = np.zeros_like(label), np.zeros_like(label)
    before[1:], after[:-1] = label[:-1], label[1:]
    after[starts[starts > 0] - 1] = 0  # nothing of the next text
    peak = (label > before) & (label >= after)
    peak[starts] = True
    peak[starts[starts + 1 < n] + 1] &= edge[starts[starts + 1 < n] + 1]  # a text's first phrase has two symbols at least
    at = np.flatnonzero(peak)
    size = np.diff(np.append(at, n))
    place = np.arange(n) - np.repeat(at, size)
    named = mix(np.add.reduceat(mix(symbols) * POWERS[place % 64], at) + size.astype(U)) if n else symbols
    return named, np.searchsorted(at, first)


BYTE = mix(np.arange(256, dtype=U) + U(1000))


def sketches(texts: pa.Array) -> np.ndarray:
    """A row of BINS 16-bit values for every text, 0 where no phrase falls; null as empty."""
    out = np.zeros((len(texts), BINS), np.uint16)
    for lo, hi, data, at in pieces(texts):
        least = np.full((hi - lo) * BINS, np.iinfo(np.uint64).max, U)
        names, first = BYTE[data], at
        for level in range(1, max(LEVELS) + 1):
            if not len(names):
                break
            names, first = phrases(names, first)
            if level in LEVELS:
                salted = mix(names + U(level))
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                np.minimum.at(least, row * BINS + (salted >> U(57)).astype(np.int64), salted)
        held = least != np.iinfo(np.uint64).max
        out[lo:hi] = np.where(held, 1 + (mix(least) % U(65535)), 0).astype(np.uint16).reshape(hi - lo, BINS)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of the bins that hold a phrase in either row in which both hold the same one; 1 for two empty rows."""
    either = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    return np.where(either > 0, same / np.maximum(either, 1), 1.0)


def written(sketch: np.ndarray) -> pa.Array:
    return pa.array([base64.b64encode(x.tobytes()).decode() for x in sketch.astype("<u2")])


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many from the start of another text, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(batches: Iterator[pa.RecordBatch], block: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, ghost, doc_id, text) in order: every row with the one behind it; a bucket's last is a ghost."""
    carry: pa.RecordBatch | None = None

    def emit(rows: pa.RecordBatch, end: bool) -> Iterator[pa.RecordBatch]:
        bucket, ghost = rows.column(0).to_numpy(), rows.column(1).to_numpy(zero_copy_only=False)
        n = len(bucket)
        follows = np.arange(1, n + 1)
        inside = np.zeros(n, bool)
        inside[:-1] = bucket[1:] == bucket[:-1]
        own = np.arange(n) < (n if end else n - 1)
        follows[~inside & own] -= 1  # no row behind it: a table without ids
        use = np.flatnonzero(~ghost & own)
        if not len(use):
            return
        texts = [x or "" for x in rows.column(3).to_pylist()]
        changed = [edited(texts[i], texts[j]) for i, j in zip(use.tolist(), follows[use].tolist(), strict=True)]
        sketch, other = sketches(rows.column(3)), sketches(pa.array(changed, pa.large_string()))
        yield pa.record_batch(
            [
                rows.column(2).take(pa.array(use)),
                pa.array([len(texts[i]) for i in use], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                written(sketch[use]),
                written(other),
                pa.array(likeness(sketch[use], other)),
                pa.array(likeness(sketch[use], sketch[follows[use]])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for lo in range(0, batch.num_rows, block):
            rows = batch.slice(lo, block)
            if carry is not None:
                rows = pa.concat_batches([carry, rows])
            yield from emit(rows, False)
            carry = rows.slice(rows.num_rows - 1)
    if carry is not None:
        yield from emit(carry, True)


def fingerprint(docs: DataFrame) -> DataFrame:
    """Only the fingerprints: doc_id, n_chars, fingerprint. Nothing is shuffled. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), written(sketches(batch.column(2)))], names=["doc_id", "n_chars", "fingerprint"])

    ship(docs.sparkSession)
    return docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last third is the next document's beginning, and likenesses.

    A text is parsed into phrases, phrases of phrases and so on; where they begin depends on neighbouring symbols only,
    so equal passages have equal phrase names inside, wherever they stand. The fingerprint keeps a least name in each
    of BINS parts of the hash space over the phrases of LEVELS; likeness estimates the share of common phrases.

    The next document is that with the next smaller id, after the smallest the one with the largest. Texts move once:
    ranges of ids of nearly equal counts go to tasks, each with a copy of the row that follows its last.

    Defined results: a null text is empty, with an empty fingerprint, and like another empty one only; a very long text
    is parsed whole; rows with one id follow a hash of the text; rows without an id are in parts of their own, by a hash
    of the text, each followed by the next one there and the last by itself; an empty table gives an empty one. Other
    columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    total = docs.count()
    most = max(64, total // (4 * parts(spark)) + 1)
    bounds = id_ranges(docs.select("doc_id"), "doc_id", most)
    loose = -(-(total - sum(n for *_, n in bounds)) // most)  # parts of the rows without an id, by a hash of the text
    rows = docs.select("doc_id", "text")
    own, follower = F.lit(0), F.lit(None).cast("int")
    if bounds:
        last = F.array(*[F.lit(high).cast("long") for _, high, _ in bounds])  # followed by the range above, the last by the first
        own = range_of("doc_id", bounds)
        follower = F.when(F.array_contains(last, F.col("doc_id")), F.pmod(own + 1, F.lit(len(bounds))).cast("int"))
    if loose:
        own = F.when(F.col("doc_id").isNull(), len(bounds) + F.pmod(F.xxhash64("text"), F.lit(loose)).cast("int")).otherwise(own)
    rows = rows.withColumn("own", own).withColumn("follower", follower)
    places = F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ghost")), F.when(F.col("follower").isNotNull(), F.struct(F.col("follower").alias("bucket"), F.lit(True).alias("ghost")))))
    dealt = rows.select(F.explode(places).alias("p"), "doc_id", "text").select("p.bucket", "p.ghost", "doc_id", "text")
    order = ["bucket", "ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    return by_bucket(dealt).sortWithinPartitions(*order).mapInArrow(compared, OUT)
