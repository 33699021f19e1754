"""NumPy kernels on Arrow columns: words, their names and the names of windows of words, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keeps the first 0 to 8 bytes of a little-endian word.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the SplitMix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), starts[1], ..."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def pieces(texts: pa.Array, most: int = 1 << 19, rows: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of about `most` bytes and at most `rows` rows of a string column: first row, end row, bytes, offsets; null
    as empty. A longer text is a stretch of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, bounds, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(at, at[lo] + most, "right")) - 1))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def find_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie at `at`, and each text's first word (with the end as the last)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def name_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit name for each word: equal words have equal names, and words of one length up to 8 bytes different ones."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    left = ends - starts
    names = mix((left.astype(U) * BASE + U(seed)) ^ (eight[starts] & KEEP[np.minimum(left, 8)]))
    rows, at = np.flatnonzero(left > 8), 8
    while len(rows):
        names[rows] = mix(names[rows] * BASE + (eight[starts[rows] + at] & KEEP[np.minimum(left[rows] - at, 8)]))
        at += 8
        rows = rows[left[rows] > at]
    return names


def rolled(names: np.ndarray, width: int) -> np.ndarray:
    """A name for every window of `width` names, by doubling; windows run across texts here."""
    if width == 1:
        return names
    half = width // 2
    low = rolled(names, half)
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    two = low[: len(low) - half] * U(pow(int(BASE), half, 1 << 64)) + low[half:]
    if width == 2 * half:
        return two
    return two[:n] * BASE + names[2 * half : 2 * half + n]


def windows(names: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the windows that lie inside one text, and their counts by text."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    every = rolled(names, width)
    return every[ranges(first[:-1], counts)] if len(every) else np.zeros(0, U), counts


def packed(values: np.ndarray, bucket: np.ndarray, n: int, *others: np.ndarray) -> list[tuple[int, list[bytes]]]:
    """Arrays split by bucket number: for every bucket that has rows, its bytes of each array."""
    order = np.argsort(bucket, kind="stable")
    columns = [x[order] for x in (values, *others)]
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    return [(b, [x[ends[b] : ends[b + 1]].tobytes() for x in columns]) for b in range(n) if ends[b + 1] > ends[b]]


def groups_of(bucket_rows: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[pa.Table]:
    """Tables of the rows of one key, from batches in order of the key."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in bucket_rows:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if held and keys[lo] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
