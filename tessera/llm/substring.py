"""Substring deduplication: winnowed anchors as seeds, extended to every repeated window that holds one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.shipping import ship

from .frames import by_bucket, parts
from .kernels import U, find_words, groups_of, mix, name_words, packed, pieces, ranges, rolled


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every `width` neighbours, by doubling."""
    out, p = x, 1
    while 2 * p <= width:
        out, p = pick(out[:-p], out[p:]), 2 * p
    rest = width - p
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def seed_width(length: int) -> int:
    return max(1, min(8, length // 2))


class Text:
    """Names of the words of some texts, those of `use` only, and of the anchor of each window of `length` words.

    A window's anchor is the least name among the runs of seed_width(length) words that it holds, so equal windows have
    equal anchors wherever they stand: winnowing.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, use: np.ndarray | None = None):
        self.data, self.length = data, length
        self.starts, self.ends, self.first = find_words(data, at)
        self.n_words = np.diff(self.first)
        use = np.ones(len(self.n_words), bool) if use is None else use
        self.used = np.flatnonzero(np.repeat(use, self.n_words))  # words
        lengths = np.where(use, self.n_words, 0)
        first = np.cumsum(lengths) - lengths
        self.names = self.named(1)
        self.counts = np.maximum(lengths - length + 1, 0)  # windows of each text
        self.at = ranges(first, self.counts)  # the first word of each, among the used

    def named(self, seed: int) -> np.ndarray:
        return name_words(self.data, self.starts[self.used], self.ends[self.used], seed)

    def anchors(self) -> np.ndarray:
        if not len(self.at):
            return np.zeros(0, U)
        seeds = mix(rolled(self.names, seed_width(self.length)))
        return sliding(seeds, self.length - seed_width(self.length) + 1, np.minimum)[self.at]

    def documents(self, ids: np.ndarray) -> np.ndarray:
        """The document of every window."""
        return np.repeat(ids, self.counts)

    def windows(self, where: np.ndarray | slice = slice(None)) -> np.ndarray:
        return mix(rolled(self.names, self.length))[self.at[where]] if len(self.at) else np.zeros(0, U)

    def more(self, where: np.ndarray) -> np.ndarray:
        """32 bits more of the windows' names, from another seed."""
        return (mix(rolled(self.named(0xC0FFEE), self.length))[self.at[where]] >> U(32)).astype(np.uint32)


def among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which keys are in the ordered array."""
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def owned(names: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """One key for a name in a document."""
    return mix(names + mix(docs.astype(U)))


def unique_pairs(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order of name, then document."""
    order = np.lexsort((docs, names))
    names, docs = names[order], docs[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (docs[1:] != docs[:-1])
    return names[new], docs[new]


def thin(docs: np.ndarray) -> bytes:
    """Document ids as 32-bit distances from the least where those are enough, else as they are; the first byte tells."""
    base = int(docs.min()) if len(docs) else 0
    if len(docs) and int(docs.max()) - base < 1 << 32:
        return b"\4" + base.to_bytes(8, "little", signed=True) + (docs - base).astype("<u4").tobytes()
    return b"\x08" + docs.astype("<i8").tobytes()


def thick(blob: bytes) -> np.ndarray:
    if blob[0] == 4:
        return np.frombuffer(blob, "<u4", offset=9).astype(np.int64) + int.from_bytes(blob[1:9], "little", signed=True)
    return np.frombuffer(blob[1:], "<i8").astype(np.int64)


@dataclass(frozen=True)
class Passed:
    """Ids that are passed on as they came."""

    raw: bytes


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (bucket, kind, three byte strings); the second holds 64-bit ids and is sent thin."""
    rows = [(bucket, kind, a, thin(np.frombuffer(b, np.int64)) if isinstance(b, bytes) else b.raw, c) for bucket, kind, a, b, c in rows]
    bucket, kind, a, b, c = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), *[pa.array(x, pa.binary()) for x in (a, b, c)]], names=["bucket", "kind", "names", "docs", "more"])


SENT = "bucket int, kind int, names binary, docs binary, more binary"
ASKED, SETTLED = 0, 1
#: Kinds of rows of a bucket of documents: marks, which come first, and texts.
MARKS, TEXTS = 0, 1


def doc_bucket(docs: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document: Spark's own hash of its id (Murmur3 of a 64-bit number from the seed 42) modulo n."""
    u = np.uint32
    h = np.full(len(docs), 42, u)
    bits = docs.astype(np.int64).view(U)
    for half in ((bits & U(0xFFFFFFFF)).astype(u), (bits >> U(32)).astype(u)):
        k = half * u(0xCC9E2D51)
        k = (k << u(15) | k >> u(17)) * u(0x1B873593)
        h ^= k
        h = (h << u(13) | h >> u(19)) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return (h ^ h >> u(16)).view(np.int32).astype(np.int64) % n


def known_rows(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    known = np.asarray(ids.is_valid())
    return known, np.where(known, ids.to_numpy(zero_copy_only=False), 0).astype(np.int64)


def split_shared(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct (name, document) pairs in order: which names have several documents, and each name's first row."""
    lead = np.ones(len(names), bool)
    lead[1:] = names[1:] != names[:-1]
    at = np.flatnonzero(lead)
    size = np.diff(np.append(at, len(names)))
    return np.repeat(size > 1, size), lead


def seeded(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors of every batch. Those in several of its documents are known to be shared; of every anchor one document is sent."""
    for batch in batches:
        known, ids = known_rows(batch.column(0))
        got = []
        for lo, hi, data, at in pieces(batch.column(1)):
            text = Text(data, at, length)
            anchors, use = text.anchors(), text.documents(known[lo:hi])
            use[1:] &= (anchors[1:] != anchors[:-1]) | (np.diff(text.documents(np.arange(hi - lo))) != 0)  # neighbours mostly have one
            got.append((anchors[use], text.documents(ids[lo:hi])[use]))
        if not got:
            continue
        names, docs = unique_pairs(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))
        shared, lead = split_shared(names, docs)
        rows = [(b, ASKED, n, d, s) for b, (n, d, s) in packed(names[lead], bucket_of_name(names[lead], buckets), buckets, docs[lead], shared[lead])]
        rows += [(b, SETTLED, n, d, b"") for b, (n, d) in packed(names[shared & ~lead], doc_bucket(docs[shared & ~lead], buckets), buckets, docs[shared & ~lead])]
        yield row_batch(rows)


def bucket_of_name(names: np.ndarray, n: int) -> np.ndarray:
    return (names >> U(20)).astype(np.int64) % n


def shared_seeds(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of the anchors sent, those of several documents, for each document: rows for its bucket."""
    for table in groups_of(batches):
        rows = []
        kind = table.column("kind").to_numpy()
        columns = [table.column(c).to_pylist() for c in ("names", "docs", "more")]
        for i in np.flatnonzero(kind == SETTLED):
            rows.append((int(table.column("bucket")[int(i)].as_py()), SETTLED, columns[0][i], Passed(columns[1][i]), b""))
        at = np.flatnonzero(kind == ASKED)
        if len(at):
            names = np.frombuffer(b"".join([columns[0][i] for i in at]), U)
            docs = np.concatenate([thick(columns[1][i]) for i in at])
            flag = np.frombuffer(b"".join([columns[2][i] for i in at]), bool)
            order = np.argsort(names, kind="stable")
            names, docs, flag = names[order], docs[order], flag[order]
            lead = np.ones(len(names), bool)
            lead[1:] = names[1:] != names[:-1]
            first = np.flatnonzero(lead)
            size = np.diff(np.append(first, len(names)))
            several = (size > 1) | np.logical_or.reduceat(flag, first)
            use = np.repeat(several, size)
            rows += [(b, SETTLED, n, d, b"") for b, (n, d) in packed(names[use], doc_bucket(docs[use], buckets), buckets, docs[use])]
        yield row_batch(rows)


#: A codec's state is costly to make, so each worker keeps one.
ZSTD = pa.Codec("zstd", compression_level=1)


def compact(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows with one string column compressed, text by text, behind its length: texts are most of what is shuffled."""
    for batch in batches:
        made = []
        for text in batch.column(column):
            raw = text.as_buffer()
            made.append(raw.size.to_bytes(5, "little") + ZSTD.compress(raw, asbytes=True) if raw is not None and raw.size else bytes(5))
        columns = [pa.array(made, pa.binary()) if k == column else c for k, c in enumerate(batch.columns)]
        yield pa.record_batch(columns, names=batch.schema.names)


def packed_pieces(texts: pa.Array, most: int = 1 << 19, rows: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """`pieces` of compressed texts: only one piece is unpacked at a time."""
    sizes = [int.from_bytes(x.as_buffer()[:5].to_pybytes(), "little") for x in texts]
    lo = 0
    while lo < len(sizes):
        hi, total = lo + 1, sizes[lo]
        while hi < len(sizes) and hi - lo < rows and total + sizes[hi] <= most:
            total += sizes[hi]
            hi += 1
        body = b"".join([ZSTD.decompress(texts[i].as_buffer()[5:], sizes[i], asbytes=True) if sizes[i] else b"" for i in range(lo, hi)])
        yield lo, hi, np.frombuffer(body, np.uint8), np.concatenate([[0], np.cumsum(sizes[lo:hi])])
        lo = hi


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Texts with the marks of their bucket: keys of names in documents in order, those documents, a batch of texts.

    Rows come by bucket, its marks (rows with names) before its texts, so only marks and one batch are held.
    """
    now, held = None, []
    asked, some = np.zeros(0, U), np.zeros(0, np.int64)
    for batch in batches:
        bucket, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
            if lo == hi:
                continue
            if bucket[lo] != now:
                now, held = bucket[lo], []
                asked, some = np.zeros(0, U), np.zeros(0, np.int64)
            rows = batch.slice(lo, hi - lo)
            if kind[lo] == MARKS:
                for names, docs in zip(rows.column(2), rows.column(3), strict=True):
                    held.append((np.frombuffer(names.as_buffer(), U), thick(docs.as_py())))
                continue
            if held:
                names, docs = (np.concatenate(x) for x in zip(*held, strict=True))
                held, asked, some = [], np.unique(owned(names, docs)), np.unique(docs)
            yield asked, some, rows


def extended(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Matches at shared anchors, extended both ways: the windows from the anchor as their last seed to it as their first.

    Windows of a smaller document of this batch are settled, of the others the smallest document is sent.
    """
    for asked, some, rows in marked(batches):
        known, ids = known_rows(rows.column(4))
        got = []
        for lo, hi, data, at in packed_pieces(rows.column(5)) if len(asked) else ():
            text = Text(data, at, length, known[lo:hi] & among(ids[lo:hi], some))
            docs = text.documents(ids[lo:hi])
            where = np.flatnonzero(among(owned(text.anchors(), docs), asked))
            if len(where):
                got.append((text.windows(where), text.more(where), docs[where]))
        if not got:
            continue
        one, two, docs = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((docs, two, one))
        one, two, docs = one[order], two[order], docs[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        fresh = new.copy()
        fresh[1:] |= docs[1:] != docs[:-1]
        least = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
        late = fresh & (docs != least)
        out = [(b, ASKED, n, d, m) for b, (n, d, m) in packed(one[new], bucket_of_name(one[new], buckets), buckets, docs[new], two[new])]
        out += [(b, SETTLED, n, d, b"") for b, (n, d) in packed(one[late], doc_bucket(docs[late], buckets), buckets, docs[late])]
        yield row_batch(out)


def repeats(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of the windows sent, those with a smaller document, for each document: rows for its bucket."""
    for table in groups_of(batches):
        rows = []
        kind = table.column("kind").to_numpy()
        columns = [table.column(c).to_pylist() for c in ("names", "docs", "more")]
        for i in np.flatnonzero(kind == SETTLED):
            rows.append((int(table.column("bucket")[int(i)].as_py()), SETTLED, columns[0][i], Passed(columns[1][i]), b""))
        at = np.flatnonzero(kind == ASKED)
        if len(at):
            one = np.frombuffer(b"".join([columns[0][i] for i in at]), U)
            docs = np.concatenate([thick(columns[1][i]) for i in at])
            two = np.frombuffer(b"".join([columns[2][i] for i in at]), np.uint32)
            order = np.lexsort((docs, two, one))
            one, two, docs = one[order], two[order], docs[order]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            late = docs != docs[np.flatnonzero(new)][np.cumsum(new) - 1]
            rows += [(b, SETTLED, n, d, b"") for b, (n, d) in packed(one[late], doc_bucket(docs[late], buckets), buckets, docs[late])]
        yield row_batch(rows)


def stretches(text: Text, hit: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal repeats: first words, among the used, and lengths of the runs of neighbouring windows that are repeats.

    `hit` has the first words of those windows in order. Windows of two texts are never neighbours: a text's last
    length - 1 words begin none. A repeat of more than a window is one whole stretch.
    """
    new = np.ones(len(hit), bool)
    new[1:] = hit[1:] != hit[:-1] + 1
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(hit)))
    return hit[first], runs + length - 1


def found_in(asked: np.ndarray, some: np.ndarray, known: np.ndarray, ids: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> tuple[Text, np.ndarray, np.ndarray]:
    """A piece of texts, and its maximal repeats."""
    text = Text(data, at, length, known & among(ids, some))
    hit = text.at[among(owned(text.windows(), text.documents(ids)), asked)] if len(asked) else text.at[:0]
    return text, *stretches(text, hit, length)


def spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for asked, some, rows in marked(batches):
        known, ids = known_rows(rows.column(4))
        for lo, hi, data, at in packed_pieces(rows.column(5)):
            text, first, size = found_in(asked, some, known[lo:hi], ids[lo:hi], data, at, length)
            if len(first):
                place = text.used[first]
                row = np.searchsorted(text.first, place, "right") - 1
                yield pa.record_batch([pa.array(ids[lo:hi][row]), pa.array(place - text.first[row]), pa.array(size)], names=["doc_id", "start", "n_words"])


def cut(batches: Iterator[pa.RecordBatch], length: int, layout: bool) -> Iterator[pa.RecordBatch]:
    """Every text without the words of its maximal repeats, a piece of a batch at a time."""
    for asked, some, rows in marked(batches):
        known, ids = known_rows(rows.column(4))
        for lo, hi, data, at in packed_pieces(rows.column(5)):
            text, first, size = found_in(asked, some, known[lo:hi], ids[lo:hi], data, at, length)
            step = np.zeros(len(text.used) + 1, np.int64)
            np.add.at(step, first, 1)
            np.add.at(step, first + size, -1)
            gone = np.zeros(len(text.starts), bool)
            gone[text.used] = np.cumsum(step)[:-1] > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            n_removed = sums[text.first[1:]] - sums[text.first[:-1]]
            kept = without(data, at, text, gone) if layout else spaced(data, text, gone)
            part = rows.slice(lo, hi - lo)
            others = [part.column(k) for k in range(6, part.num_columns)]
            yield pa.record_batch([part.column(4), pa.array(text.n_words), pa.array(n_removed), kept, *others], names=["doc_id", "n_words", "n_removed", "kept_text", *part.schema.names[6:]])


def strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def without(data: np.ndarray, at: np.ndarray, text: Text, gone: np.ndarray) -> pa.Array:
    """The texts as they are, but for the removed words, each with the spaces behind it."""
    upto = np.append(text.starts[1:], len(data))
    has = text.n_words > 0
    upto[text.first[1:][has] - 1] = at[1:][has]
    stays = np.ones(len(data), bool)
    stays[ranges(text.starts[gone], (upto - text.starts)[gone])] = False
    sums = np.concatenate([[0], np.cumsum(stays)])
    return strings(data[stays], sums[at])


def spaced(data: np.ndarray, text: Text, gone: np.ndarray) -> pa.Array:
    """The words that stay, one space between two."""
    stays = np.flatnonzero(~gone)
    first = np.searchsorted(stays, text.first)
    size = text.ends[stays] - text.starts[stays] + 1
    last = first[1:][np.diff(first) > 0] - 1
    size[last] -= 1
    ends = np.cumsum(size)
    out = np.append(data, np.uint8(32))[np.minimum(ranges(text.starts[stays], size), len(data))]
    inner = np.ones(len(stays), bool)
    inner[last] = False
    out[ends[inner] - 1] = 32
    return strings(out, np.concatenate([[0], ends])[first])


def matched(docs: DataFrame, length: int, carried: tuple[str, ...]) -> DataFrame:
    """Rows of `marked`: every bucket's texts behind the names of their windows that a document with a smaller id has."""
    spark = docs.sparkSession
    ship(spark)
    buckets = parts(spark)
    # A text without an id has no marks and may be anywhere.
    bucket = F.pmod(F.when(F.col("doc_id").isNull(), F.hash("text")).otherwise(F.hash("doc_id")), F.lit(buckets)).cast("int")
    none = F.lit(None).cast("binary")
    texts = docs.select(bucket.alias("bucket"), F.lit(TEXTS).alias("kind"), none.alias("names"), none.alias("docs"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carried)])

    def with_marks(marks: DataFrame, rows: DataFrame) -> DataFrame:
        packed_schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in rows.schema])
        rows = rows.mapInArrow(lambda it: compact(it, 5), packed_schema)
        empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[4:]]
        both = marks.select("bucket", F.lit(MARKS).alias("kind"), "names", "docs", *empty).union(rows)
        return by_bucket(both).sortWithinPartitions("bucket", "kind")

    sent = docs.select("doc_id", "text").mapInArrow(lambda it: seeded(it, length, buckets), SENT)
    seeds = by_bucket(sent).sortWithinPartitions("bucket").mapInArrow(lambda it: shared_seeds(it, buckets), SENT)
    grown = with_marks(seeds, texts.select("bucket", "kind", "names", "docs", "doc_id", "text")).mapInArrow(lambda it: extended(it, length, buckets), SENT)
    marks = by_bucket(grown).sortWithinPartitions("bucket").mapInArrow(lambda it: repeats(it, buckets), SENT)
    return with_marks(marks, texts)


def repeated_spans(docs: DataFrame, length: int = 13) -> DataFrame:
    """The maximal repeats of every document: doc_id, start (its first word, from 0), n_words, at least `length`.

    A repeat is a longest stretch of which every window of `length` words also starts in a document with a smaller id.
    See `remove_repeats` for the method and the defined results; a document without repeats has no row.
    """
    return matched(docs, length, ()).mapInArrow(lambda it: spans(it, length), "doc_id long, start long, n_words long")


def remove_repeats(docs: DataFrame, length: int = 13, layout: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """Texts without repeated passages: doc_id, n_words, n_removed, kept_text, then the carried columns as carried_0, ...

    A word goes if a window of `length` consecutive words covers it whose sequence also starts in a document with a
    smaller doc_id; windows are judged on the input. What stays is joined by one space, or with `layout` keeps its own
    spacing. Seeds: every window has an anchor, the least name of its short word runs, so that equal windows meet at
    equal anchors (winnowing), and documents are joined on anchors. At each place of a shared anchor the match is
    extended both ways, to every window that reaches it, and the extensions are joined by name; neighbouring windows
    that match make a maximal repeat, and those are cut. Both joins settle inside a batch of documents first, which then
    sends one document for each name, so a passage that very many documents share reaches a task at most once a batch,
    and no pairs are made. Documents are dealt by a hash of their id, and a task holds the marks of its documents and
    one batch of texts. Windows are told apart by 96 bits, those of a document by 64.

    Defined results: a null text is an empty one without words; a text of fewer words than `length` stays; a very long
    text is cut like any other; a null id is neither smaller nor larger than another and keeps its words; rows with one
    id don't take from each other; an empty table gives an empty one. Columns that are not carried are not read, and a
    carried one may have any name and type.
    """
    kept = "doc_id long, n_words long, n_removed long, kept_text string"
    out = T.StructType([*T.StructType.fromDDL(kept), *[T.StructField(f"carried_{i}", docs.schema[c].dataType) for i, c in enumerate(carried)]])
    return matched(docs, length, carried).mapInArrow(lambda it: cut(it, length, layout), out)
