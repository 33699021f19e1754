"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship

from .components import components
from .frames import by_bucket, parts, settle
from .kernels import BASE, LOWER, U, find_words, groups_of, mix, name_words, packed, pieces, windows

#: Bins of a sketch, and the largest chance that a pair at the threshold misses all bands. At 80 % eight rows a band keep it: a pair at 40 % meets in one of 4 %.
BINS, MISSED = 512, 8e-6
TRIES = 4096
COPY, CANDIDATE, SIZE = 0, 1, 2
#: Loners that a cell holds, members that pass it, and rows of either that are compared at a time.
BLOCK, STRIP, STEP = 512, 768, 512
#: Texts that are sketched at a time, and their bytes: so many signatures are in memory at most.
ROWS, BYTES = 512, 1 << 19


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle names of every text, in ascending order, and where each text's begin (with the end as the last)."""
    starts, ends, first = find_words(data, at)
    names = name_words(LOWER[data], starts, ends)
    every, counts = windows(names, first, width)
    every = mix(every)
    n_words = np.diff(first)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):  # the whole sequence is one shingle
        whole = {int(i): mix(np.array([hash_run(names[first[i] : first[i + 1]])], U))[0] for i in short}
        counts[short] = 1
        out = np.empty(counts.sum(), U)
        begin = np.cumsum(counts) - counts
        mask = np.ones(len(out), bool)
        mask[begin[short]] = False
        out[mask] = every
        out[begin[short]] = [whole[int(i)] for i in short]
        every = out
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        every[lo:hi].sort()
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    new[bounds[:-1][bounds[:-1] < len(every)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return every[new], kept[bounds]


def hash_run(names: np.ndarray) -> int:
    h = 0x5851F42D4C957F2D + len(names)
    for x in names.tolist():
        h = (h * int(BASE) + x) % (1 << 64)
    return h


def probes() -> np.ndarray:
    """For every bin the bins to borrow from, in order: the universal hashes of optimal densification."""
    t, i = np.meshgrid(np.arange(TRIES, dtype=U), np.arange(BINS, dtype=U))
    return (mix((i << U(32)) + t + U(77)) % U(BINS)).astype(np.int64)


def signatures(names: np.ndarray, bounds: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """One-permutation sketches: the least name in each of BINS bins of the hash space, empty bins densified."""
    n = len(bounds) - 1
    counts = np.diff(bounds)
    row = np.repeat(np.arange(n), counts)
    slot = row * BINS + ((names >> U(32)) * U(BINS) >> U(32)).astype(np.int64)  # in order of the names
    lead = np.ones(len(names), bool)
    lead[1:] = slot[1:] != slot[:-1]
    sig, has = np.zeros(n * BINS, U), np.zeros(n * BINS, bool)
    sig[slot[lead]] = names[lead]
    has[slot[lead]] = True
    have = has.copy()
    empty = np.flatnonzero(~has & np.repeat(counts > 0, BINS))
    for t in range(TRIES):
        if not len(empty):
            break
        source = empty // BINS * BINS + probe[empty % BINS, t]
        hit = have[source]
        sig[empty[hit]] = sig[source[hit]]
        empty = empty[~hit]
    for e in empty.tolist():  # as good as never
        base = e // BINS * BINS
        sig[e] = sig[base + np.flatnonzero(have[base : base + BINS])[0]]
    return sig.reshape(n, BINS)


def bands_for(percent: int) -> int:
    """The fewest bands, of at most eight rows, with which a pair at `percent` misses all with a chance of MISSED at most."""
    for rows in (8, 4, 2, 1):
        if (1 - (percent / 100) ** rows) ** (BINS // rows) <= MISSED:
            return BINS // rows
    raise ValueError(f"pairs at {percent} % are too unlike to be found by sketches of {BINS} bins")


def band_names(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(len(sig), bands, BINS // bands)
    h = np.broadcast_to(mix(np.arange(bands, dtype=U) + U(1)), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        h = mix(h * BASE + rows[:, :, k])
    return h


def stars(key: np.ndarray, doc: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of (key, doc), and for each the position of its key's first row: the star's centre."""
    order = np.lexsort((more, doc, key))
    k = key[order]
    lead = np.ones(len(k), bool)
    lead[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(lead)
    return order, np.repeat(at, np.diff(np.append(at, len(k))))


def edges_of(kind: int, key: np.ndarray, doc: np.ndarray, more: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Star edges (kind, key, member, centre) of the groups of equal keys, and the rows that are centres.

    COPY groups are those of one whole digest, key and more. Among candidates, rows with the centre's or an earlier
    member's digest are copies, which COPY edges link: they get no edge.
    """
    if not len(key):
        return [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)], np.zeros(0, np.int64)
    if kind == COPY:
        same = np.lexsort((doc, more, key))
        k, m = key[same], more[same]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        at = np.flatnonzero(new)
        centre = np.repeat(at, np.diff(np.append(at, len(k))))
        order = same
    else:
        same = np.lexsort((doc, more, key))
        k, m = key[same], more[same]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        firsts = same[new]
        order, centre = stars(key[firsts], doc[firsts], more[firsts])
        order = firsts[order]
    d = doc[order]
    c = d[centre]
    far = d != c
    lead = centre == np.arange(len(centre))
    found = [np.full(far.sum(), kind, np.int32), key[order][far].view(np.int64), d[far], c[far]]
    return found, order[lead]


def sketched(batches: Iterator[pa.RecordBatch], width: int, buckets: int, n_bands: int) -> Iterator[pa.RecordBatch]:
    """Of every batch of documents: star edges inside it, its centres' keys dealt by bucket, and set sizes."""
    probe = probes()
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        known = np.asarray(batch.column(0).is_valid())
        ids = np.where(known, ids, 0).astype(np.int64)
        sizes = np.zeros(len(ids), np.int64)
        keys: dict[int, list] = {COPY: [], CANDIDATE: []}
        for lo, hi, data, at in pieces(batch.column(1), BYTES, ROWS):
            names, bounds = shingle_sets(data, at, width)
            n = np.diff(bounds)
            sizes[lo:hi] = n
            use = np.flatnonzero((n > 0) & known[lo:hi])
            if not len(use):
                continue
            total = np.concatenate([[U(0)], np.cumsum(mix(names))])
            d1 = mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(U))
            total = np.concatenate([[U(0)], np.cumsum(mix(names ^ BASE))])
            d2 = total[bounds[1:]] - total[bounds[:-1]]
            keys[COPY].append((d1[use], ids[lo:hi][use], d2[use]))
            bands = band_names(signatures(names, bounds, probe), n_bands)[use]
            keys[CANDIDATE].append((bands.ravel(), np.repeat(ids[lo:hi][use], n_bands), np.repeat(d1[use], n_bands)))
        kinds, rows = [], []
        found = [[np.full(len(ids), SIZE, np.int32), known.astype(np.int64), ids, sizes]]
        for kind, got in keys.items():
            if got:
                key, doc, more = (np.concatenate(x) for x in zip(*got, strict=True))
                edges, centres = edges_of(kind, key, doc, more)
                found.append(edges)
                for b, blobs in packed(key[centres], (key[centres] >> U(20)).astype(np.int64) % buckets, buckets, doc[centres], more[centres]):
                    kinds.append(kind)
                    rows.append((b, *blobs))
        out = [np.concatenate(x) for x in zip(*found, strict=True)]
        made, *columns = [x.tobytes() for x in out]
        rows = [(kind, *r, None) for kind, r in zip(kinds, rows, strict=True)]
        rows.append((-1, int(ids[0] % buckets) if len(ids) else 0, *columns, made))
        kind_, bucket, key, doc, more, made_ = zip(*rows, strict=True)
        blobs = [pa.array(x, pa.binary()) for x in (key, doc, more, made_)]
        yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array(kind_, pa.int32()), *blobs], names=["bucket", "kind", "key", "doc", "more", "made"])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges among the centres that the batches sent, bucket by bucket, and the rows that were made before."""
    for table in groups_of(batches):
        kind = table.column("kind").to_numpy()
        columns = {c: table.column(c).to_pylist() for c in ("key", "doc", "more", "made")}
        for i in np.flatnonzero(kind == -1):
            yield edge_batch([np.frombuffer(columns["made"][i], np.int32), *[np.frombuffer(columns[c][i], np.int64) for c in ("key", "doc", "more")]])
        for k in (COPY, CANDIDATE):
            at = np.flatnonzero(kind == k)
            if len(at):
                key, more = (np.frombuffer(b"".join([columns[c][i] for i in at]), U) for c in ("key", "more"))
                doc = np.frombuffer(b"".join([columns["doc"][i] for i in at]), np.int64)
                yield edge_batch(edges_of(k, key, doc, more)[0])


def edge_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in columns], names=["kind", "key", "a", "c"])


def set_rows(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in pieces(batch.column(1)):
            names, bounds = shingle_sets(data, at, width)
            sets = pa.array([names[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), sets], names=["id", "names"])


def confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are alike; rows come as (a, c, names of a, names of c), in order of c."""
    last, centre = None, None
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = x.as_buffer(), y.as_buffer()
            if last is None or not last.equals(y):
                last, centre = y, np.frombuffer(y, U)
            one = np.frombuffer(x, U)
            small, large = sorted((len(one), len(centre)))
            if 100 * small < percent * large:
                continue
            at = np.minimum(np.searchsorted(centre, one), len(centre) - 1)
            both = int((centre[at] == one).sum())
            keep[i] = 100 * both >= percent * (len(one) + len(centre) - both)
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "c"]).filter(pa.array(keep))


def sets_of(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The shingle names of the wanted documents: id, names; a row for each of their texts."""
    return texts.join(wanted, "doc_id", "left_semi").mapInArrow(lambda it: set_rows(it, width), "id long, names binary")


def names_of(sets: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U) for x in sets]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], slab: int = 2048) -> np.ndarray:
    """The intersection sizes of every set of `left` with every one of `right`: products of 0/1 matrices over common names."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    common = np.intersect1d(sides[0][0], sides[1][0])
    both = np.zeros((len(left), len(right)), np.float32)
    found = []
    for names, rows in sides:
        at = np.minimum(np.searchsorted(common, names), max(0, len(common) - 1))
        hit = common[at] == names if len(common) else np.zeros(len(names), bool)
        order = np.argsort(at[hit], kind="stable")
        found.append((rows[hit][order], at[hit][order]))
    for lo in range(0, len(common), slab):
        n = min(slab, len(common) - lo)
        blocks = []
        for (rows, at), sets in zip(found, (left, right), strict=True):
            some = slice(*np.searchsorted(at, [lo, lo + n]))
            block = np.zeros((len(sets), n), np.float32)
            block[rows[some], at[some] - lo] = 1
            blocks.append(block)
        both += blocks[0] @ blocks[1].T
    return both


def linked_in(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between different classes in each cell: rows are (cell, side, inner, id, class, names) in order of cell and side.

    The rows of side 0 are held; they are compared with one another if the cell is `inner`, and with the rows of side 1
    as those pass. Of several links between two classes one is kept a step.
    """

    def links(a: tuple, c: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        sizes = [np.array([len(x) for x in rows[2]]) for rows in (a, c)]
        both = shared_counts(a[2], c[2])
        alike = (100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)) & (a[1][:, None] != c[1][None, :])
        x, y = np.nonzero(np.triu(alike, 1) if same else alike)
        if len(x):
            _, first = np.unique(np.stack([a[1][x], c[1][y]]), axis=1, return_index=True)
            x, y = x[first], y[first]
            yield pa.record_batch([pa.array(a[0][x]), pa.array(c[0][y])], names=["a", "c"])

    now, held = None, None
    for batch in batches:
        cells, sides, inner, ids, classes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        sets = names_of(batch.column(5))
        size = np.cumsum([len(x) for x in sets])
        lo = 0
        while lo < len(cells):
            # Up to STEP rows of one cell and side, fewer if they are long.
            hi = lo + 1
            while hi < len(cells) and hi - lo < STEP and cells[hi] == cells[lo] and sides[hi] == sides[lo] and size[hi] - size[lo] < STEP * 512:
                hi += 1
            rows = (ids[lo:hi], classes[lo:hi], sets[lo:hi])
            if cells[lo] != now:
                now, held = cells[lo], []
            for before in held:
                if sides[lo] == 1 or inner[lo]:
                    yield from links(before, rows, False)
            if sides[lo] == 0:
                if inner[lo]:
                    yield from links(rows, rows, True)
                held.append(rows)
            lo = hi


def left_over(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links between different classes inside each bucket (members: key, id): a, c.

    The members of a bucket's largest class are linked already, so a link that is still to be found has one end at
    least among the others, the loners. These are cut into blocks, the bucket into strips, and a cell holds a block and
    lets a strip pass: a member is sent once for each block of loners, a loner once for each strip, no pair becomes a
    row, and cells have a bounded number of rows and bytes whatever the bucket's size. Only buckets of several classes
    are compared.
    """
    bytes_ = sets.groupBy("id").agg(F.sum(F.octet_length("names")).alias("bytes"))
    known = bytes_.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", "bytes", F.coalesce("root", "id").alias("class_id"))
    held = settle(members.join(known, "id"))
    by_class = held.groupBy("key", "class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    largest = F.max_by(F.struct("class_id", "n", "bytes"), F.struct("n", F.col("class_id")))
    mixed = by_class.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), largest.alias("main")).where("classes > 1")
    blocks = F.greatest(F.ceil((F.col("n") - F.col("main.n")) / BLOCK), F.ceil((F.col("bytes") - F.col("main.bytes")) / (BLOCK * 4096)))
    strips = F.greatest(F.ceil(F.col("n") / STRIP), F.ceil(F.col("bytes") / (STRIP * 4096)))
    mixed = mixed.select("key", F.col("main.class_id").alias("main"), blocks.alias("blocks"), strips.alias("strips"))
    rows = held.select("key", "id", "class_id").join(mixed.hint("merge"), "key")  # a merge join, in which hot keys are split
    rows = rows.withColumn("own", F.when(F.col("class_id") != F.col("main"), F.pmod(F.xxhash64("id"), F.col("blocks"))))
    zero = F.lit(0).cast("long")
    # A loner is held in its own block, in all strips, and passes the blocks before that; the others pass all blocks.
    stays = F.when(F.col("own").isNotNull(), F.transform(F.sequence(zero, F.col("strips") - 1), lambda s: F.struct(F.col("own").alias("block"), s.alias("strip"), F.lit(0).alias("side"))))
    upto = F.coalesce(F.col("own"), F.col("blocks"))
    strip = F.pmod(F.xxhash64("id", F.lit(1)), F.col("strips"))
    passes = F.when(upto > 0, F.transform(F.sequence(zero, upto - 1), lambda b: F.struct(b.alias("block"), strip.alias("strip"), F.lit(1).alias("side"))))
    empty = F.array().cast("array<struct<block:bigint,strip:bigint,side:int>>")
    rows = rows.select("key", "id", "class_id", F.explode(F.concat(F.coalesce(stays, empty), F.coalesce(passes, empty))).alias("at"))
    cell = F.xxhash64("key", "at.block", "at.strip")
    rows = rows.select(cell.alias("cell"), "at.side", (F.col("at.strip") == 0).alias("inner"), "id", "class_id")
    dealt = rows.join(sets, "id").select("cell", "side", "inner", "id", "class_id", "names").repartition(parts(sets.sparkSession), "cell").sortWithinPartitions("cell", "side")
    return dealt.mapInArrow(lambda it: linked_in(it, percent), "a long, c long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents whose sets of `width`-word shingles are alike: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B|; a class is what links reach. Words are lower-cased
    in A-Z only. Each text's one-permutation sketch gives a bucket key a band, 64 at 80 % and more below. In every bucket
    all members are compared with its smallest document only: first inside each batch of documents, then among the
    batches' centres, so that a bucket of any size makes one edge a member and no task holds it whole. Copies (equal
    sets) are linked by digest and are no candidates. Candidates are confirmed on full sets. In buckets whose members are
    still of several classes, those outside the largest class are compared with all members, in cells of bounded size:
    no pair of a bucket is lost. A pair at `percent` misses all buckets with a chance of at most MISSED; under 3 %, where
    one row a band does not keep that, the call is refused.

    Defined results: a null, empty or wordless text has an empty set and is in a class of its own; fewer words than
    `width` make one shingle, the whole sequence; a very long text is one document with all its shingles, sketched alone;
    rows with one id are one member of their class, with any row's links; equal sets are one class, under the smallest
    id; a null id has a null class and is kept; an empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets, bands = parts(spark), bands_for(percent)
    texts = docs.select("doc_id", "text")
    sent = texts.mapInArrow(lambda it: sketched(it, width, buckets, bands), "bucket int, kind int, key binary, doc binary, more binary, made binary")
    found = settle(by_bucket(sent).sortWithinPartitions("bucket").mapInArrow(linked, "kind int, key long, a long, c long"))
    member = found.where(F.col("kind") == CANDIDATE)
    ends = F.explode(F.array("a", "c")).alias("id")
    wanted = member.select(ends.alias("doc_id")).distinct()
    sets = settle(sets_of(texts, wanted, width))
    left = member.select("a", "c").distinct().join(sets.select(F.col("id").alias("a"), F.col("names").alias("names_a")), "a")
    both = left.join(sets.select(F.col("id").alias("c"), F.col("names").alias("names_c")), "c").select("a", "c", "names_a", "names_c")
    alike = both.mapInArrow(lambda it: confirmed(it, percent), "a long, c long")
    roots = components(found.where(F.col("kind") == COPY).select("a", "c").union(alike))
    more = settle(left_over(member.select("key", ends).distinct(), sets, roots, percent))
    if not more.isEmpty():  # links between classes, so what they join is found among the classes' roots alone
        between = classed(classed(more, roots, "a"), roots, "c").select(F.col("class_a").alias("a"), F.col("class_c").alias("c"))
        upper = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
        alone = upper.select(F.col("root").alias("node"), F.col("top").alias("root"))  # roots themselves, with links or without
        roots = roots.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(alone)
    sizes = found.where(F.col("kind") == SIZE).select(F.when(F.col("key") == 1, F.col("a")).alias("doc_id"), F.col("c").alias("n_shingles"))
    out = sizes.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def classed(rows: DataFrame, roots: DataFrame, col: str) -> DataFrame:
    """Rows with the class of the document in `col`: class_<col>, the document itself where it has no links."""
    known = roots.select(F.col("node").alias(col), F.col("root").alias(f"root_{col}"))
    return rows.join(known, col, "left").withColumn(f"class_{col}", F.coalesce(f"root_{col}", col)).drop(f"root_{col}")
