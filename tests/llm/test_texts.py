"""Fingerprints, archives, separators, packing, the classifier and the pipeline."""

import functools
import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import classifier, separators, warc
from tessera.llm.fingerprints import compare_edits, fingerprint, likeness, sketches
from tessera.llm.packing import best_fit, pack, token_pieces
from tessera.llm.queries import tokenizer_path
from tessera.llm.tokens import encoder
from tests.llm import brute, conftest
from tests.llm.conftest import EDGES


def test_edits(docs):
    out = compare_edits(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in out} == brute.edits(rows)
    long = [r for r in out if r.n_chars > 300]
    assert np.median([r.near_edited for r in long]) > 0.4 and np.median([r.near_next for r in long]) < 0.05
    prints = {r.doc_id: r.fingerprint for r in fingerprint(docs).collect()}
    assert prints == {r.doc_id: r.fingerprint for r in out}


def test_edits_of_edges(edges, empty):
    out = compare_edits(edges).collect()
    assert len(out) == len(EDGES)
    prints = defaultdict(set)
    texts = {r.doc_id: r.text or "" for r in edges.collect()}
    for r in out:
        if r.doc_id is not None:
            prints[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert compare_edits(empty).count() == 0
    assert compare_edits(edges.where("doc_id is null")).count() == 2
    assert compare_edits(edges.where("doc_id = 10")).first().near_next == 1.0


def test_fingerprints_are_local():
    pick = random.Random(0)
    body = "".join(pick.choice("abcdefgh ") for _ in range(20_000))
    a, b, c = sketches(pa.array([body, "seven.." + body, "".join(pick.choice("abcdefgh ") for _ in range(20_000))]))
    assert likeness(a[None], b[None])[0] > 0.98 and likeness(a[None], c[None])[0] < 0.5
    assert likeness(*sketches(pa.array(["", None]))[:, None])[0] == 1
    texts = [body[k : k + n] for k, n in ((0, 1), (5, 2), (9, 3), (100, 40), (300, 500), (7, 9000))]
    alone = [sketches(pa.array([t]))[0].tolist() for t in texts]
    assert sketches(pa.array([*texts, *texts[::-1]])).tolist() == alone + alone[::-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "abc", "aaa", " ", "é", "xyz ", "0", "the "]), max_size=120).map("".join))
def test_fingerprints_equal_brute_force(text):
    from tessera.llm.fingerprints import BINS, LEVELS
    from tessera.llm.kernels import BASE

    assert sketches(pa.array(["some text before", text, "abc abc"]))[1].tolist() == brute.fingerprint(text, int(BASE), LEVELS, BINS)


def test_archive(spark, tmp_path):
    rows = [(1, "u1", "x" * 10), (2, "u2", "x" * 10), (3, None, "x" * 10), (4, "u 4\r\nX: y", None), (5, "u5", ""), (6, "u6", "ü€" * 9000), (None, "u7", "x" * 10), (9, "u9", "only"), (-1, "u10", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, bucket int").repartition(3)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archive(pages, folder, most=9000)
    out = {r.page_id: r for r in warc.read_archive(manifest, folder).collect()}
    want = brute.archive([(p, h) for p, _, h in rows if p is not None])
    assert {p: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for p, r in out.items() if p is not None} == want
    assert (out[None].record_type, out[None].refers_to) == ("revisit", 3)
    assert out[6].url == "u6" and out[3].url is None and out[4].url == "u 4 X: y"
    again = {r.file: r.sha1 for r in warc.write_archive(pages.repartition(2), f"file://{tmp_path}/v", most=9000).collect()}
    assert again == {r.file: r.sha1 for r in manifest.collect()} and len(again) > 0
    for r in manifest.collect():  # plain gzip members, one a record, of the size and digest that the manifest tells
        raw = (tmp_path / "w" / r.file).read_bytes()
        assert (len(raw), hashlib.sha1(raw).hexdigest()) == (r.bytes, r.sha1)
        assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type: ") == r.records + 1
    few = warc.write_archive(pages, f"file://{tmp_path}/x", least_revisit=11)
    assert {r.record_type for r in warc.read_archive(few, f"file://{tmp_path}/x").collect()} == {"response"}
    none = warc.write_archive(pages.limit(0), f"file://{tmp_path}/y")
    assert warc.read_archive(none, f"file://{tmp_path}/y").count() == 0
    assert sorted(p.name for p in (tmp_path / "y").iterdir()) == ["manifest.json"]


def test_archive_is_checked(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    manifest = warc.write_archive(pages, f"file://{tmp_path}/w")
    file = tmp_path / "w" / manifest.first().file
    file.write_bytes(file.read_bytes()[:-9])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archive(manifest, f"file://{tmp_path}/w").count()


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_separators(spark, tmp_path, block):
    files = {"a": [7, 9, 7, 7, 1, 2, 3, 4, 5, 7, 8], "b": [], "c": [1, 2, 3], "d": [7], "e": [1, 2, 3, 7]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    table = spark.createDataFrame([(k, len(v)) for k, v in files.items()] + [("a", 11)], "file string, n_tokens long")
    out = sorted(tuple(r) for r in separators.count_tokens(table, f"file://{tmp_path}", 7, block=block).collect())
    want = []
    for name, ids in files.items():
        ends = [i for i, x in enumerate(ids) if x == 7]
        starts = [0, *[e + 1 for e in ends]]
        want += [(name, k, s, e - s, True) for k, (s, e) in enumerate(zip(starts, ends))]
        if starts[-1] < len(ids):
            want.append((name, len(ends), starts[-1], len(ids) - starts[-1], False))
    assert out == sorted(want)


def test_separators_of_texts(edges, empty, tmp_path):
    files = separators.write_flat(edges, f"file://{tmp_path}/t", tokenizer_path(), 50256)
    out = separators.count_tokens(files, f"file://{tmp_path}/t", 50256, block=777).collect()
    code = encoder(tokenizer_path())
    assert sorted(r.n_tokens for r in out) == sorted(len(code.encode(t or "", added=False)) for _, t, _, _ in EDGES)
    assert separators.count_tokens(separators.write_flat(empty, f"file://{tmp_path}/u", tokenizer_path(), 50256), f"file://{tmp_path}/u", 50256).count() == 0


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoder_equals_tokenizers(text):
    tool = library()
    tool.encode_special_tokens = True
    assert encoder(tokenizer_path()).encode(text, added=False) == tool.encode(text, add_special_tokens=False).ids


SPECIAL = "<|endoftext|>"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([SPECIAL, SPECIAL[:-1], "<|", " ", "  ", "\n", "a", " b", "'s", "9", "é€😀"]), max_size=12).map("".join))
def test_encoder_finds_added_tokens(text):
    tool = library()
    tool.encode_special_tokens = False
    assert encoder(tokenizer_path()).encode(text) == tool.encode(text, add_special_tokens=False).ids


def test_pieces_and_flat_files_of_added_tokens(spark, tmp_path):
    """Packing gives the literal its id, as the library does by default; flat files keep it plain, so that it ends no document."""
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    texts = [f"a {SPECIAL} b", SPECIAL, f"x{SPECIAL}{SPECIAL}  y\n{SPECIAL}", f"w {SPECIAL} " * 9, "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert tool.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = set()
    for d, t in enumerate(texts):
        ids = [*tool.encode(t, add_special_tokens=False).ids, 0]
        lead = len(ids) % 5 or 5
        bounds = [0, *range(min(lead, len(ids)), len(ids) + 1, 5)]
        want |= {(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))}
    assert {tuple(r) for r in token_pieces(df, tokenizer_path(), most=5).collect()} == want
    files = separators.write_flat(df, f"file://{tmp_path}/t", tokenizer_path(), 50256)
    assert separators.count_tokens(files, f"file://{tmp_path}/t", 50256).count() == len(texts)


def gapless(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(docs):
    out = pack(token_pieces(docs.repartition(5), tokenizer_path())).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == brute.token_pieces([(r.doc_id, r.text) for r in docs.collect()], tokenizer_path(), 2048)
    least = -(-sum(r.length for r in out) // 2048)
    assert gapless(out, 2048) <= least + 2


def test_packing_edges(edges, empty, spark):
    out = pack(token_pieces(edges, tokenizer_path())).collect()
    assert gapless(out, 2048) and sum(1 for r in out if r.piece == 0) == len(EDGES)
    assert pack(token_pieces(empty, tokenizer_path())).count() == 0
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (60 + F.col("id") % 7).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32")).repartition(20)
    assert gapless(pack(rows, capacity=100, chunk=50).collect(), 100) == 3000  # none fits beside another


def test_packing_does_not_depend_on_the_tables_order(spark):
    """Long pieces first, then the short ones that fit beside them: as good as dealt at random, and near the least."""
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") < 10_000, 1100 + F.pmod(F.xxhash64("id"), F.lit(400))).otherwise(500 + F.pmod(F.xxhash64("id"), F.lit(400))).cast("long").alias("length"),
        F.lit(1).cast("long").alias("ids_crc32"), F.lit("x").alias("offset"),
    )
    n = gapless(pack(rows.repartitionByRange(8, "doc_id")).collect(), 2048)
    assert n <= 10_100
    assert gapless(pack(rows.repartition(8)).collect(), 2048) == n


def test_small_bins_find_their_hosts(spark):
    """A small piece a task and many bins with just enough room: none may be left alone."""
    rows = [(i, 0, 0, 1700, 1) for i in range(300)] + [(1000 + i, 0, 0, 340 - i, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert gapless(pack(df, chunk=16).collect(), 2048) == 300


@pytest.mark.parametrize("space", [" ", "\n", "\u3000"])
def test_long_white_space(spark, space, tmp_path):
    """Two megabytes of white space, on which the fast encoder gives up, have the library's ids."""
    from tokenizers import Tokenizer

    text = "a " + space * (2_000_000 // len(space.encode())) + " b" + SPECIAL
    df = spark.createDataFrame([(1, text), (2, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in token_pieces(df, tokenizer_path()).collect()} == brute.token_pieces([(1, text), (2, "c")], tokenizer_path(), 2048, special=False)
    files = separators.write_flat(df, f"file://{tmp_path}/t", tokenizer_path(), 50256)
    tool = Tokenizer.from_file(tokenizer_path())
    tool.encode_special_tokens = True
    assert sorted(r.n_tokens for r in separators.count_tokens(files, f"file://{tmp_path}/t", 50256).collect()) == [1, len(tool.encode(text, add_special_tokens=False).ids)]


def test_other_tokenizer_files_go_through_the_library():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    assert encoder(path).fast is None
    assert encoder(path).encode("Ein Text, zwei") == Tokenizer.from_file(path).encode("Ein Text, zwei", add_special_tokens=False).ids


def test_best_fit():
    sizes = np.random.default_rng(0).integers(1, 101, 500)
    bins, n = best_fit(sizes, 100)
    assert np.bincount(bins, sizes).max() <= 100 and n <= 1.02 * max((sizes > 50).sum(), sizes.sum() / 100) + 1


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    model = classifier.fit(docs, labels.where(~held), sample=4000)
    assert (np.diff(model.limits) > 0).all()
    rows = classifier.rate(docs, model).join(labels.where(held), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0 or r.toxic == 1]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.14
    assert all(0 <= r.grade <= 2 and r.kept == (r.tail >= 0.5) for r in rows)


def test_ordinal_equals_brute_force():
    """Likelihood and gradients against the definition and finite differences, and a fit that beats the best constant model."""
    rng = np.random.default_rng(4)
    rows = [rng.choice(6, rng.integers(1, 5), replace=False).tolist() for _ in range(40)]
    grades = np.array([min(2, sum(s in (0, 1) for s in r)) for r in rows])
    bounds, slots = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)
    weights = rng.normal(size=6)
    spread = np.array([-0.3, 0.4])
    limits = classifier.ordered(spread)
    full = np.zeros(classifier.SIZE)
    full[:6] = weights
    scores = classifier.Ordinal(full, limits).scores(slots, bounds)

    def loss(w, t):
        return brute.ordinal_loss(rows, grades.tolist(), dict(enumerate(w)), classifier.ordered(t).tolist())

    assert abs(-np.log(classifier.likelihood(scores, limits, grades)).mean() - loss(weights, spread)) < 1e-12
    by_score, by_spread = classifier.gradients(scores, spread, grades)
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        assert abs((loss(weights + step, spread) - loss(weights - step, spread)) / 2e-6 - sum(g for g, r in zip(by_score, rows) if k in r)) < 1e-6
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        assert abs((loss(weights, spread + step) - loss(weights, spread - step)) / 2e-6 - by_spread[k]) < 1e-6
    model = classifier.fit_ordinal(slots, bounds, grades, 3, steps=300, decay=0.0)
    shares = np.bincount(grades, minlength=3) / len(grades)
    constant = -(shares[shares > 0] * np.log(shares[shares > 0])).sum()
    fitted = brute.ordinal_loss(rows, grades.tolist(), dict(enumerate(model.weights[:6])), model.limits.tolist())
    assert fitted < 0.5 * constant and (np.diff(model.limits) > 0).all()
    tails = model.tails(model.scores(slots, bounds))
    assert np.allclose(tails.sum(1), [sum(1 / (1 + np.exp(-(sum(model.weights[s] for s in r) - t))) for t in model.limits) for r in rows])


def test_classifier_edges(edges, empty, spark):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (14, 0, 0), (None, 1, 1), (1, None, 0), (99, 1, 0), (10, 1, 0), (11, 1, 1)], "doc_id long, quality long, toxic long")
    model = classifier.fit(edges, labels)
    assert classifier.rate(edges, model).count() == len(EDGES)
    assert classifier.select_good(edges, model).columns == edges.columns
    assert classifier.rate(empty, model).count() == classifier.select_good(empty, model).count() == 0
    assert len(classifier.fit(edges, labels.limit(0)).limits) == 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(C.STAGES[:-1]):
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in before.collect()]
        got = {r.doc_id: r.text for r in after.collect()}
        if k == 1:
            want = brute.near_duplicates(rows, 5, 80)
            assert set(got) == {d for d, (_, root) in want.items() if d == root} and after.count() == len(got)
        if k == 2:
            want = {d: t for d, (n, gone, t) in brute.remove_repeats(rows, C.PASSAGE).items() if gone < n or not gone}
            assert {d: " ".join(brute.WORD.findall(t)) for d, t in got.items()} == want
        if k == 3:
            total = sum(len(brute.WORD.findall(t or "")) for _, t in rows)
            mixed = sum(len(brute.WORD.findall(r.text)) for r in after.collect())
            assert 0 <= 1.5 * total - mixed <= before.select("source").distinct().count()
        before = after
    out = C.STAGES[-1][1](spark, before, sf).collect()
    assert gapless(out, 2048) <= -(-sum(r.length for r in out) // 2048) + 2
    assert C.run(spark, sf).count() == len(out)


def test_pipeline_edges(spark, edges, empty, tmp_path):
    import corpus_pipeline as C

    labels = spark.createDataFrame([(7, 1, 0), (14, 0, 0)], "doc_id long, quality long, toxic long")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(C.STAGES):
        assert stage(spark, edges, str(tmp_path)).count() > (0 if k else -1)  # two labels teach the classifier nothing
        assert stage(spark, empty, str(tmp_path)).count() == 0
    kept = [r.doc_id for r in C.near_dup_stage(spark, edges, "").collect()]
    assert kept.count(7) == 1 and 8 not in kept and kept.count(None) == 2


def test_stages_with_clashing_columns_and_shared_ids(spark, tmp_path):
    """Columns named like the stages' own, a map, and ids that several rows share or lack: no text is lost to another's."""
    import corpus_pipeline as C

    a, b, c = (conftest.words(80, k) for k in (21, 22, 23))
    rows = [(1, a), (1, b), (1, a), (2, c), (3, b), (None, c), (None, conftest.words(80, 24)), (None, None), (None, None), (4, ""), (5, a + " tail")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "r", 2, "n", {"k": 1}, 3, 4) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _rows int, row string, own int, given string, names map<string,int>, carried_0 int, nth int")
    out = C.near_dup_stage(spark, df, "")
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (2, c), (None, rows[6][1]), (None, None), (4, "")], key=str)
    for stage in (C.passage_stage, C.mixing_stage):
        after = stage(spark, df, "")
        assert after.columns == df.columns and after.count() >= 0
    assert C.packing_stage(spark, df, "").count() == len(rows)


def test_pipeline_leaves_no_stage_behind(spark):
    import corpus_pipeline as C
    from tessera.llm.frames import shared_dir
    from pyarrow import fs

    C.run(spark, "/root/testdata/sf0.001").count()
    files, path = fs.FileSystem.from_uri(shared_dir(spark))
    assert not [x.path for x in files.get_file_info(fs.FileSelector(path)) if "pipeline-" in x.path]
