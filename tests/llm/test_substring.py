import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.substring import doc_bucket, remove_repeats, repeated_spans
from tests.llm import brute


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in df.collect() if r.doc_id is not None}


@pytest.mark.parametrize("length", [13, 50, 4])
def test_brute_force(docs, length):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(remove_repeats(docs, length)) == brute.remove_repeats(rows, length)


@pytest.mark.parametrize("length", [13, 50])
def test_edges(edges, known, length):
    out = remove_repeats(edges, length)
    assert out.count() == edges.count()
    assert found(out) == brute.remove_repeats(known, length)
    assert all(r.n_removed == 0 for r in out.collect() if r.doc_id is None)


def test_layout_and_carried(edges):
    out = {r.doc_id: r for r in remove_repeats(edges, 50, layout=True, carried=("bucket", "size", "n_chars")).collect()}
    whole = {r.doc_id: r.text for r in edges.collect()}
    assert out[7].kept_text == whole[7] and out[10].kept_text == whole[10]
    assert out[12].kept_text.endswith(whole[12][whole[12].index("ü€😀") :]) and out[12].n_removed == 70
    assert (out[12].carried_0, out[12].carried_1) == ("x", "s")


def test_empty(empty):
    assert remove_repeats(empty).count() == 0


def test_common_passage(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert found(remove_repeats(df, 13)) == brute.remove_repeats(rows, 13)


def test_buckets_are_sparks_hash(spark):
    ids = [0, 1, -1, 42, 2**62, -(2**63), 123456789012]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.pmod(F.hash("doc_id"), F.lit(7)).alias("b")).collect()
    assert [r.b for r in rows] == doc_bucket(np.array(ids), 7).tolist()


def test_thin_ids_and_packed_texts():
    import pyarrow as pa

    from tessera.llm import substring

    for ids in ([], [7], [-5, 2**31, 9], [0, 2**32], [-(2**63), 2**63 - 1], [2**62, 2**62 + 5]):
        assert substring.thick(substring.thin(np.array(ids, np.int64))).tolist() == ids
    texts = ["x" * (i % 13) + "é" * (i % 5) for i in range(60)] + [None, "", "a b " * 5000]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["n", "text"])
    (out,) = substring.compact(iter([batch]), 1)
    got = []
    for lo, hi, data, at in substring.packed_pieces(out.column(1), most=40):
        assert hi - lo == 1 or at[-1] <= 40
        got += [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])]
    assert got == [t or "" for t in texts] and out.column(0).to_pylist() == list(range(len(texts)))


def test_ids_in_steps_of_the_bucket_count(spark):
    """Ids that are all equal modulo the number of buckets, in small batches and with many rows without an id."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(8 * i, f"a{i} {passage if i % 2 else ''} b{i}") for i in range(200)]
    assert len(set(doc_bucket(np.array([d for d, _ in rows]), 8).tolist())) == 8
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows + [(None, passage)] * 100, "doc_id long, text string").repartition(3)
        out = remove_repeats(df, 13)
        assert found(out) == brute.remove_repeats(rows, 13) and out.where("doc_id is null and n_removed = 0").count() == 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spans_are_maximal(edges, known):
    """Spans cover what is removed, and no span can be made longer."""
    gone = {}
    for r in repeated_spans(edges, 13).collect():
        assert r.n_words >= 13
        gone.setdefault(r.doc_id, []).append((r.start, r.start + r.n_words))
    want = {d: (n, m) for d, (n, m, _) in brute.remove_repeats(known, 13).items() if m}
    assert {d: len({i for a, b in v for i in range(a, b)}) for d, v in gone.items()} == {d: m for d, (_, m) in want.items()}
    assert gone[12] == [(10, 80)] or gone[11] == [(40, 110)]
