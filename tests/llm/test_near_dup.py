import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.near_dup import near_duplicates
from tests.llm import brute


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


@pytest.mark.parametrize("width", [2, 5])
def test_brute_force(docs, width):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(near_duplicates(docs, width)) == brute.near_duplicates(rows, width, 80)


@pytest.mark.parametrize("width", [2, 5])
def test_edges(edges, known, width):
    out = near_duplicates(edges, width).collect()
    assert len(out) == edges.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == brute.near_duplicates(known, width, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)


def test_empty(empty):
    assert near_duplicates(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert near_duplicates(empty).count() == 0


def test_chains_and_boilerplate(spark):
    """Texts that drift from one to the next are one class, though far ones are not alike; texts that share a part are none."""
    base = [f"w{i}" for i in range(100)]
    chain = [(i, " ".join(base[4 * i :] + [f"n{j}" for j in range(4 * i)])) for i in range(12)]
    shared = " ".join(f"s{i}" for i in range(9))
    others = [(100 + i, shared + " " + " ".join(f"u{i}_{j}" for j in range(3 + i % 9))) for i in range(150)]
    rows = chain + others
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(near_duplicates(df, 2)) == brute.near_duplicates(rows, 2, 80)


def test_small_cells(docs, monkeypatch):
    """Buckets of more loners and members than a cell takes."""
    from tessera.llm import near_dup

    for name, most in (("BLOCK", 3), ("STRIP", 4), ("STEP", 2), ("ROWS", 5)):
        monkeypatch.setattr(near_dup, name, most)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(near_duplicates(docs, 2)) == brute.near_duplicates(rows, 2, 80)


def test_loners_of_one_bucket(spark):
    """A family whose members are alike to some of the others only: what the stars leave over is found in cells."""
    pick = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        text = list(base)
        for k in range(pick.randint(4, 14)):
            text[pick.randrange(120)] = f"n{i}_{k}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute.near_duplicates(rows, 1, 80)
    assert 1 < len({root for _, root in want.values()}) < 200
    assert found(near_duplicates(df, 1)) == want


def test_components(spark):
    links = [(i + 1, i) for i in range(60)] + [(200, 100), (200, 150), (7, 7)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, c long")).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, c long")).count() == 0


def test_thousand_copies_make_few_candidates(spark):
    from tessera.llm.kernels import find_words  # noqa: F401  the kernels are importable alone

    text = " ".join(f"w{i}" for i in range(40))
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    out = near_duplicates(df, 2)
    assert out.where("kept").count() == 1 and out.where("component_id = 0").count() == 1000


def test_copies_in_two_batches_keep_a_bucket_whole(spark):
    """Two like texts in two batches that meet only in buckets whose centres are copies in both."""
    both = [f"s{i}" for i in range(80)]
    copied = [" ".join([*both, *[f"x{j}_{i}" for i in range(12)]]) for j in range(40)]
    rows = []
    for k in range(2):
        rows += [(100 * k + j, t) for j, t in enumerate(copied)] + [(1000 + k, " ".join([*both, *[f"u{k}_{i}" for i in range(9)]]))]
    want = brute.near_duplicates(rows, 1, 80)
    assert want[1001] == (89, 1000) and want[1000] == (89, 1000) and want[139] == (92, 39)
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert found(near_duplicates(df, 1)) == want


@pytest.mark.parametrize("percent", [50, 60])
def test_pairs_at_a_lower_threshold(spark, percent):
    """Pairs at the threshold itself, which sketches for 80 % would often miss."""
    rows = []
    for k in range(40):
        both = [f"s{k}_{i}" for i in range(2 * percent)]
        rows += [(2 * k + j, " ".join([*both, *[f"u{k}_{j}_{i}" for i in range(100 - percent)]])) for j in range(2)]
    want = brute.near_duplicates(rows, 1, percent)
    assert len({root for _, root in want.values()}) == 40
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent)) == want


def test_bands():
    from tessera.llm.near_dup import BINS, MISSED, bands_for

    assert bands_for(80) == bands_for(100) == 64
    assert all((1 - (p / 100) ** (BINS // bands_for(p))) ** bands_for(p) <= MISSED for p in range(3, 101))
    with pytest.raises(ValueError, match="too unlike"):
        bands_for(2)
