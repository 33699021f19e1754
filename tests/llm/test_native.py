"""Quality rules, mixing and sharding: no Python on the executors."""

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm.frames import id_ranges, range_of, word_count
from tessera.llm.mixing import mix
from tessera.llm.oracles import MIXING, QUALITY, SHARDING
from tessera.llm.quality_rules import judge
from tessera.llm.sharding import interleave
from tests.llm import brute


def sql(df, text):
    documents = df.select("doc_id", "text", "lang", "source", "n_chars").toArrow()
    con = duckdb.connect()
    con.register("documents", documents)
    found = con.sql(text)
    return found.columns, found.fetchall()


def same(ours, columns, theirs):
    order = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r[c] for c in columns) for r in ours), key=order) == sorted(map(tuple, theirs), key=order)


def test_measures(edges):
    out = judge(edges).collect()
    assert len(out) == edges.count()
    texts = {r.doc_id: r.text for r in edges.collect()}
    for r in out:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_measures(texts[r.doc_id])
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("name", ["edges", "docs"])
def test_quality_equals_sql(name, request):
    df = request.getfixturevalue(name).dropDuplicates(["doc_id"])  # the SQL tells texts by id
    out = judge(df).withColumns({c: F.round(c, 6) for c in ("class_js", "word_js")})
    assert same(out.collect(), *sql(df, QUALITY))


def test_a_verdict_follows_from_the_document_alone(docs):
    whole = {r.doc_id: r for r in judge(docs).collect()}
    few = docs.where("doc_id % 7 = 3")
    assert all(whole[r.doc_id] == r for r in judge(few).collect())


def test_quality_by_language(spark):
    text = " ".join("слово" + chr(0x430 + i % 32) + chr(0x430 + i // 32) for i in range(200))
    rows = [(1, text, "ru"), (2, text, None), (3, text, "en"), (4, "#### $$$$ %%%% " * 40 + " ".join(str(i) for i in range(400)), "xx")]
    out = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[1].kept and out[2].kept and out[1].word_js is None
    assert not out[3].kept and out[3].word_js > 0.3 and not out[4].kept


def test_quality_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = judge(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0))


@pytest.mark.parametrize("name", ["edges", "docs"])
def test_mixing(name, request):
    df = request.getfixturevalue(name)
    out = mix(df, word_count(F.col("text"))).collect()
    assert len(out) == df.count()
    assert same(out, *sql(df, MIXING))
    goal, got = {}, Counter()
    for r in out:
        goal[r.source] = r.target
        got[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(got[s] == int(goal[s]) for s in goal)


@pytest.mark.parametrize("name", ["edges", "docs"])
def test_sharding(name, request):
    df = request.getfixturevalue(name)
    text = F.coalesce("text", F.lit(""))
    out = interleave(df, {"size": (F.octet_length(text) + 1).cast("long"), "crc": F.crc32(text.cast("binary"))}, 16).collect()
    assert len(out) == df.count()
    columns, rows = sql(df, SHARDING)
    ours = [{"doc_id": r.doc_id, "size": r["size"], "text_crc32": r.crc, "law": "rows", "shard": r.shard, "slot": r.slot, "grown_shard": None} for r in out]
    assert same(ours, columns, rows)
    counts, slots, mixed = Counter(r.shard for r in out), defaultdict(set), defaultdict(Counter)
    for r in out:
        slots[r.shard].add(r.slot)
        mixed[r.source][r.shard] += 1
    assert max(counts.values()) - min(counts.get(i, 0) for i in range(16)) <= 1
    assert all(slots[s] == set(range(counts[s])) for s in counts)
    assert all(max(c.values()) - min(c.get(i, 0) for i in range(16)) <= 2 for c in mixed.values())
    crcs = {r.doc_id: zlib.crc32((r.text or "").encode()) for r in df.collect() if r.doc_id not in (None, 8)}
    assert all(r.crc == crcs[r.doc_id] for r in out if r.doc_id in crcs)


def test_many_small_sources(spark):
    """Thousands of sources of one row, whose fractions all tie, and a third of the rows without an id."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") < 5000, F.col("id")).otherwise(0)).alias("source"), F.lit("a b").alias("text"), F.lit(1).alias("size"))
    out = interleave(rows, {"size": F.length("text").cast("long")}, 16).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == 6000 and set(counts.values()) == {375} and sorted((r.shard, r.slot) for r in out) == [(k, i) for k in range(16) for i in range(375)]
    mixed = mix(rows, word_count(F.col("text"))).collect()
    assert len(mixed) == 6000 and all(0 <= r.taken <= 4 for r in mixed)
    goal, got = {r.source: r.target for r in mixed}, Counter()
    for r in mixed:
        got[r.source] += r.taken
    assert all(got[s] == int(goal[s]) for s in goal)


def test_empty(empty):
    assert judge(empty).count() == mix(empty, word_count(F.col("text"))).count() == interleave(empty, {"n": F.lit(1)}, 16).count() == 0


def test_ranges(spark):
    ids = [1] * 50 + list(range(1000, 1300)) + [2**61, -(2**60), 5]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long")
    found = id_ranges(df, "id", 40, bins=16)
    assert sum(n for *_, n in found) == len(ids)
    assert all(n <= 40 or lo == hi for lo, hi, n in found) and all(a[1] < b[0] for a, b in zip(found, found[1:]))
    for r in df.where("id is not null").select("id", range_of("id", found).alias("k")).collect():
        assert found[r.k][0] <= r.id <= found[r.k][1]
    assert id_ranges(df.limit(0), "id", 40) == []


def test_no_python_in_plans(docs):
    for df in (judge(docs), mix(docs, word_count(F.col("text"))), interleave(docs, {"n": F.lit(1)}, 16)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
