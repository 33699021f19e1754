"""From raw documents to packed training sequences: five stages, each an operator of tessera.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import classifier
from tessera.llm.frames import SPACES, shared_dir, word_count
from tessera.llm.mixing import mix
from tessera.llm.near_dup import near_duplicates
from tessera.llm.packing import pack, token_pieces
from tessera.llm.queries import tokenizer_path
from tessera.llm.store import remove
from tessera.llm.substring import remove_repeats

#: Passages of at least so many words are cut where they repeat.
PASSAGE = 50


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels, keeps; whole rows, whatever other columns they have.

    Defined results: a null text is an empty one and is rated as such; rows are rated one by one, equal ones and those
    without an id too; a very long text is rated whole; a document at the limit stays; an empty table gives an empty one.
    """
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.select_good(docs, model)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, 80 %), the one with the smallest id; whole rows.

    Defined results: rows that share an id, or have none, are told apart by a hash of id and text, so that each is judged
    by its own text; of a class the row with the smallest id stays, none last, then that with the smallest hash; of rows
    that agree in id and text one stays; a null, empty or blank text is like no other text; a very long text is compared
    whole; other columns, of any name and type, are carried; an empty table gives an empty one.
    """
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    if shared.isEmpty():
        kept = near_duplicates(docs, width=5, percent=80).where("kept").select("doc_id")
        return rows.join(kept, F.col("row.doc_id") == kept["doc_id"], "left_semi").select("row.*")
    own = F.xxhash64("row.doc_id", "row.text")
    texts = rows.select(own.alias("doc_id"), F.col("row.text").alias("text"), F.col("row.doc_id").alias("given"))
    classes = near_duplicates(texts, width=5, percent=80).select("doc_id", "component_id").distinct()
    ids = texts.select("doc_id", "given").distinct()
    order = F.struct(F.col("given").isNull().alias("none"), "given", "doc_id")
    heads = classes.join(ids, "doc_id").groupBy("component_id").agg(F.min(order).alias("head")).select(F.col("head.doc_id").alias("own"))
    return rows.withColumn("own", own).join(heads, "own", "left_semi").groupBy("own").agg(F.first("row").alias("row")).select("row.*")


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE words or more that a document with a smaller id has; texts that lose all their words go.

    Defined results: a null text becomes an empty one and stays; rows without an id, and rows of one id among each
    other, keep their words; a very long text is cut like any other; other columns, of any name and type, are carried,
    and n_chars is counted anew; an empty table gives an empty one.
    """
    carried = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = remove_repeats(docs, length=PASSAGE, layout=True, carried=carried).where("n_removed = 0 or n_removed < n_words")
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col(f"carried_{i}") for i, c in enumerate(carried)}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept_text").cast("long")
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it; the one at a source's budget is cut to the words that are left.

    Defined results: rows that agree in id, source and number of words are matched in order of a hash of the text; a
    null or wordless text is never taken; a null source is a source of its own; a very long text may be cut at its
    source's budget; other columns, of any name and type, are carried, and n_chars is counted anew; an empty table gives
    an empty one.
    """
    size = word_count(F.col("text"))
    keys = ["doc_id", "source", "size"]
    taken = mix(docs, size).select(*keys, "taken")
    taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("taken")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("source"), size.alias("size"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row.text"))))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "nth"]]
    both = rows.alias("r").join(taken.alias("t"), same).where("t.taken > 0").select("r.row", "t.size", "t.taken")
    short = F.array_join(F.slice(F.array_remove(F.split("row.text", SPACES), ""), 1, F.pmod("taken", "size").cast("int")), " ")
    whole = F.array_repeat(F.col("row.text"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    texts = F.when(F.pmod("taken", "size") > 0, F.concat(whole, F.array(short))).otherwise(whole)
    out = both.select("row", F.explode(texts).alias("text"))
    columns = {c: F.col(f"row.{c}") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast("long")
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every row and their places in sequences of 2048 tokens.

    Defined results: a null text is an empty one, a piece of its end mark alone; rows with equal or null ids are packed
    one by one; a very long text has as many pieces as it needs; other columns are dropped; an empty table gives an
    empty one.
    """
    return pack(token_pieces(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("substring dedup", passage_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier, the sketches and the tokenizer have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet in the shared folder and read again by the next.

    A stage's files are removed when the next is written; the last stage's result is settled, so none are left.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(f"{folder}/{k - 1}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        remove(folder)
