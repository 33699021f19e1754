"""The queries of this subpackage: one for each operator, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, separators, warc
from .fingerprints import compare_edits
from .frames import settle, shared_dir, word_count
from .mixing import mix
from .near_dup import near_duplicates
from .oracles import ORACLES
from .packing import pack, token_pieces
from .quality_rules import judge
from .sharding import interleave
from .store import remove
from .substring import remove_repeats


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    manifest = warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    rows = warc.read_archive(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    rows = settle(rows)
    remove(folder)  # the digest is all that this query returns
    return rows


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf_dir), length=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_js", "word_js")})


def op6_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, end = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", 50256
    files = separators.write_flat(documents(spark, sf_dir), folder, tokenizer_path(), end)
    rows = settle(separators.count_tokens(files, folder, end))
    remove(folder)
    return rows


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(documents(spark, sf_dir), tokenizer_path())
    return pack(pieces)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.rate(docs, model)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mix(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}
    dealt = interleave(docs, columns, 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    every = (op1_fingerprints, op2_warc, op3_near_duplicates, op4_substring_dedup, op5_quality_rules, op6_separators, op7_packing, op8_quality_classifier, op9_mixing, op10_sharding)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict:
    return dict(ORACLES)
