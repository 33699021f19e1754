"""Queries on whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.fixtures import Slides

from .registry import query


@query("""
SELECT 'doc-' || doc_id AS file, sha256(text) AS sha256 FROM documents UNION ALL SELECT 'page-' || page_id, sha256(html) FROM pages""")
def file_hash(s: Slides) -> DataFrame:
    docs = s["documents"].select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), F.sha2("text", 256).alias("sha256"))
    return docs.unionByName(s["pages"].select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("file"), F.sha2("html", 256).alias("sha256")))
